"""Document fingerprints by invertible Bloom lookup sketches, in native Spark functions.

A text's paragraphs (its lines that are not empty) become 64-bit digests.  Each
digest falls into one cell of each of three subtables; a cell holds how many fell
into it, the exclusive or of the digests and that of their check hashes.  Equal
texts have equal sketches.  The difference of two sketches holds only digests
that one version has and the other lacks, and peeling recovers them: a cell that
holds one digest gives it away, it is taken out of its other cells, and so on.

A sketch that cannot be peeled is retried larger: digests are dealt to as many
sub-sketches as the texts need, each with up to three seeds, then to four and
sixteen times as many.  What three rounds leave is compared exactly.

All of it is one projection of array functions.  The next document of a text is
found with one shuffle: rows are dealt to ranges of ids, and the first text of
the following range closes each range.

Defined cases: a null text is empty, and an empty text has no digests and a
sketch of empty cells; two empty texts are alike (1.0); repeated paragraphs count
once; rows with equal ids follow each other by hash and text; null ids come last;
a single document is its own next; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a subtable of the fingerprint and of a retry's sub-sketches; digests of such a sub-sketch.
SIZE, RETRY_SIZE, LOAD = 8, 16, 16
#: Rounds of peeling, seeds of a sub-sketch, and growth of the retries.
ROUNDS, SEEDS, GROWTH = 8, 3, (1, 4, 16)
#: Ranges of ids per shuffle partition.
RANGES = 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def paragraphs(text: Column) -> Column:
    """Distinct digests of a text's paragraphs."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: p != "")
    return F.array_distinct(F.transform(lines, lambda p: F.xxhash64(p)))


def _check(key: Column, seed: Column) -> Column:
    return F.xxhash64(key, seed + 1000)


def _places(key: Column, seed: Column, size: int) -> list[Column]:
    """The key's cell in each subtable, counted through all cells."""
    return [(F.pmod(F.xxhash64(key, seed * 10 + j), F.lit(size)) + j * size).alias(f"p{j}") for j in range(3)]


def _entry(key: Column, count: Column, seed: Column, size: int) -> Column:
    return F.struct(key.alias("key"), count.alias("count"), _check(key, seed).alias("check"), *_places(key, seed, size))


def _taken(entries: Column, count: Column, key: Column, check: Column, sign: int) -> Column:
    """A cell with entries put in (1) or taken out (-1)."""
    start = F.struct(count.alias("count"), key.alias("key"), check.alias("check"))

    def add(cell: Column, e: Column) -> Column:
        return F.struct(
            (cell["count"] + sign * e["count"]).alias("count"),
            cell["key"].bitwiseXOR(e["key"]).alias("key"),
            cell["check"].bitwiseXOR(e["check"]).alias("check"),
        )

    return F.aggregate(entries, start, add)


def _cells(entries: Column, size: int) -> Column:
    """The cells that some entries fill."""
    zero = F.lit(0).cast("long")

    def table(j: int) -> Column:
        def cell(at: Column) -> Column:
            return _taken(F.filter(entries, lambda e: e[f"p{j}"] == at), F.lit(0), zero, zero, 1)

        return F.transform(F.sequence(F.lit(j * size), F.lit((j + 1) * size - 1)), cell)

    return F.concat(*map(table, range(3)))


def sketch(digests: Column, seed: Column, size: int = SIZE) -> Column:
    """The cells of some digests: an array of (count, key, check)."""
    return let(F.transform(digests, lambda d: _entry(d, F.lit(1), seed, size)), lambda e: _cells(e, size))


def signed_sketch(left: Column, right: Column, seed: Column, size: int) -> Column:
    """What subtracting the right digests' sketch from the left ones' leaves."""
    entries = F.concat(F.transform(left, lambda d: _entry(d, F.lit(1), seed, size)), F.transform(right, lambda d: _entry(d, F.lit(-1), seed, size)))
    return let(entries, lambda e: _cells(e, size))


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(
        left,
        right,
        lambda a, b: F.struct((a["count"] - b["count"]).alias("count"), a["key"].bitwiseXOR(b["key"]).alias("key"), a["check"].bitwiseXOR(b["check"]).alias("check")),
    )


def peel(cells: Column, seed: Column, size: int = SIZE) -> Column:
    """A struct: ``found`` (key, count 1 or -1 for the version that has it) and ``cells``, what is left."""

    def step(state: Column, _: Column) -> Column:
        alone = F.filter(state["cells"], lambda c: (F.abs(c["count"]) == 1) & (c["check"] == _check(c["key"], seed)))
        pure = F.array_distinct(F.transform(alone, lambda c: _entry(c["key"], c["count"], seed, size)))

        def remove(entries: Column) -> Column:
            def without(c: Column, at: Column) -> Column:
                held = F.filter(entries, lambda e: (e["p0"] == at) | (e["p1"] == at) | (e["p2"] == at))
                return _taken(held, c["count"], c["key"], c["check"], -1)

            found = F.concat(state["found"], F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["count"].alias("count"))))
            after = F.struct(F.transform(state["cells"], without).alias("cells"), found.alias("found"))
            return F.when(F.size(entries) == 0, state).otherwise(after)

        return let(pure, remove)

    start = F.struct(cells.alias("cells"), F.expr("cast(array() AS array<struct<key: bigint, count: int>>)").alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _emptied(state: Column) -> Column:
    return F.forall(state["cells"], lambda c: (c["count"] == 0) & (c["key"] == 0))


def _peeled(cells: Column, seed: Column, size: int) -> Column:
    """Digests that differ, or null where peeling fails."""
    return let(peel(cells, seed, size), lambda s: F.when(_emptied(s), s["found"]))


def _until(tries: Column, attempt: Callable[[Column], Column]) -> Column:
    """The first attempt that is not null; later ones are not computed."""
    nothing = F.lit(None).cast("array<struct<key: bigint, count: int>>")
    return F.aggregate(tries, nothing, lambda found, x: F.coalesce(found, attempt(x)))


def _retried(left: Column, right: Column) -> Column:
    """The digests that differ, from growing numbers of sub-sketches; null where peeling fails still."""
    parts = F.greatest(F.ceil((F.size(left) + F.size(right)) / LOAD).cast("int"), F.lit(1))

    def dealt(growth: Column) -> Column:
        def own(digests: Column, part: Column) -> Column:
            return F.filter(digests, lambda d: F.pmod(F.xxhash64(d, growth + 500), parts * growth) == part)

        def one(part: Column) -> Column:
            def tried(pair: Column) -> Column:
                def attempt(seed: Column) -> Column:
                    return _peeled(signed_sketch(pair["a"], pair["b"], seed, RETRY_SIZE), seed, RETRY_SIZE)

                return _until(F.sequence(growth * SEEDS, growth * SEEDS + SEEDS - 1), attempt)

            return let(F.struct(own(left, part).alias("a"), own(right, part).alias("b")), tried)

        found = F.transform(F.sequence(F.lit(0), parts * growth - 1), one)
        return let(found, lambda f: F.when(F.forall(f, lambda x: x.isNotNull()), F.flatten(f)))

    return _until(F.array(*map(F.lit, GROWTH)), dealt)


def _exact(left: Column, right: Column) -> Column:
    def only(a: Column, b: Column, sign: int) -> Column:
        return F.transform(F.array_except(a, b), lambda d: F.struct(d.alias("key"), F.lit(sign).alias("count")))

    return F.concat(only(left, right, 1), only(right, left, -1))


def difference(left: Column, right: Column, left_cells: Column, right_cells: Column) -> Column:
    """Digests that one version has and the other lacks: an array of (key, count 1 or -1).

    The fingerprints are peeled first; the paragraphs' digests serve the retries.
    """
    return F.coalesce(_peeled(subtract(left_cells, right_cells), F.lit(0), SIZE), _retried(left, right), _exact(left, right))


def likeness(left: Column, right: Column, left_cells: Column, right_cells: Column) -> Column:
    """Shared paragraphs as a share of all paragraphs, from 0 to 1."""
    n = F.size(left) + F.size(right)
    shared = let(F.size(difference(left, right, left_cells, right_cells)), lambda d: (n - d) / (n + d))
    return F.when(n == 0, F.lit(1.0)).otherwise(shared)


def written(cells: Column) -> Column:
    """A sketch as text."""
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(".", F.hex(c["count"]), F.hex(c["key"]), F.hex(c["check"]))), ",")


def _range_of(key: Column, bounds: list[float]) -> Column:
    """How many bounds are above a key; null keys come after all others."""
    if not bounds:
        return F.when(key.isNull(), F.lit(1)).otherwise(F.lit(0))
    falling = F.array(*[F.lit(b) for b in sorted(bounds, reverse=True)])
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]

    def search(at: Column, step: Column) -> Column:
        inside = at + step <= len(bounds)
        above = F.get(falling, at + step - 1) > key.cast("double")
        return F.when(inside & above, at + step).otherwise(at)

    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), search)
    return F.when(key.isNull(), F.lit(len(bounds) + 1)).otherwise(found)


def with_next(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``text`` and ``next``, the text of the document with the next smaller id; the last is followed by the first."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    n = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.approxQuantile("id", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    rows = rows.withColumn("range", _range_of(F.col("id"), sorted(set(bounds)))).withColumn("hash", F.xxhash64("text"))
    place = [F.col("id").isNull(), F.col("id").desc(), F.col("hash"), F.col("text")]
    window = Window.partitionBy("range").orderBy(*place)
    followed = rows.withColumns({"next": F.lead("text").over(window)})
    falling = F.struct(F.col("id").isNull(), F.bitwise_not("id").alias("below"), "hash", "text")
    first = rows.groupBy("range").agg(F.min(falling)["text"].alias("first"))
    # one row per range: a few numbers per shuffle partition
    starts = [r[0] for r in rows.select("range").distinct().orderBy("range").collect()]
    before = dict(zip(starts, [starts[-1], *starts[:-1]])) if starts else {}
    pairs = docs.sparkSession.createDataFrame(list(before.items()), "range int, follows int")
    closing = first.join(pairs, "range").select(F.col("follows").alias("range"), "first")
    last = F.col("next").isNull()
    joined = followed.withColumn("last", last).join(closing, "range", "left")
    return joined.select("id", "text", F.when(F.col("last"), F.col("first")).otherwise(F.col("next")).alias("next"))


def edited(text: Column, other: Column) -> Column:
    """The text with its second half replaced by as much of the other's beginning."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def compare_versions(rows: DataFrame, left: str, right: str, other: str) -> DataFrame:
    """``rows`` with the sketches of two versions and their likeness to each other and to a third text."""
    versions = F.array(*[F.col(c) for c in (left, right, other)])
    digests = F.transform(versions, paragraphs)

    def compared(v: Column) -> Column:
        first = v[0]
        near = F.transform(F.slice(v, 2, 2), lambda x: likeness(first["digests"], x["digests"], first["cells"], x["cells"]))
        return let(
            near,
            lambda x: F.struct(
                written(first["cells"]).alias("fingerprint"),
                written(v[1]["cells"]).alias("edited_fingerprint"),
                x[0].alias("near_edited"),
                x[1].alias("near_next"),
            ),
        )

    sketched = F.transform(digests, lambda d: F.struct(d.alias("digests"), sketch(d, F.lit(0)).alias("cells")))
    return rows.withColumn("compared", let(sketched, compared))


def fingerprint_edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint, that of its edited version, and their likeness to it and to the next text."""
    rows = with_next(docs, key=key, text=text).withColumn("edited", edited(F.col("text"), F.col("next")))
    return compare_versions(rows, "text", "edited", "next").select(
        F.col("id").alias(key), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "compared.*"
    )
