"""Line deduplication by a deletion-neighbourhood join.

Lines are compared by their words.  A line goes if an earlier line, in the order
of ids and line numbers, has the same words, or is within one word edit (a word
changed, added or left out) and both have at least ``NEAR_WORDS`` words.  The
earliest of equal lines stays.

Near lines are found by deletion variants: a line emits the hash of its words and
the hashes of its words without each single one.  Two lines that differ in one
word share the variant without it at the same place; a line with one word more
shares a variant with the other's whole line.  Equal variants are joined by
grouped minima, never as pairs, and what they claim is verified on the words.

Only lines that can have a partner emit variants.  One edit lies in one half of a
line, so partners agree in the other half; halves are counted as hashes first.
The halves that several lines share are told to the next scan by a bit filter of
fixed size, and so are the variants that several lines share, before their lines
are moved; a filter that fills up lets more through and changes no result.

The texts are cut into lines twice: for the hashes of all lines and their halves,
and for the words of the lines that share a half, which are staged; variants are
made from those alone.  Arrow cuts lines and words, and a hash of any stretch of
words is a difference of running sums over a chunk, so no word is a Python object.

Defined cases: a null text stays null and has no lines; lines without words are
kept and not counted; rows with equal id and text are treated alike, their lines
are first together; a null id comes before all others; an empty table gives an
empty table; other columns are passed through, whatever their names; ids may be of any
type that can be ordered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.session import staged

#: Lines of fewer words have no near lines, only equal ones.
NEAR_WORDS = 8
#: Bits of the filter between the scans, a power of two, and positions per line.
FILTER_BITS, POSITIONS = 1 << 23, 2

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LENGTH = 0xC2B2AE3D27D4EB4F
#: Bytes of lines that are taken at once (one line at least), bytes of words hashed at once, longest word hashed by its bytes' sums.
CHUNK_BYTES, HASH_BYTES, SHORT_WORD = 1 << 20, 1 << 18, 64

_LINES = "place long, line int, hash binary, code long, halves array<long>"
_MET = "line int, hash binary, words string"
_VARIANTS = "line int, hash binary, key long, gap int, words binary"
_KEYS = "key long, code long"


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of a base."""
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    return np.cumprod(x)


def _lengths(n: np.ndarray) -> np.ndarray:
    return n.astype(np.uint64) * np.uint64(_LENGTH)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class _Sums:
    """Hashes of any stretch of values: running sums of the values times powers of a base."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers(_BASE, n), out=self.sums[1:])
        self.back = _powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def word_hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word of a string or binary array without nulls."""
    kind = np.int64 if pa.types.is_large_string(words.type) else np.int32
    out = np.zeros(len(words), np.uint64)
    if not len(words):
        return out
    offsets = np.frombuffer(words.buffers()[1], kind)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + HASH_BYTES, "right")) - 1)
        start, end = offsets[at:to], offsets[at + 1 : to + 1]
        if end[-1] - start[0] <= HASH_BYTES:  # else one long word
            chars = data[start[0] : end[-1]].astype(np.uint64) + np.uint64(1)
            out[at:to] = _mixed(_Sums(chars).of(start - start[0], end - start[0]) + _lengths(end - start))
        for i in np.flatnonzero(end - start > SHORT_WORD).tolist():  # sums of bytes are weak on long regular words
            out[at + i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
        at = to
    return out


class Lines:
    """Words of lines (a list array), the row of each line in its batch and its number in its text."""

    def __init__(self, row: np.ndarray, number: np.ndarray, words: pa.Array):
        self.row, self.number, self.words = row, number, words
        offsets = words.offsets.to_numpy()
        self.start, self.end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        self.n = self.end - self.start
        self.hashes = _Sums(word_hashes(words.flatten()))

    def codes(self) -> np.ndarray:
        """Hashes of the whole lines."""
        return _mixed(self.hashes.of(self.start, self.end) + _lengths(self.n)).view(np.int64)

    def halves(self) -> np.ndarray:
        """Four hashes a line, of the halves that a partner within one edit may share."""
        out = np.empty((len(self.n), 4), np.uint64)
        for i, m in enumerate((self.n, self.n - 1)):  # the shorter line's length
            out[:, 2 * i] = self.hashes.of(self.start, self.start + m // 2) + _lengths(2 * m)
            out[:, 2 * i + 1] = self.hashes.of(self.end - (m - m // 2), self.end) + _lengths(2 * m + 1)
        return _mixed(out).view(np.int64)

    def variants(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each whole line, then of the line without each word; the line's place and the word's (-1: none)."""
        at = np.repeat(np.arange(len(self.n)), self.n + 1)
        gap = np.arange(len(at)) - np.repeat(np.cumsum(self.n + 1) - self.n - 1, self.n + 1) - 1
        start, end, cut = self.start[at], self.end[at], gap >= 0
        word = start + gap
        rest = (self.hashes.of(start, end) - self.hashes.of(start, word + 1)) * np.uint64(_INVERSE) + self.hashes.of(start, np.maximum(word, start))
        whole = self.hashes.of(start, end)
        return _mixed(np.where(cut, rest, whole) + _lengths(self.n[at] - cut)).view(np.int64), at, gap

    def joined(self, chosen: np.ndarray | None = None) -> pa.Array:
        """The words of all or of chosen lines with a space between."""
        words = self.words if chosen is None else self.words.take(pa.array(chosen))
        return pc.binary_join(words, " ").cast(pa.string())


def _chunks(values: pa.Array) -> Iterator[slice]:
    """Stretches of about CHUNK_BYTES."""
    ends = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False), dtype=np.int64) // CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(values)]
    for start, end in zip(cuts, cuts[1:]):
        if start < end:
            yield slice(start, end)


def lines_of(texts: pa.Array, least: int = 1) -> Iterator[Lines]:
    """The lines of at least so many words; words end at ASCII whitespace."""
    for at in range(0, len(texts), 500):
        split = pc.split_pattern(pc.fill_null(texts.slice(at, 500), ""), "\n")
        offsets = split.offsets.to_numpy()
        row = np.repeat(np.arange(len(split)), np.diff(offsets))
        number = np.arange(len(row)) - (offsets[:-1] - offsets[0])[row]
        values = pc.ascii_trim_whitespace(split.flatten())
        worded = np.flatnonzero(pc.binary_length(values).to_numpy(zero_copy_only=False))
        row, number, values = row[worded] + at, number[worded], values.take(pa.array(worded))
        for chunk in _chunks(values):
            words = pc.ascii_split_whitespace(values[chunk])
            own = slice(None)
            if least > 1:
                own = np.flatnonzero(pc.list_value_length(words).to_numpy(zero_copy_only=False) >= least)
                words = words.take(pa.array(own))
            if len(words):
                yield Lines(row[chunk][own], number[chunk][own], words)


def halves(words: list[bytes], whole: bytes) -> list[int]:
    """The halves of one line, given as words and joined."""
    one = np.zeros(1, np.int64)
    return Lines(one, one, pa.array([words], pa.list_(pa.binary()))).halves()[0].tolist()


def _digests(joined: pa.Array) -> list[bytes]:
    return [xxhash.xxh3_128_digest(x) for x in joined.cast(pa.binary()).to_pylist()]


def _batch(columns: list[pa.Array], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=list(names))


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word edit at most separates two lines."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    n = len(a)
    head = next((i for i in range(n) if a[i] != b[i]), n)
    if len(a) == len(b):
        return a[head + 1 :] == b[head + 1 :]
    return a[head:] == b[head + 1 :]


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("place"), F.col(text).alias("text"))


def _lines(docs: DataFrame, key_type: str) -> DataFrame:
    """All lines with words, with their halves if they may have near lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in lines_of(batch.column(2)):
                own = [batch.column(i).take(pa.array(found.row)) for i in (0, 1)]
                near = found.n >= NEAR_WORDS
                ends = pa.array(np.r_[0, np.cumsum(4 * near)], pa.int32())
                halves = pa.ListArray.from_arrays(ends, pa.array(found.halves()[near].reshape(-1)))
                yield _batch(
                    [*own, pa.array(found.number, pa.int32()), pa.array(_digests(found.joined()), pa.binary()), pa.array(found.codes()), halves],
                    "id", "place", "line", "hash", "code", "halves",
                )

    return docs.mapInArrow(run, f"id {key_type}, {_LINES}")


def _shared(keys: DataFrame) -> DataFrame:
    """``key`` of the keys that lines of different codes share."""
    return keys.groupBy("key").agg(F.min("code").alias("a"), F.max("code").alias("b")).where("a <> b").select("key")


def bit_filter(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A filter of the column ``key``: ``bits`` bits, whatever the rows."""
    places = F.array(*(F.shiftrightunsigned("key", 24 * p).bitwiseAND(F.lit(bits - 1)) for p in range(POSITIONS)))
    place = keys.select(F.explode(places).alias("at"))
    words = place.groupBy(F.shiftright("at", 5).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 AS int))")).alias("bits"))
    out = np.zeros(bits >> 5, np.uint32)
    for r in words.collect():  # one row per 32 bits of the filter at most
        out[r["word"]] = r["bits"]
    return out


def passes(keys: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Which keys the filter holds."""
    x, bits = keys.view(np.uint64), len(told) << 5
    held = np.ones(len(x), bool)
    for p in range(POSITIONS):
        at = (x >> np.uint64(24 * p)) & np.uint64(bits - 1)
        held &= told[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1) > 0
    return held


def _met(docs: DataFrame, key_type: str, told: np.ndarray) -> DataFrame:
    """The lines that share a half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in lines_of(batch.column(1), NEAR_WORDS):
                met = np.flatnonzero(passes(found.halves().reshape(-1), told).reshape(-1, 4).any(axis=1))
                if len(met):
                    joined = found.joined(met)
                    own = batch.column(0).take(pa.array(found.row[met]))
                    yield _batch([own, pa.array(found.number[met], pa.int32()), pa.array(_digests(joined), pa.binary()), joined], "id", "line", "hash", "words")

    return docs.select("id", "text").mapInArrow(run, f"id {key_type}, {_MET}")


def _met_lines(words: pa.Array) -> Iterator[Lines]:
    for chunk in _chunks(words):
        at = np.arange(chunk.start, chunk.stop)
        yield Lines(at, at, pc.ascii_split_whitespace(words[chunk]))


def variant_keys(met: DataFrame) -> DataFrame:
    """The variants of all lines that share a half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lines in _met_lines(batch.column(0)):
                keys, at, _ = lines.variants()
                yield _batch([pa.array(keys), pa.array(lines.codes()[at])], "key", "code")

    return met.select("words").mapInArrow(run, _KEYS)


def _variants(met: DataFrame, key_type: str, shared: np.ndarray) -> DataFrame:
    """The shared variants of the lines, and each such line's words beside its own hash (gap -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lines in _met_lines(batch.column(3)):
                keys, at, gap = lines.variants()
                held = passes(keys, shared)
                held |= (gap < 0) & (np.bincount(at, held)[at] > 0)
                keys, row, gap = keys[held], lines.row[at[held]], gap[held]
                own = [batch.column(i).take(pa.array(row)) for i in (0, 1, 2)]
                words = batch.column(3).take(pa.array(row, mask=gap >= 0)).cast(pa.binary())
                yield _batch([*own, pa.array(keys), pa.array(gap, pa.int32()), words], "id", "line", "hash", "key", "gap", "words")

    return met.select("id", "line", "hash", "words").mapInArrow(run, f"id {key_type}, {_VARIANTS}")


def _order() -> Column:
    """Where a line stands; ties of repeated rows are broken by the line's hash."""
    return F.struct(F.col("id").isNotNull().alias("has"), "id", "line", "hash")


def near_lines(docs: DataFrame, lines: DataFrame, key_type: str, bits: int = FILTER_BITS) -> DataFrame:
    """``hash`` of the lines of ``docs`` (id, text) within one edit of an earlier line; ``lines`` holds their halves."""
    told = bit_filter(_shared(lines.select(F.explode("halves").alias("key"), "code")), bits)
    near = staged(_met(docs, key_type, told), "near")
    shared = bit_filter(_shared(variant_keys(near)), bits)
    rows = staged(_variants(near, key_type, shared).withColumn("order", _order()).drop("id", "line"), "variants")
    keys = rows.groupBy("key").agg(
        F.min("hash").alias("a"),
        F.max("hash").alias("b"),
        F.min(F.when(F.col("gap") < 0, F.col("order"))).alias("whole"),
        F.min(F.when(F.col("gap") >= 0, F.col("order"))).alias("cut"),
    )
    copies = rows.drop("words").join(keys.where("a <> b").drop("a", "b"), "key")
    # a line's copies emit the same variants; the line stands where its first copy does
    met = staged(copies.groupBy("key", "gap", "hash").agg(*[F.min(c).alias(c) for c in ("order", "whole", "cut")]), "met")
    changed = met.where("gap >= 0").groupBy("key", "gap").agg(F.min("order").alias("same"))
    one_word = met.where("gap >= 0").join(changed, ["key", "gap"]).where("same < order").select("hash", F.col("same")["hash"].alias("other"))
    other = F.when(F.col("gap") < 0, F.col("cut")).otherwise(F.col("whole"))
    one_more = met.withColumn("other", other).where("other < order").select("hash", F.col("other")["hash"].alias("other"))
    claims = one_word.union(one_more).where("hash <> other").distinct()

    @F.pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within_one(x.split(), y.split()) for x, y in zip(a, b)], dtype=bool)

    texts = rows.where("gap < 0").groupBy("hash").agg(F.min("words").alias("words"))
    mine, theirs = texts.withColumnRenamed("words", "mine"), texts.select(F.col("hash").alias("other"), F.col("words").alias("theirs"))
    return claims.join(mine, "hash").join(theirs, "other").where(verified("mine", "theirs")).select("hash").distinct()


def repeated_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", bits: int = FILTER_BITS) -> DataFrame:
    """``id``, ``place`` (a hash of the text) and ``drops``, the numbers of the lines to drop, of texts with any.

    Rows of one id with different texts, or without an id, are gathered text by text.
    """
    key_type = docs.schema[key].dataType.simpleString()
    rows = _rows(docs, key, text)
    lines = staged(_lines(rows, key_type), "lines")
    order = F.struct(F.col("id").isNotNull().alias("has"), "id", "line", "place")
    first = lines.groupBy("hash").agg(F.min(order).alias("first"))
    near = near_lines(rows, lines, key_type, bits).withColumn("near", F.lit(True))
    kept = first.join(near, "hash", "left")
    gone = lines.join(kept, "hash").where(F.col("near") | ~order.eqNullSafe(F.col("first")))
    return gone.groupBy("id", "place").agg(F.collect_set("line").alias("drops"))


def free_name(name: str, taken: list[str]) -> str:
    """A name that no column has."""
    while name in taken:
        name += "_"
    return name


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", into: str = "lines", bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` with a struct ``into``: ``text`` without the repeated lines, ``n_lines`` and ``n_dropped`` (lines with words)."""
    own, place, drops = (free_name(n, [*docs.columns, into]) for n in ("_id", "_place", "_drops"))
    found = repeated_lines(docs, key=key, text=text, bits=bits).select(F.col("id").alias(own), F.col("place").alias(place), F.col("drops").alias(drops))

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def rebuilt(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for t, d in zip(texts.tolist(), gone.tolist()):
            worded = 0 if t is None else sum(1 for x in t.encode().split(b"\n") if x and not x.isspace())
            among = set() if d is None else set(d.tolist())
            left = t if not among else "\n".join([x for i, x in enumerate(t.split("\n")) if i not in among])
            out.append((left, worded, len(among)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    joined = docs.join(found, docs[key].eqNullSafe(F.col(own)) & (F.xxhash64(docs[text]) == F.col(place)), "left")
    # only texts that lose lines go through Python, so its batches stay small
    touched = F.col(drops).isNotNull()
    worded = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda line: line.rlike(r"[^ \t\n\x0B\f\r]"))
    # a deterministic function would run a second time, in a second worker, for a filter on its result
    rebuilt = rebuilt.asNondeterministic()
    whole = F.struct(F.col(text).alias("text"), F.size(worded).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    cut = rebuilt(F.when(touched, F.col(text)), F.col(drops))
    return joined.withColumn(into, F.when(touched, cut).otherwise(whole)).drop(own, place, drops)


def keep_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their first lines only; those that lose all lines with words go."""
    into = free_name("lines", docs.columns)
    names = docs.columns
    found = dedup(docs, key=key, text=text, into=into)
    left = found.where((F.col(into)["n_dropped"] == 0) | (F.col(into)["n_dropped"] < F.col(into)["n_lines"]))
    return left.select(*[F.col(into)["text"].alias(text) if n == text else F.col(n) for n in names])
