"""Similarity join on word n-grams by chosen paths.

Texts become sets of hashed five-word shingles; equal sets are one node.  Each
set is embedded as a MinHash signature of fixed length, whose coordinates are the
tokens that paths sample.  In every run all nodes start in one bucket, which is split
on all 64 bits of one coordinate, so nodes without a common shingle part whatever
their number; a bucket that is still too large is split on the token that its path
samples, again and again, until it is small.  Small buckets are compared by brute force
on their signatures, which gives candidate links with a margin below the threshold.  Runs
are repeated until a pair at the threshold meets with the target probability.

Candidate links form neighbourhoods.  Inside a neighbourhood every pair is then
verified on the whole shingle sets, in blocks of bounded rows and bytes, so a link is found
even where its own pair never met in a bucket.  Only counts and one link per node
and block leave a block; pairs are never emitted.

Defined cases: a null text is the empty text; a text of fewer words than a
shingle has one shingle of all its words; texts without words are linked only if
they are equal; copies count as links; rows with a null id take part and never
name a class unless the class has no id at all; an empty table gives an empty
table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.components import components
from tagloom.llm.line_dedup import bit_filter, free_name, passes
from tagloom.session import staged

#: Words of a shingle and the similarity of a link.
WORDS, THRESHOLD = 5, 0.8
#: Tokens of a signature, and the margin below the threshold that candidates may have.
TOKENS, MARGIN = 128, 0.14
#: A pair at the threshold meets in some run with this probability, if its buckets are small after two splits.
RECALL, USUAL_DEPTH = 0.9999, 2
#: Rows compared by brute force, splits of a path, rows and bytes of a verified block.
SMALL, DEPTH, BLOCK, BLOCK_BYTES = 256, 12, 1024, 16_000_000
#: Shingles of a block compared at once.
COLUMNS = 4096

_rng = np.random.default_rng(5)
_MULTIPLIERS = _rng.integers(1, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(1, 1 << 63, TOKENS, dtype=np.uint64)
_PLACES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers over each other."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    parts = (text or "").encode().split()
    if not parts:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    size = min(words, len(parts))
    n = len(parts) - size + 1
    total = np.full(n, size, np.uint64)
    for at in range(size):
        total += hashes[at : at + n] * _PLACES[at]
    return np.unique(_mixed(total))


def signature(values: np.ndarray) -> np.ndarray:
    """MinHash values of a set, 64 bits each."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 1024):
        part = values[None, at : at + 1024] * _MULTIPLIERS[:, None] + _SHIFTS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return _mixed(least)


def tokens_of(own: np.ndarray) -> bytes:
    """The tokens of a signature, 16 bits each: the low bytes of all (the marks), then the high bytes."""
    tokens = own >> np.uint64(48)
    return tokens.astype(np.uint8).tobytes() + (tokens >> np.uint64(8)).astype(np.uint8).tobytes()


def sketches(docs: DataFrame, *, key: str, text: str, words: int = WORDS, runs: int = 1) -> DataFrame:
    """Per document: id, ``place`` (a hash of its text), ``node`` (a digest of its set), ``tokens`` and ``starts`` (what each run splits on first)."""
    key_type = docs.schema[key].dataType.simpleString()
    first = np.arange(runs) % TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                nodes, tokens, starts = [], [], []
                for value in part.column(2):
                    raw = value.as_py()
                    values = shingles(raw, words)
                    # a text without words stands for itself
                    whole = values.tobytes() if len(values) else b"blank" + (raw or "").encode()
                    nodes.append(xxhash.xxh3_128_digest(whole))
                    own = signature(values) if len(values) else None
                    tokens.append(None if own is None else tokens_of(own))
                    starts.append(None if own is None else own[first].view(np.int64))
                sketched = [pa.array(nodes, pa.binary()), pa.array(tokens, pa.binary()), pa.array(starts, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *sketched], names=["id", "place", "node", "tokens", "starts"])

    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("place"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {key_type}, place long, node binary, tokens binary, starts array<long>")


def runs_for(threshold: float, recall: float = RECALL, depth: int = USUAL_DEPTH) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def buckets(nodes: DataFrame) -> DataFrame:
    """Small buckets of all runs: ``path``, ``node`` and ``large`` (still large after all splits).

    The coordinate that a path samples follows from its hash, so all its nodes
    split alike.  Sizes are counted, never gathered.
    """

    def split(path, tokens):
        at = F.pmod(path, F.lit(TOKENS)).cast("int") + 1
        return F.xxhash64(path, F.concat(tokens.substr(at, F.lit(1)), tokens.substr(at + TOKENS, F.lit(1))))

    start = nodes.select("node", F.posexplode("starts").alias("run", "start"))
    rows = start.select("node", F.xxhash64("run", "start").alias("path"))
    done = None
    for depth in range(1, DEPTH + 1):
        sizes = rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        met = staged(rows.join(sizes, "path"), "met")
        ready = met.where((F.col("size") <= SMALL) | F.lit(depth == DEPTH)).select("path", "node", (F.col("size") > SMALL).alias("large"))
        done = ready if done is None else done.unionByName(ready)
        large = met.where(F.col("size") > SMALL)
        if depth == DEPTH or large.isEmpty():
            return done
        rows = large.join(nodes.select("node", "tokens"), "node").select("node", split(F.col("path"), F.col("tokens")).alias("path"))


def _groups(batches: Iterator[pa.RecordBatch], by: int, most: int | None = None) -> Iterator[list[list]]:
    """Columns of consecutive rows that agree in the first ``by`` columns, ``most`` rows at a time."""
    current, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[:by] != current or (most and len(held[0]) >= most):
                if held:
                    yield held
                current, held = row[:by], [[] for _ in row]
            for column, value in zip(held, row):
                column.append(value)
    if held:
        yield held


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> list[int]:
    """The smallest member of each one's component."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(left.tolist(), right.tolist()):
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def candidate_links(found: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that connect the similar members of each bucket."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: set[tuple[bytes, bytes]] = set()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])
            pairs.clear()
            return batch

        path, anchor = None, None
        for paths, large, members, marks in _groups(batches, 1, SMALL):
            matrix = np.frombuffer(b"".join(marks), np.uint8).reshape(-1, TOKENS)
            n = len(matrix)
            if n == 2:
                left, right = (np.array([0]), np.array([1])) if (matrix[0] == matrix[1]).mean() >= least else (np.zeros(0, int),) * 2
            else:
                alike = np.stack([(matrix == row).mean(axis=1) for row in matrix])
                left, right = np.nonzero(np.triu(alike >= least, 1))
            roots = _roots(n, left, right)
            pairs.update((members[r], members[x]) for x, r in enumerate(roots) if r != x)
            if large[0]:  # similar along the whole path: one neighbourhood
                if paths[0] != path:
                    path, anchor = paths[0], members[0]
                pairs.update((anchor, members[r]) for r in set(roots) if members[r] != anchor)
            if len(pairs) > 20_000:
                yield flush()
        if pairs:
            yield flush()

    rows = found.join(nodes.select("node", F.col("tokens").substr(1, TOKENS).alias("marks")), "node").select("path", "large", "node", "marks")
    near = rows.repartition("path").sortWithinPartitions("path", "node")
    return near.mapInArrow(compare, "a binary, b binary").distinct()


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set."""
    sets = left + right
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    used = counts[at] > 1
    rows, columns = rows[used], shared[at[used]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    total = np.zeros((len(left), len(right)), np.float64)
    n = int(shared[-1]) + 1 if len(shared) else 0
    for lo in range(0, n, COLUMNS):
        a, b = np.searchsorted(columns, (lo, lo + COLUMNS))
        matrix = np.zeros((len(sets), min(COLUMNS, n - lo)), np.float32)
        matrix[rows[a:b], columns[a:b] - lo] = 1
        total += matrix[: len(left)] @ matrix[len(left) :].T
    return total


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """Per node and block: linked nodes, linked documents and one link towards the block's smallest node.

    ``members`` holds label, i, j (a pair of blocks), own (the node's block), node, copies, values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, i, j, own, node, copies, values in _groups(batches, 3):
            first = [x == 0 or node[x] != node[x - 1] or own[x] != own[x - 1] for x in range(len(node))]  # repeated rows are one node
            node, copies, own, values = ([v for v, f in zip(c, first) if f] for c in (node, copies, own, values))
            sets, n = [np.frombuffer(v, np.uint64) for v in values], len(node)
            cut = n if i[0] == j[0] else sum(o == i[0] for o in own)
            left, right, shift = (sets, sets, 0) if i[0] == j[0] else (sets[:cut], sets[cut:], cut)
            if not left or not right:
                continue
            common = _overlaps(left, right)
            sizes = np.array([len(s) for s in sets], np.float64)
            united = sizes[:cut, None] + sizes[None, shift:] - common
            linked = common >= threshold * united - 1e-9
            if i[0] == j[0]:
                np.fill_diagonal(linked, False)
            a, b = np.nonzero(linked)
            b = b + shift
            weight = np.array(copies, np.int64)
            if i[0] == j[0]:
                texts, docs = np.bincount(a, minlength=n), np.bincount(a, weight[b], n)
            else:
                both, other = np.concatenate([a, b]), np.concatenate([b, a])
                texts, docs = np.bincount(both, minlength=n), np.bincount(both, weight[other], n)
            hit = np.flatnonzero(texts)
            if not len(hit):
                continue
            roots = _roots(n, a, b)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([node[x] for x in hit], pa.binary()),
                    pa.array(texts[hit].astype(np.int64)),
                    pa.array(docs[hit].astype(np.int64)),
                    pa.array([node[roots[x]] for x in hit], pa.binary()),
                ],
                names=["node", "texts", "docs", "root"],
            )

    dealt = members.select("label", "i", "j", "own", "node", "copies", "values").repartition("label", "i", "j")
    ordered = dealt.sortWithinPartitions("label", "i", "j", "own", "node")
    return ordered.mapInArrow(run, "node binary, texts long, docs long, root binary")


def shingle_sets(docs: DataFrame, told: np.ndarray, words: int) -> DataFrame:
    """``id``, ``place`` and ``values`` (the shingles) of the rows of ``docs`` (id, place, text) whose place the filter holds."""
    key_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.filter(pa.array(passes(batch.column(1).to_numpy(), told)))
            for at in range(0, held.num_rows, 500):
                part = held.slice(at, 500)
                values = pa.array([shingles(v.as_py(), words).tobytes() for v in part.column(2)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), values], names=["id", "place", "values"])

    return docs.select("id", "place", "text").mapInArrow(run, f"id {key_type}, place long, values binary")


class Join:
    """The join's result: ``nodes`` with their classes and links, ``members`` with their nodes."""

    def __init__(self, docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK):
        rows = staged(sketches(docs, key=key, text=text, words=words, runs=runs_for(threshold, recall)), "sketches")
        grouped = rows.groupBy("node").agg(F.min(F.struct(F.col("id").isNull(), "id", "place")).alias("rep"), F.count("*").alias("copies"), F.min("tokens").alias("tokens"), F.min("starts").alias("starts"))
        nodes = staged(grouped, "nodes")
        self.members = rows.select("id", "place", "node")
        self.nodes = staged(self._classes(docs, nodes, key, text, words, threshold, block), "classes")

    def _classes(self, docs: DataFrame, nodes: DataFrame, key: str, text: str, words: int, threshold: float, block: int) -> DataFrame:
        tokens = nodes.where("tokens IS NOT NULL").select("node", "tokens", "starts")
        near = candidate_links(buckets(tokens), tokens, threshold - MARGIN)
        around = components(near)
        chosen = staged(nodes.select("node", "copies", "rep").join(around, "node"), "chosen")
        # only texts in a neighbourhood move; a filter that fills up lets more through and changes no result
        told = bit_filter(chosen.select(F.col("rep")["place"].alias("key")))
        texts = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("place"), F.col(text).alias("text"))
        found = shingle_sets(texts, told, words).select(F.col("id").alias("_id"), F.col("place").alias("_place"), "values")
        same = found["_id"].eqNullSafe(chosen["rep"]["id"]) & (found["_place"] == chosen["rep"]["place"])
        sets = staged(found.join(chosen, same).select("node", "copies", "label", "values"), "sets")
        most = F.greatest(F.count("*") / block, F.sum(F.length("values")) / BLOCK_BYTES)
        sets = sets.join(sets.groupBy("label").agg(F.ceil(most).cast("int").alias("n_blocks")), "label")
        own = sets.withColumn("own", F.pmod(F.xxhash64("node"), "n_blocks").cast("int"))
        dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        links = staged(verified(dealt, threshold), "links")
        classes = components(links.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        counts = links.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
        every = nodes.select("node", "copies", "rep").join(classes, "node", "left").join(counts, "node", "left")
        every = every.select("node", "rep", "copies", F.coalesce("label", "node").alias("class"), (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0).cast("long")).alias("n_texts"))
        first = every.groupBy("class").agg(F.min("rep").alias("first"), F.sum("copies").alias("n_docs"))
        return every.drop("copies").join(first, "class")

    def documents(self) -> DataFrame:
        """Per document: ``id``, ``class_id`` (the smallest id of its class), ``n_links`` and ``n_texts`` (other documents and other texts linked)."""
        classes = self.nodes.select("node", F.col("first")["id"].alias("class_id"), "n_links", "n_texts")
        return self.members.select("id", "node").join(classes, "node").drop("node")

    def shared_places(self) -> DataFrame:
        """``place`` of the documents whose class has others, repeated rows included."""
        return self.members.join(self.nodes.where("n_docs > 1").select("node"), "node", "left_semi").select("place")

    def representatives(self) -> DataFrame:
        """``id`` and ``place`` of one document of each class, the one with the smallest id."""
        return self.nodes.where("rep = first").select("rep.id", "rep.place")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", place: Callable = F.xxhash64) -> DataFrame:
    """The documents without near duplicates: one document of each class stays, whole.

    Only texts whose class has others move; a filter that fills up moves more and changes no result.
    """
    own, first, at = (free_name(n, docs.columns) for n in ("_id", "_place", "_at"))
    join = Join(docs, key=key, text=text)
    told = bit_filter(join.shared_places().select(F.col("place").alias("key")).distinct())

    @F.pandas_udf("boolean")
    def shares(places: pd.Series) -> pd.Series:
        return pd.Series(passes(places.to_numpy(), told))

    kept = join.representatives().select(F.col("id").alias(own), F.col("place").alias(first))
    rows = docs.withColumn(at, place(text))
    moved = rows.where(shares(at))
    same = moved[key].eqNullSafe(F.col(own)) & (F.col(at) == F.col(first))
    left = moved.join(kept, same, "left_semi").dropDuplicates([key, at])
    return rows.where(~shares(at)).unionByName(left).drop(at)
