"""Ranked lexical search: the best documents for each of a set of queries.

Documents are read once into rows of their counts of the queries' terms (terms that no
query holds change no score but the length); these rows are written to the shared folder
and give the numbers of the whole corpus.  Each task then gathers rows into shards of
bounded size with an inverted index: posting lists in blocks of 128, gaps and
frequencies in the fewest bytes that hold them, and the highest gain of each block.

A query reads a shard's lists by Block-Max MaxScore.  Lists go from the highest bound
(weight times the list's highest gain) to the lowest; as long as all remaining bounds
together could lift an unseen document to the threshold, a list is essential and read
whole.  From the others no new candidate can come: each candidate is looked up in the
list's block maxima, and rejected where its score so far, the block's maximum and the
bounds of the lists after it stay below the threshold; only blocks that hold surviving
candidates are decompressed.  The threshold is the k-th best score found so far, by this
shard's partial scores or by the shards before; candidates equal to it stay, so ties are
exact.  Each task returns its best k per query, and these heaps are merged.

Scores are integers: a term of weight w found tf times gives w * gain, gain being
(10^9 * tf) div (1000 * tf + 12 * m), where m grows with the document's length against
the corpus's.

Queries go in blocks of ``BLOCK_CHARACTERS`` of text, each with a pass over the
documents, so neither the driver nor a task holds more of them.

Defined cases: a null text has no terms and matches nothing; a query without known terms
has no rows; a term repeated in a query counts each time; equal scores go by key, null
keys last; repeated rows are documents of their own; repeated queries are each answered;
an empty table gives no rows; a long text is one row of counts; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.terms import LETTERS_DIGITS, chunks, cut
from tagloom.session import staged

#: Documents returned for a query; postings of a block; postings of a shard; characters of a block of queries.
K, BLOCK, SHARD, BLOCK_CHARACTERS = 20, 128, 3_000_000, 4_000_000


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def length_factors(lengths: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """m of each document; in Python's integers where 64 bits do not hold the product."""
    if 25 * int(lengths.max(initial=0)) * n_docs >= 1 << 63:
        return np.array([75 + 25 * int(n) * n_docs // all_terms for n in lengths], np.int64)
    return 75 + 25 * lengths * n_docs // all_terms


def gains(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def smallest(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(values.max(initial=0)))


class Postings:
    """One term's documents of a shard in compressed blocks."""

    def __init__(self, docs: np.ndarray, tf: np.ndarray, m: np.ndarray, block: int):
        n = -(-len(docs) // block)
        spare = n * block - len(docs)
        gain = np.append(gains(tf, m[docs]), np.zeros(spare, np.int64)).reshape(n, block)
        placed = np.append(docs, np.full(spare, docs[-1])).reshape(n, block)
        self.first, self.last = placed[:, 0].copy(), placed[:, -1].copy()
        self.most = gain.max(1)
        self.bound = int(self.most.max())
        self.gaps = smallest(np.diff(placed, axis=1, prepend=placed[:, :1]))
        self.tf = smallest(np.append(tf, np.zeros(spare, np.int64)).reshape(n, block))
        self.decompressed = 0

    def read(self, m: np.ndarray, blocks: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Documents and gains of some blocks."""
        docs = self.first[blocks][:, None] + np.cumsum(self.gaps[blocks], axis=1, dtype=np.int64)
        tf = self.tf[blocks].astype(np.int64)
        self.decompressed += len(tf)
        there = tf > 0
        docs, tf = docs[there], tf[there]
        return docs, gains(tf, m[docs])


class Shard:
    """Index over documents (numbered in order of their keys) and the terms of the queries."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, tf: np.ndarray, m: np.ndarray, block: int = BLOCK):
        self.m, self.lists = m, {}
        order = np.lexsort((docs, terms))
        docs, terms, tf = docs[order], terms[order], tf[order]
        cuts = np.flatnonzero(np.diff(terms, prepend=-1))
        for at, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(terms)]):
            self.lists[int(terms[at])] = Postings(docs[at:end], tf[at:end], m, block)

    def top(self, query: dict[int, int], threshold: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the shard's best k, or all that may be among the best k of all shards.

        ``query`` has each term's weight, times its repeats; documents below the threshold may be left out.
        """
        lists = sorted(((w * self.lists[t].bound, w, t) for t, w in query.items() if w and t in self.lists), reverse=True)
        rest = np.append(np.cumsum([bound for bound, _, _ in reversed(lists)], dtype=np.int64)[::-1], 0)
        score, need, at = np.zeros(len(self.m), np.int64), max(threshold, 1), 0
        while at < len(lists) and rest[at] >= need:  # essential lists
            docs, gain = self.lists[lists[at][2]].read(self.m)
            score[docs] += lists[at][1] * gain
            at += 1
            if len(score) > k and at < len(lists):
                need = max(need, int(np.partition(score, -k)[-k]))
        candidates = np.flatnonzero(score + rest[at] >= need)
        candidates = candidates[score[candidates] > 0]
        for after, (_, w, term) in enumerate(lists[at:], at + 1):
            if not len(candidates):
                break
            postings = self.lists[term]
            block = np.minimum(np.searchsorted(postings.last, candidates), len(postings.last) - 1)
            there = (postings.first[block] <= candidates) & (candidates <= postings.last[block])
            alive = score[candidates] + np.where(there, w * postings.most[block], 0) + rest[after] >= need
            candidates, block = candidates[alive], block[alive & there]
            if len(block):
                docs, gain = postings.read(self.m, np.unique(block))
                score[docs] += w * gain
            if len(candidates) > k:
                need = max(need, int(np.partition(score[candidates], -k)[-k]))
        found = score[candidates]
        best = np.lexsort((candidates, -found))[:k]
        best = best[found[best] >= max(threshold, 1)]
        return candidates[best], found[best]


def term_rows(docs: DataFrame, vocabulary: list[bytes], key: str, text: str) -> DataFrame:
    """``key, n, terms, tf``: a document's number of all terms, and its counts of the vocabulary's."""
    known = pa.array(vocabulary, pa.binary())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = max(1, len(vocabulary))
        for batch in (part for whole in batches for part in chunks(whole, 1)):
            rows, terms = cut(batch.column(1), LETTERS_DIGITS)
            lengths = np.bincount(rows, minlength=batch.num_rows)
            codes = pc.index_in(terms, known)
            there = codes.is_valid().to_numpy(zero_copy_only=False)
            pairs, tf = np.unique(rows[there] * base + codes.fill_null(0).to_numpy()[there], return_counts=True)
            row, term = np.divmod(pairs, base)
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths), *lists], names=["key", "n", "terms", "tf"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(count, f"key {kind}, n long, terms array<int>, tf array<int>")


def blocks_of(items: DataFrame, item: str, query: str, characters: int = BLOCK_CHARACTERS) -> Iterator[list[tuple]]:
    """(id, terms) of the queries, so many at a time that their texts stay within the bound."""
    block, size = [], 0
    for row in items.select(F.col(item), F.col(query)).toLocalIterator():
        block.append((row[0], cut(pa.array([row[1]], pa.string()), LETTERS_DIGITS)[1].to_pylist()))
        size += len(row[1] or "")
        if size > characters:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text", k: int = K, shard: int = SHARD) -> DataFrame:
    """``item``, rank, ``key`` and score of each query's best k documents."""
    parts = [_search(docs, block, items, key, text, item, k, shard) for block in blocks_of(items, item, query)]
    return reduce(DataFrame.unionByName, parts or [_search(docs, [], items, key, text, item, k, shard)])


def _search(docs: DataFrame, block: list[tuple], items: DataFrame, key: str, text: str, item: str, k: int, shard: int) -> DataFrame:
    spark = docs.sparkSession
    kind, vocabulary = docs.schema[key].dataType.simpleString(), sorted({t for _, terms in block for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    rows = staged(term_rows(docs, vocabulary, key, text), "term-rows")
    n_docs, all_terms = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # one number for each term of this block's queries
    holding = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("docs")).collect()
    weights = {r.term: weight(n_docs, r.docs) for r in holding}
    queries = [{number[t]: c * weights[number[t]] for t, c in Counter(terms).items() if number[t] in weights} for _, terms in block]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[] for _ in queries]  # (score, key) of each query, best first
        held, size, key_type = [], 0, None

        def ask() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table["key"].to_pylist()
            order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, 0 if keys[i] is None else keys[i]))
            table, keys = table.take(pa.array(order, pa.int64())).combine_chunks(), [keys[i] for i in order]
            terms, tf = (table[c].combine_chunks() for c in ("terms", "tf"))
            owner = np.repeat(np.arange(len(keys)), pc.list_value_length(terms).to_numpy())
            m = length_factors(table["n"].to_numpy(), n_docs, all_terms)
            index = Shard(owner, terms.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64), m)
            for q, query in enumerate(queries):
                threshold = best[q][-1][0] if len(best[q]) == k else 0
                found = [(int(s), keys[d]) for d, s in zip(*index.top(query, threshold, k))]
                if found:
                    best[q] = sorted(best[q] + found, key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1]))[:k]

        for batch in batches:
            key_type = batch.schema.field(0).type
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column(2)), 0))
            if batch.num_rows:
                held.append(batch)
                size += len(batch.column(2).flatten())
            if size > shard:
                ask()
                held, size = [], 0
        if held:
            ask()
        found = [(q, name, score) for q, some in enumerate(best) for score, name in some]
        if found:
            columns = [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], key_type), pa.array([f[2] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "key", "score"])

    heaps = rows.select("key", "n", "terms", "tf").mapInArrow(answer, f"query int, key {kind}, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    merged = heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(q, name) for q, (name, _) in enumerate(block)], f"query int, item {items.schema[item].dataType.simpleString()}")
    answered = merged.join(F.broadcast(names), "query")  # the block's queries, bounded by their characters
    return answered.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
