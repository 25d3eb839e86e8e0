"""Audit how the sources of a language differ in their words.

Terms are counted per language and source.  A language keeps the terms found in at
least ``min_docs`` of its documents; every group (language, source) gives each kept
term a smoothed probability p in billionths.  Two groups, or a group and its whole
language with probabilities q, differ by floor((p - q)^2 / q) at a term.

Terms of a group by that value, greatest first: the value rises with the term's count
in the group and falls with its count in the language, and equal values go by UTF-8.
So a term that k others dominate in all three (count at least as high, count in the
language at most as high, earlier in UTF-8) is not among the first k.  Each partition
drops the terms that k others of the same partition dominate; what is left, the
partitions' skybands, is merged in two steps by the same rule, and only the terms of a
group's merged skyband are ranked by their exact values.

Sources with each other: the sum over all terms is cut into what each of the two would
give if no term were shared, which follows from the distinct counts of a group, and a
correction for terms that both have.  The corrections are summed as matrices over a
block of sources in each task, so no row is made for a term and a pair of sources.
Beyond ``block`` sources of a language, each pair of blocks has matrices of its own.

All arithmetic is in 64-bit integers and exact up to 9e15 terms of a language.

Defined cases: a null text, language or source reads as ''; a text without terms
counts for no term but its group occurs; rows are documents one by one, so repeated rows
count repeatedly; long texts are counted whole, a chunk of rows at a time; equal values
are ranked by the item's UTF-8; an empty table gives no rows; a language without kept
terms has pairs of value 0; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.terms import LETTERS, chunks, counted
from tagloom.session import staged

#: Documents of a language that hold a kept term, at least; ranks of terms in the report.
MIN_DOCS, RANKS = 3, 200
#: Sources of a block; rows for each salt of a pair of blocks; parts that merge a group's skyband first.
BLOCK, SALT_ROWS, MERGES = 256, 100_000, 16
#: Points compared at once, and rows gathered between two prunings of a skyband.
TILE, GATHERED = 1024, 20_000


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of a term in a group, and documents that hold it."""
    read = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, 2)):
            rows, codes, counts, terms = counted(batch.column(2), LETTERS)
            langs, sources = (batch.column(i).dictionary_encode() for i in (0, 1))
            group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            base = max(1, len(terms))
            keys, places, holding = np.unique(group[rows] * base + codes, return_inverse=True, return_counts=True)
            occurrences = np.bincount(places, counts, len(keys)).astype(np.int64)
            group, code = np.divmod(keys, base)
            a, b = np.divmod(group, max(1, len(sources.dictionary)))
            columns = [langs.dictionary.take(pa.array(a)), sources.dictionary.take(pa.array(b)), terms.take(pa.array(code)).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(occurrences), pa.array(holding.astype(np.int64))], names=["lang", "source", "term", "n", "docs"])

    tallied = read.mapInArrow(tally, "lang string, source string, term string, n long, docs long")
    return tallied.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def billionths(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / total), three digits at a time, so that products stay small."""
    out, rest = F.lit(0).cast("long"), count + 1
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + integral(rest, total), rest % total
    return out + 1


def integral(a: Column, b: Column) -> Column:
    """Whole division of longs that are not negative."""
    return F.call_function("div", a, b)


def difference(p: Column, q: Column) -> Column:
    return integral((p - q) * (p - q), q)


def by_runs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Slices of equal values in the first n columns, of rows that come in runs; True where a run begins."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for i in range(n):
            column = batch.column(i)
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for at, end in zip(cuts, cuts[1:]):
            key = tuple(batch.column(i)[at].as_py() for i in range(n))
            yield key != before, batch.slice(at, end - at)
            before = key


def skyband(high: np.ndarray, low: np.ndarray, early: np.ndarray, k: int) -> np.ndarray:
    """Places of the points that fewer than k others dominate: at least as high, at most as low, earlier.

    Points are taken from the highest on, so that all that may dominate a point come
    before it.  Of a point's dominators the first k are in the skyband themselves, so it
    is enough to count those kept so far.
    """
    order = np.lexsort((early, low, -high))
    low, early = low[order], early[order]
    kept = np.zeros(0, np.int64)
    before = np.triu(np.ones((TILE, TILE), bool), 1)
    for at in range(0, len(order), TILE):
        tile = np.arange(at, min(at + TILE, len(order)))
        within = (low[tile][:, None] <= low[tile]) & (early[tile][:, None] < early[tile]) & before[: len(tile), : len(tile)]
        dominators = within.sum(0)
        for start in range(0, len(kept), TILE):
            some = kept[start : start + TILE]
            open_ = np.flatnonzero(dominators < k)
            if not len(open_):
                break
            dominators[open_] += ((low[some][:, None] <= low[tile[open_]]) & (early[some][:, None] < early[tile[open_]])).sum(0)
        kept = np.concatenate([kept, tile[dominators < k]])
    return order[kept]


def skybands(rows: DataFrame, k: int, gathered: int = GATHERED) -> DataFrame:
    """``rows`` (lang, source, term, n, total) that fewer than k others of their group and partition dominate.

    A group's rows are read in order of the group, and no more than its skyband and
    ``gathered`` rows are held at once.
    """

    def pruned(parts: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(parts).combine_chunks()
        if table.num_rows <= k:
            return table
        early = np.empty(table.num_rows, np.int64)
        early[pc.sort_indices(table["term"].cast(pa.binary())).to_numpy()] = np.arange(table.num_rows)
        return table.take(pa.array(np.sort(skyband(table["n"].to_numpy(), table["total"].to_numpy(), early, k))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, limit = [], 0, gathered
        for new, part in by_runs(batches, 2):
            if new and held:
                yield from pruned(held).to_batches()
                held, size, limit = [], 0, gathered
            held.append(part)
            size += part.num_rows
            if size > limit:
                left = pruned(held)
                held, size = left.to_batches(), left.num_rows
                limit = 2 * size + gathered
        if held:
            yield from pruned(held).to_batches()

    return rows.sortWithinPartitions("lang", "source").mapInArrow(run, rows.schema)


def shared_corrections(p: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """For each pair of sources, what their shared terms change.

    ``p`` has a row per term, a column per source, and 0 where the source lacks the term;
    ``zero`` is what a source gives to a term it lacks.
    """

    def f(p, q):
        return (p - q) ** 2 // q

    full = np.where(p > 0, p, zero)
    out = np.zeros((len(zero), len(zero)), np.int64)
    for a in range(len(zero)):
        has = p[:, a] > 0
        own, other = p[has, a][:, None], full[has]
        out[a] = (f(own, other) - f(own, zero) - f(zero[a], other) + f(zero[a], zero)).sum(0)
    return out


def pair_corrections(rows: DataFrame, salts: int, gathered: int = GATHERED) -> DataFrame:
    """``lang, source, item, shared``: corrections of the pairs of sources that share terms."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    own = F.pmod(F.xxhash64("source"), F.col("blocks"))
    placed = rows.select("lang", "source", "term", "p", "zero", own.alias("own"), other.alias("other")).select(
        "lang", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.col("own"), "term", "source", "p", "zero"
    )

    def sums(rows: list[pa.RecordBatch], totals: dict) -> None:
        table = pa.Table.from_batches(rows).combine_chunks()
        terms, sources = (table[c].combine_chunks().dictionary_encode() for c in ("term", "source"))
        t, s = terms.indices.to_numpy(), sources.indices.to_numpy()
        p = np.zeros((len(terms.dictionary), len(sources.dictionary)), np.int64)
        p[t, s] = table["p"].to_numpy()
        zero, block = np.zeros((2, p.shape[1]), np.int64)
        zero[s], block[s] = table["zero"].to_numpy(), table["own"].to_numpy()
        found = shared_corrections(p, zero)
        apart = table["x"][0].as_py() != table["y"][0].as_py()
        names = sources.dictionary.to_pylist()
        for a, b in zip(*np.nonzero(found)):
            if a != b and (not apart or block[a] != block[b]):
                totals[names[a], names[b]] = totals.get((names[a], names[b]), 0) + int(found[a, b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, totals, lang = [], 0, {}, None

        def out() -> pa.RecordBatch:
            pairs = list(totals)
            columns = [pa.array([lang] * len(pairs), pa.string()), pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(list(totals.values()), pa.int64())], names=["lang", "source", "item", "shared"])

        for new, part in by_runs(batches, 3):  # lang, x, y
            if new and lang is not None:
                sums(held, totals)
                yield out()
                held, size, totals = [], 0, {}
            lang = part.column(0)[0].as_py()
            held.append(part)
            size += part.num_rows
            if size > gathered:  # the last term may go on
                table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                last = pc.not_equal(table.column(4), table.column(4)[-1])
                cut = pc.sum(last).as_py() or 0
                if cut:
                    sums([table.slice(0, cut)], totals)
                held, size = [table.slice(cut)], table.num_rows - cut
        if held:
            sums(held, totals)
            yield out()

    salt = F.pmod(F.xxhash64("term"), F.lit(salts))
    dealt = placed.repartition("lang", "x", "y", salt).sortWithinPartitions("lang", "x", "y", "term")
    return dealt.mapInArrow(run, "lang string, source string, item string, shared long").groupBy("lang", "source", "item").agg(F.sum("shared").alias("shared"))


def audit(docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, ranks: int = RANKS, block: int = BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank``: sources of a language by their difference from a source, terms by theirs."""
    every = staged(term_counts(docs, lang, source, text), "term-counts")
    by_lang = every.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    kept = by_lang.where(F.col("docs") >= min_docs).select("lang", "term", "total")
    rows = staged(every.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "kept-terms")

    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]).distinct()
    sizes = rows.groupBy("lang", "source").agg(F.sum("n").alias("group_size"))
    terms = rows.groupBy("lang", "term").agg(F.first("total").alias("total"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_size"))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
    filled = groups.join(blocks, "lang").join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").fillna(0, ["terms", "lang_size", "group_size"])
    whole = F.col("group_size") + F.col("terms")
    zero = F.when(F.col("terms") > 0, billionths(F.lit(0).cast("long"), F.greatest(whole, F.lit(1))))
    groups = staged(filled.withColumn("zero", zero), "groups")

    counted = rows.join(groups, ["lang", "source"]).withColumn("p", billionths(F.col("n"), whole))
    counted = counted.withColumn("q", billionths(F.col("total"), F.col("lang_size") + F.col("terms")))
    return _pairs(counted, groups, rows).unionByName(_terms(counted, ranks))


def _terms(counted: DataFrame, ranks: int) -> DataFrame:
    raised = counted.where(F.col("p") > F.col("q")).select("lang", "source", "term", "n", "total", "p", "q")
    bands = skybands(raised, ranks)
    for part in (F.pmod(F.xxhash64("term"), F.lit(MERGES)), F.lit(0)):
        bands = skybands(bands.repartition("lang", "source", part), ranks)
    return _ranked(bands.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))).where(F.col("rank") <= ranks)


def _pairs(counted: DataFrame, groups: DataFrame, rows: DataFrame) -> DataFrame:
    salts = 1 + rows.count() // SALT_ROWS
    shared = pair_corrections(counted, salts)
    steps = counted.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    steps = steps.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("steps"))
    own = groups.join(steps, ["lang", "source"], "left").select("lang", "source", "terms", "zero", "steps")
    a = own.withColumnsRenamed({"zero": "za", "steps": "sa"})
    b = own.drop("terms").withColumnsRenamed({"source": "item", "zero": "zb", "steps": "sb"})
    both = a.join(b, (a["lang"] == b["lang"]) & (a["source"] != b["item"])).drop(b["lang"])
    bare = difference(F.col("za"), F.col("zb"))

    def alone(steps: str, f: Callable[[Column], Column]) -> Column:
        gain = F.aggregate(steps, F.lit(0).cast("long"), lambda sum_, step: sum_ + step["n"] * f(step["p"]))
        return F.coalesce(gain, F.lit(0).cast("long"))

    value = F.col("terms") * bare
    value += alone("sa", lambda p: difference(p, F.col("zb")) - bare) + alone("sb", lambda q: difference(F.col("za"), q) - bare)
    found = both.join(shared, ["lang", "source", "item"], "left")
    total = F.when(F.col("terms") == 0, F.lit(0).cast("long")).otherwise(value + F.coalesce("shared", F.lit(0).cast("long")))
    return _ranked(found.select("lang", "source", F.lit("pair").alias("part"), "item", total.alias("value")))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))
