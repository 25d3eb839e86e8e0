"""Exact quantiles by counting and refinement.

``percentile`` keeps every distinct value of a group in one buffer, and the approximate
functions do not interpolate.  Here the input is read once to count its values, for all
columns and groups together (repeats collapse in each task).  The number of counted rows
comes with that write.  If it is small, each group's values are sorted and the wanted
ranks picked.  Otherwise ranges are refined, at first whole groups: values of a range,
picked by hash, cut it into cells (their number follows from the count), the cells' sizes
tell which of them hold a wanted rank, and only these go on, until a range has at most
``LIMIT`` different values.  So no sort holds more than that, whatever the distribution,
and one round is enough up to about ``LIMIT * STARTS / 4`` values of all large groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.session import broadcast_if_bounded, staged

#: Different values of a range that is sorted, and starts of cells that a round sends to all tasks.
LIMIT, STARTS = 1_000_000, 200_000


def counted_values(df: DataFrame, value: str, by: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """``*by, _v, _n`` written once, and how many rows that is; nulls and NaN are left out."""
    values = df.select(*by, F.col(value).cast("double").alias("_v"))
    rows = values.where(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    seen = Observation()
    return staged(rows.observe(seen, F.count(F.lit(1)).alias("rows")), "counted-values"), seen.get["rows"]


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    limit: int = LIMIT,
    starts: int = STARTS,
) -> DataFrame:
    """``quantiles``: array of linearly interpolated quantiles, one row per group.

    Nulls and NaN are left out.  Groups must be non-null in ``by``.
    """
    by = list(by)
    counted, n_rows = counted_values(df, value, by)
    if n_rows <= limit:
        return _picked(counted, probabilities, by)
    sizes = staged(counted.groupBy(*by).agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_d")), "group-sizes")
    large = sizes.where(F.col("_d") > limit)
    n_large, most = large.agg(F.count(F.lit(1)), F.max("_d")).first()
    if not n_large:
        return _picked(counted, probabilities, by)
    if not by:
        return _refined(counted, sizes, probabilities, by, limit, starts, (n_large, most))
    names = broadcast_if_bounded(large.select(*by), n_large)
    refined = _refined(counted.join(names, by, "left_semi"), large, probabilities, by, limit, starts, (n_large, most))
    return _picked(counted.join(names, by, "left_anti"), probabilities, by).unionByName(refined)


def _interpolated(probabilities: Sequence[float], at) -> Column:
    """``at(i, end)`` gives the value at the rank below (end 0) or above (end 1) probability i, and the fraction at end 2."""
    return F.array(*[at(i, 0) + (at(i, 1) - at(i, 0)) * at(i, 2) for i in range(len(probabilities))]).alias("quantiles")


def _place(total: Column, p: float) -> Column:
    return (total - 1) * F.lit(float(p))


def _picked(counted: DataFrame, probabilities: Sequence[float], by: list[str]) -> DataFrame:
    """Sort each group's counted values and take those at the wanted ranks."""
    whole = W.partitionBy(*by, F.lit(0))
    upto = F.sum("_n").over(whole.orderBy("_v"))
    ranked = counted.select(*by, "_v", (upto - F.col("_n")).alias("_from"), upto.alias("_upto"), F.sum("_n").over(whole).alias("_total"))

    def at(i: int, end: int) -> Column:
        place = _place(F.col("_total"), probabilities[i])
        if end == 2:
            return F.max(place - F.floor(place))
        rank = F.ceil(place) if end else F.floor(place)
        return F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_upto")), F.col("_v")))

    return ranked.groupBy(*by).agg(_interpolated(probabilities, at))


def _with_cells(rows: DataFrame, most: int) -> DataFrame:
    """``_cell``: how many of the sorted ``_starts`` are <= ``_v``, found by halving steps.

    Starts beyond about ``most`` share a cell.  Each step is a column of its own, so that
    all of them run in generated code.
    """
    rows = rows.withColumn("_cell", F.lit(0))
    for step in (2**k for k in range(most.bit_length(), -1, -1)):
        further = F.get("_starts", F.col("_cell") + step - 1) <= F.col("_v")
        rows = rows.withColumn("_cell", F.col("_cell") + F.when(further, step).otherwise(0))
    return rows


def _refined(
    counted: DataFrame, sizes: DataFrame, probabilities: Sequence[float], by: list[str], limit: int, starts: int, size: tuple[int, int]
) -> DataFrame:
    """Refine ranges until each has at most ``limit`` different values, then sort those.

    A range is named by the cells it came from; its targets are the ranks wanted in it.
    ``size`` has the number of ranges that are too large, and the values of the largest.
    """
    key = [*by, "_r"]
    ranks = [
        F.struct(F.lit(i).alias("i"), F.lit(end).alias("end"), rank(_place(F.col("_total"), p)).cast("long").alias("rank"),
                 (_place(F.col("_total"), p) - F.floor(_place(F.col("_total"), p))).alias("fraction"))
        for i, p in enumerate(probabilities) for end, rank in enumerate((F.floor, F.ceil))
    ]
    targets = sizes.select(*by, F.lit("").alias("_r"), F.col("_d"), F.inline(F.array(*ranks)))
    rows, done, turn = counted.withColumn("_r", F.lit("")), [], 0
    while size[0]:
        turn, n_open = turn + 1, size[0]
        cells = max(2, min(4 * -(-size[1] // limit), starts // n_open))
        held = broadcast_if_bounded(targets.where(F.col("_d") > limit).select(*key, "_d").distinct(), n_open)
        # each of a range's values starts a cell where it has few; another hash each turn
        picked = rows.join(held, key).where(F.pmod(F.xxhash64("_v", F.lit(turn)), F.ceil(F.col("_d") / cells)) == 0)
        found = picked.groupBy(*key).agg(F.array_sort(F.collect_set("_v")).alias("_starts"))
        found = staged(held.join(found, key, "left").select(*key, F.coalesce("_starts", F.array().cast("array<double>")).alias("_starts")), "range-starts")
        celled = _with_cells(rows.join(broadcast_if_bounded(found, n_open * cells // 2), key), 2 * cells)
        sums = celled.groupBy(*key, "_cell").agg(F.sum("_n").alias("_size"), F.count(F.lit(1)).alias("_d"))
        before = F.sum("_size").over(W.partitionBy(*key).orderBy("_cell")) - F.col("_size")
        inside = (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_size"))
        open_ = targets.where(F.col("_d") > limit).drop("_d")
        hit = open_.join(sums.withColumn("_before", before), key).where(inside).join(found, key)
        name = F.concat_ws(".", F.col("_r"), F.col("_cell").cast("string"))
        ends = [F.get("_starts", F.col("_cell") - 1).alias("_lo"), F.get("_starts", F.col("_cell")).alias("_hi")]
        last = F.col("_cell") >= sum(2**k for k in range((2 * cells).bit_length() + 1))  # all starts from here on
        ends[1] = F.when(~last, ends[1]).alias("_hi")
        hit = staged(hit.select(*key, "_cell", "_d", "i", "end", (F.col("rank") - F.col("_before")).alias("rank"), "fraction", *ends), "refined-ranks")
        kept = broadcast_if_bounded(hit.select(*key, "_cell", "_lo", "_hi").distinct(), 2 * len(probabilities) * n_open)
        between = F.coalesce(F.col("_v") >= F.col("_lo"), F.lit(True)) & F.coalesce(F.col("_v") < F.col("_hi"), F.lit(True))
        rows = staged(rows.join(kept, key).where(between).select(*by, name.alias("_r"), "_v", "_n"), "range-rows")
        targets = hit.select(*by, name.alias("_r"), "_d", "i", "end", "rank", "fraction")
        done.append(rows.join(targets.where(F.col("_d") <= limit), key))
        large = targets.where(F.col("_d") > limit)
        size = large.agg(F.count_distinct(*key), F.max("_d")).first()
    placed = [
        df.withColumn("_upto", F.sum("_n").over(W.partitionBy(*key, "i", "end").orderBy("_v"))) for df in done
    ]
    found = reduce(DataFrame.unionByName, placed)
    found = found.where((F.col("rank") >= F.col("_upto") - F.col("_n")) & (F.col("rank") < F.col("_upto")))

    def at(i: int, end: int) -> Column:
        if end == 2:
            return F.max(F.when(F.col("i") == i, F.col("fraction")))
        return F.max(F.when((F.col("i") == i) & (F.col("end") == end), F.col("_v")))

    return found.groupBy(*by).agg(_interpolated(probabilities, at))


def global_quantile(df: DataFrame, value: str, probability: float) -> Column:
    """One quantile of a whole column, as a one-row subquery."""
    return exact_quantiles(df, value, [probability]).select(F.get("quantiles", F.lit(0))).scalar()


def measure_summary(df: DataFrame, measures: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean and median of several measures per group, in long form."""
    keys = [*by, "measure"]
    long = unpivoted(df, measures, by)
    plain = long.groupBy(*keys).agg(F.count("value").alias("count"), F.avg("value").alias("mean"))
    median = exact_quantiles(long, "value", [0.5], keys)
    return plain.join(median, keys, "left").select(
        *keys, "count", "mean", F.get("quantiles", F.lit(0)).alias("median")
    )


def unpivoted(df: DataFrame, measures: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``measure, value`` rows of several numeric columns."""
    doubles = df.select(*by, *[F.col(m).cast("double").alias(m) for m in measures])
    return doubles.unpivot(list(by), list(measures), "measure", "value")


def describe_columns(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, quartiles and max per column."""
    long = unpivoted(df, measures)
    plain = long.groupBy("measure").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["measure"])
    joined = plain.join(quartiles, "measure", "left")
    q = lambda i: F.get("quantiles", F.lit(i))
    return joined.select(
        "measure", "count", "mean", "std", "min",
        q(0).alias("q25"), q(1).alias("q50"), q(2).alias("q75"), "max",
    )
