"""Pooled linear and ridge regression by block elimination.

The design has an intercept, scaled numeric columns, a slot per value of columns with
few values, and a slot per value of one column with any number of values (the tag).  A
row has one tag, so the tags' block of the normal equations is diagonal: its entry is the
tag's row count plus the penalty.  One aggregate sums the products of the small columns over
all rows, one grouped aggregate sums rows, columns and targets per tag; from these sums the
tags are eliminated,

    effect(tag) = (sum of targets - sums of the small columns * weights) / (rows + alpha),

which leaves a system of the small columns alone (the Schur complement).  It is summed
over the tags by Spark for all penalties in one job, and only it is solved on the driver.
The tags' effects stay a table, however many there are.

Without a penalty the equations have many solutions, since slots sum to one and columns
may repeat each other.  The one of least norm is taken (the intercept is free), as the
limit of ever smaller penalties; its free directions are the null vectors of the small
system, and how long the effects become along them follows from two more sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tagloom.operators.counts import most_frequent
from tagloom.operators.scaling import Scaling, fit_scaling
from tagloom.session import staged
from tagloom.sources.tables import CATEGORICAL_FEATURES, NUMERIC_FEATURES, TARGET

#: Columns of the small system; it has about half their square in sums.
SMALL_BLOCK = 64
#: Eigenvalues of the small system below this share of its largest entry count as zero.
NULL_SHARE = 1e-10


def category_fills(train: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """What stands for a missing category: the most frequent one of the train rows."""
    found = {c: most_frequent(train, c).first() for c in columns}
    return {c: "unknown" if row is None else str(row[c]) for c, row in found.items()}


@dataclass(frozen=True)
class Design:
    """Small columns, and the column whose effects are eliminated."""

    scaling: Scaling
    levels: dict[str, tuple[str, ...]]
    eliminated: str
    fills: dict[str, str]

    @property
    def names(self) -> list[str]:
        slots = [f"{c}={v}" for c, values in self.levels.items() for v in values]
        return ["intercept", *self.scaling.medians, *slots]

    def category(self, column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(self.fills[column]))

    def columns(self) -> list[Column]:
        numeric = [self.scaling.scaled(c) for c in self.scaling.medians]
        slots = [(self.category(c) == v).cast("double") for c, values in self.levels.items() for v in values]
        return [F.lit(1.0), *numeric, *slots]

    @property
    def penalised(self) -> np.ndarray:
        return np.array([0.0] + [1.0] * (len(self.names) - 1))


def design_of(
    train: DataFrame, numeric: Sequence[str] = NUMERIC_FEATURES, categorical: Sequence[str] = CATEGORICAL_FEATURES
) -> Design:
    """Fit the scaling and list the levels; the first categorical column is the one eliminated."""
    eliminated, *few = categorical
    room = SMALL_BLOCK - 1 - len(numeric)
    levels = {}
    for column in few:
        found = train.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).distinct().limit(room + 1)
        levels[column] = tuple(sorted(r.v for r in found.collect()))
    if sum(map(len, levels.values())) > room:
        raise ValueError(f"{few} have more than {room} values: name the one with most of them first")
    return Design(fit_scaling(train, numeric), levels, eliminated, category_fills(train, categorical))


def tag_sums(train: DataFrame, design: Design, target: str = TARGET) -> DataFrame:
    """``key, n, s, r``: per eliminated value the sums of columns and targets."""
    rows = _design_rows(train, design, target)
    sums = rows.groupBy("key").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.array(*[F.sum(f"z{i}") for i in range(len(design.names))]).alias("s"),
        F.sum("y").alias("r"),
    )
    return staged(sums, "tag-sums")


def total_products(train: DataFrame, design: Design, target: str = TARGET) -> Row:
    """``cross, c``: the products of the small columns, and of these and the target, summed over all rows."""
    m = len(design.names)
    z = [F.col(f"z{i}") for i in range(m)]
    cross = F.array(*[F.sum(z[i] * z[j]) for i, j in _upper(m)])
    return _design_rows(train, design, target).agg(cross.alias("cross"), F.array(*[F.sum(x * F.col("y")) for x in z]).alias("c")).first()


def _design_rows(train: DataFrame, design: Design, target: str) -> DataFrame:
    """``key, y, z0, z1, ...`` of the rows with a target."""
    named = [c.alias(f"z{i}") for i, c in enumerate(design.columns())]
    rows = train.select(design.category(design.eliminated).alias("key"), F.col(target).cast("double").alias("y"), *named)
    return rows.where(F.col("y").isNotNull())


def _upper(m: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(m) for j in range(i, m)]


def _square(m: int, upper: Sequence[float]) -> np.ndarray:
    out = np.zeros((m, m))
    for (i, j), value in zip(_upper(m), upper):
        out[i, j] = out[j, i] = value
    return out


def _products(m: int, weight: Column, names: str) -> list[Column]:
    """Sums over the tags of s s' and s r, each tag weighted."""
    s, r = F.col("s"), F.col("r")
    upper = F.array(*[F.sum(s[i] * s[j] * weight) for i, j in _upper(m)])
    return [upper.alias(f"{names}_ss"), F.array(*[F.sum(s[i] * r * weight) for i in range(m)]).alias(f"{names}_sr")]


@dataclass(frozen=True)
class PooledFit:
    """Weights of the small columns, and the sums that give every tag's effect."""

    design: Design
    alpha: float
    weights: tuple[float, ...]
    sums: DataFrame

    def effect(self) -> Column:
        """A tag's effect, on a row of the sums."""
        pulled = reduce(add, [F.col("s")[i] * w for i, w in enumerate(self.weights)])
        return (F.col("r") - pulled) / (F.col("n") + self.alpha)

    def small_part(self) -> Column:
        return reduce(add, [c * w for c, w in zip(self.design.columns(), self.weights)])


def solve(design: Design, alpha: float, products: Row, total: Row, names: str) -> np.ndarray:
    """Weights of the small columns from the sums over all rows and over all tags."""
    m = len(design.names)
    penalty = np.diag(alpha * design.penalised)
    cross = _square(m, products["cross"])
    left = cross + penalty - _square(m, total[f"{names}_ss"])
    right = np.array(products["c"]) - np.array(total[f"{names}_sr"])
    if alpha > 0:
        return np.linalg.solve(left, right)
    values, vectors = np.linalg.eigh(left)
    free = values <= NULL_SHARE * max(np.abs(np.diag(cross)).max(), 1e-300)
    held = vectors[:, ~free]
    weights = held @ ((held.T @ right) / values[~free])
    null = vectors[:, free]
    if not null.shape[1]:
        return weights
    # norm of weights and effects along the null vectors; effects change by -s * direction / n
    length = np.diag(design.penalised) + _square(m, total["norm_ss"])
    pull = length @ weights - np.array(total["norm_sr"])
    return weights - null @ np.linalg.solve(null.T @ length @ null, null.T @ pull)


def fit_pooled(train: DataFrame, alphas: Mapping[str, float], design: Design | None = None, target: str = TARGET) -> dict[str, PooledFit]:
    """A fit for each named penalty (0 is least squares), all from the same sums."""
    design = design or design_of(train)
    m = len(design.names)
    products = total_products(train, design, target)
    if products["c"][0] is None:
        raise ValueError("no train rows with a target")
    sums = tag_sums(train, design, target)
    numbered = {name: f"a{i}" for i, name in enumerate(alphas)}
    wanted = []
    for name, alpha in alphas.items():
        wanted += _products(m, 1 / (F.col("n") + float(alpha)), numbered[name])
    if 0 in alphas.values():
        wanted += _products(m, 1 / (F.col("n") * F.col("n")), "norm")
    total = sums.agg(*wanted).first()
    return {
        name: PooledFit(design, float(alpha), tuple(solve(design, float(alpha), products, total, numbered[name]).tolist()), sums)
        for name, alpha in alphas.items()
    }


def with_predictions(df: DataFrame, fits: Mapping[str, PooledFit]) -> DataFrame:
    """``df`` and a column per fit; a tag that was not seen has no effect.  One join serves all fits of the same sums."""
    fits = dict(fits)
    one = next(iter(fits.values()))
    effects = one.sums.select(F.col("key").alias("_key"), *[fit.effect().alias(f"_effect_{i}") for i, fit in enumerate(fits.values())])
    joined = df.withColumn("_key", one.design.category(one.design.eliminated)).join(effects, "_key", "left")
    scored = {name: fit.small_part() + F.coalesce(F.col(f"_effect_{i}"), F.lit(0.0)) for i, (name, fit) in enumerate(fits.items())}
    return joined.withColumns(scored).drop("_key", *[f"_effect_{i}" for i in range(len(fits))])


def optimum_gaps(train: DataFrame, fit: PooledFit, target: str = TARGET) -> DataFrame:
    """``feature, imbalance``: how far a fit is from its optimum, per column and per tag.

    At the optimum the residuals weighted by a column sum to alpha times its weight.  The
    difference is taken relative to the residuals of the rows that have the column, or to
    what such rows have on average.
    """
    design = fit.design
    scored = with_predictions(train.where(F.col(target).isNotNull()), {"_raw": fit})
    z = design.columns()
    rows = scored.select(
        design.category(design.eliminated).alias("key"),
        (F.col(target) - F.col("_raw")).alias("gap"),
        *[c.alias(f"z{i}") for i, c in enumerate(z)],
    )
    rows = staged(rows, "gaps")
    typical = rows.agg(F.avg(F.abs("gap"))).scalar()

    def imbalance(pull: Column, weight: Column, size: Column, n: Column) -> Column:
        return F.abs(pull - fit.alpha * weight) / (size + n * F.col("_typical") + 1e-300)

    def sums(x: Column) -> list[Column]:
        there = x != 0
        return [F.sum(x * F.col("gap")), F.sum(F.when(there, F.abs(x * F.col("gap")))), F.count_if(there)]

    entries = [
        F.struct(F.lit(name).alias("feature"), *[c.alias(a) for c, a in zip(sums(F.col(f"z{i}")), ("pull", "size", "n"))], F.lit(weight).alias("weight"))
        for i, (name, weight) in enumerate(zip(design.names, fit.weights))
    ]
    free = F.when(F.col("feature") == "intercept", 0.0).otherwise(F.col("weight"))
    small = rows.agg(F.array(*entries).alias("e")).select(F.inline("e")).withColumn("_typical", typical)
    small = small.select("feature", imbalance(F.col("pull"), free, F.coalesce("size", F.lit(0.0)), F.col("n")).alias("imbalance"))
    pulls = rows.groupBy("key").agg(F.sum("gap").alias("pull"), F.sum(F.abs("gap")).alias("size"), F.count(F.lit(1)).alias("n"))
    effects = fit.sums.select("key", fit.effect().alias("weight"))
    tags = pulls.join(effects, "key").withColumn("_typical", typical)
    name = F.concat(F.lit(f"{design.eliminated}="), "key")
    tags = tags.select(name.alias("feature"), imbalance(F.col("pull"), F.col("weight"), F.col("size"), F.col("n")).alias("imbalance"))
    return small.unionByName(tags)
