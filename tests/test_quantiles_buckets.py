from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagloom.operators import buckets, quantiles as qt, scaling
from tagloom.session import staged

PROBABILITIES = [0, 0.1, 0.25, 0.5, 0.98, 1]


def frame(spark, groups: dict[str, np.ndarray]):
    pdf = pd.concat([pd.DataFrame({"g": g, "x": v}) for g, v in groups.items()])
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("limit, starts", [(1, 12), (20, 16), (100, 256), (qt.LIMIT, qt.STARTS)])
def test_exact_quantiles(spark, limit, starts):
    rng = np.random.default_rng(3)
    groups = {
        "ties": rng.integers(0, 5, 700).astype(float),
        "wide": rng.normal(size=501) * 1e6,
        "one": np.array([4.5]),
        "hot": np.concatenate([np.zeros(900), rng.random(50)]),
    }
    got = qt.exact_quantiles(frame(spark, groups), "x", PROBABILITIES, ["g"], limit, starts).collect()
    assert {r["g"] for r in got} == set(groups)
    for r in got:
        np.testing.assert_allclose(r["quantiles"], np.quantile(groups[r["g"]], PROBABILITIES), rtol=1e-12)


def test_quantiles_skip_missing_values_and_empty_tables(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    assert qt.exact_quantiles(df, "x", [0.5]).first()["quantiles"] == [2.0]
    assert qt.exact_quantiles(df.where("false"), "x", [0.5]).first()["quantiles"] == [None]


def jobs_of(spark, work) -> int:
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    work()
    return len(tracker.getJobIdsForGroup(None)) - before


def test_quantile_of_many_distinct_values(spark):
    df = spark.range(20_000).selectExpr("cast(id as double) AS x")
    plan = qt.exact_quantiles(df, "x", [0.5])
    assert plan.first()["quantiles"] == [9999.5]


def test_a_range_is_refined_until_it_fits(spark):
    df = spark.range(30_000).selectExpr("pow(1.002, id) * if(id % 2 = 0, 1, -1) AS x", "id % 2 AS g", "id AS y")
    want = np.quantile([1.002**i * (1 if i % 2 == 0 else -1) for i in range(30_000)], [0.25, 0.5])
    np.testing.assert_allclose(qt.exact_quantiles(df, "x", [0.25, 0.5], limit=50, starts=40).first()["quantiles"], want, rtol=1e-12)
    found = qt.exact_quantiles(df, "y", [0.5], ["g"], limit=1000)
    assert {r["g"]: r["quantiles"] for r in found.collect()} == {0: [14999.0], 1: [15000.0]}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Range (0, 30000" not in plan  # the input was read once, before


def test_few_jobs_where_no_range_is_large(spark):
    df = staged(spark.range(5000).selectExpr("cast(id % 700 AS double) AS a", "cast(id AS double) AS b"), "columns")
    assert jobs_of(spark, lambda: scaling.column_medians(df, ["a", "b"]).collect()) <= 5


@pytest.mark.parametrize(
    "values", [[1, 1, 1, 2, 3, 5, 8, 13], [1, 1, 1, 1, 2], list(range(17)), [2, 2, 9, 9], [0.1, 0.2, 0.3, 0.7]]
)
def test_quantile_buckets_equal_qcut(spark, values):
    want = pd.qcut(pd.Series(values, dtype=float), q=4, duplicates="drop")
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double")
    got = buckets.quantile_buckets(df, "x").orderBy("i").collect()
    assert [r["bucket"] for r in got] == want.cat.codes.tolist()


def test_quantile_fixture_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 2, 3, 5, 8, 13]], "x double")
    assert buckets.quantile_edges(df, "x").first()["edges"] == [1.0, 2.5, 5.75, 13.0]


def test_constant_column_has_no_quantile_bucket(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert buckets.quantile_buckets(df, "x").where("bucket is not null").isEmpty()


@pytest.mark.parametrize("values", [[1, 1, 1, 2, 3, 5, 8, 13], [5.0], [0.0, 0.0], [-3.0, -3.0], list(range(9))])
def test_equal_width_buckets_equal_cut(spark, values):
    want = pd.cut(pd.Series(values, dtype=float), bins=4)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double")
    got = buckets.equal_width_buckets(df, "x").orderBy("i").collect()
    assert [r["bucket"] for r in got] == want.cat.codes.tolist()


@pytest.mark.parametrize("bins", [5, 30, 35])
def test_histogram_equals_numpy(spark, bins):
    rng = np.random.default_rng(11)
    values = np.concatenate([rng.normal(size=400), np.linspace(-2, 2, bins + 1), [3.5]])
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    got = buckets.histogram(df, "x", bins).orderBy("bin").collect()
    want, edges = np.histogram(values, bins=bins)
    assert [r["rows"] for r in got] == want.tolist()
    np.testing.assert_allclose([r["lo"] for r in got] + [got[-1]["hi"]], edges)


def test_histogram_of_a_constant(spark):
    got = buckets.histogram(spark.createDataFrame([(2.0,)] * 3, "x double"), "x", 4).orderBy("bin").collect()
    want, edges = np.histogram([2.0] * 3, bins=4)
    assert [r["rows"] for r in got] == want.tolist() and got[0]["lo"] == edges[0] and got[-1]["hi"] == edges[-1]


def test_box_plot(spark):
    values = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 100], dtype=float)
    row = buckets.box_plot(frame(spark, {"a": values}), "x", ["g"], groups=1).first()
    q1, median, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    assert (row["q1"], row["median"], row["q3"], row["whisker_low"], row["whisker_high"]) == (q1, median, q3, 1.0, 9.0)


def test_describe_equals_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=101), "b": rng.integers(0, 9, 101).astype(float)})
    want = pdf.describe().T
    for r in qt.describe_columns(spark.createDataFrame(pdf), ["a", "b"]).collect():
        have = [r[c] for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")]
        np.testing.assert_allclose(have, want.loc[r["measure"]].to_numpy())


def test_scaling_uses_train_medians_and_population_std(spark):
    data = [("train", 1.0), ("train", 3.0), ("train", None), ("train", float("inf")), ("train", 10.0), ("test", 100.0)]
    df = spark.createDataFrame(data, "split string, x double").withColumn("flat", F.lit(2.0)).withColumn("none", F.lit(None).cast("double"))
    fitted = scaling.fit_scaling(df.where("split = 'train'"), ["x", "flat", "none"])
    filled = np.array([1, 3, 3, 3, 10.0])
    assert fitted.medians == {"x": 3.0, "flat": 2.0, "none": 0.0}
    assert fitted.means["x"] == pytest.approx(filled.mean()) and fitted.stds["x"] == pytest.approx(filled.std())
    assert fitted.stds["flat"] == fitted.stds["none"] == 1.0
    out = fitted.apply(df).where("split = 'test'").first()
    assert out["x_scaled"] == pytest.approx((100 - filled.mean()) / filled.std()) and out["flat_scaled"] == 0.0
