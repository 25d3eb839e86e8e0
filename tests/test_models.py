from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import forecasts as fc, models as ml, pooled, scaling
from tagloom.plans import forecasting
from tagloom.plans.feature_table import PanelSettings, feature_table
from tagloom.session import staged
from tagloom.sources.tables import NUMERIC_FEATURES, TARGET
from tests.conftest import rows


@pytest.fixture(scope="module")
def features(spark):
    """Six tags on forty dates with a weekly rhythm."""
    counts = spark.range(240).selectExpr(
        "date_add(DATE'2020-04-09', cast(id div 6 as int)) AS date",
        "concat(if(id % 2 = 0, '#t', '$T'), id % 6) AS tag",
        "if(id % 2 = 0, 'hashtag', 'cashtag') AS tag_type",
        "cast(10 * (id % 6 + 1) + 5 * ((id div 6) % 7) + pmod(xxhash64(id), 9) as long) AS count",
    )
    settings = PanelSettings(top_n=3, min_observed_days=30, train_dates=28, validation_dates=5)
    return staged(feature_table(counts, settings), "features")


@pytest.fixture(scope="module")
def modeling(features):
    return features.where("modeling_ready")


def design(modeling, preparation):
    """Numpy matrices of the prepared rows, sorted by key."""
    from pyspark.ml.functions import vector_to_array

    rows = preparation.apply(modeling).orderBy("tag_type", "tag", "date").select("split", TARGET, vector_to_array("features").alias("x")).collect()
    split = np.array([r["split"] for r in rows])
    return split, np.array([r["x"] for r in rows]), np.array([r[TARGET] for r in rows])


@pytest.mark.parametrize("kind, alpha", [("linear_regression", 0.0), ("ridge", 10.0)])
def test_linear_models_equal_the_closed_form(modeling, kind, alpha):
    config = next(c for c in ml.MODEL_CONFIGS if c.kind == kind)
    preparation = ml.prepare(modeling.where("split = 'train'"))
    split, x, y = design(modeling, preparation)
    train = split == "train"
    xm, ym = x[train].mean(axis=0), y[train].mean()
    centred = x[train] - xm
    weights = np.linalg.pinv(centred.T @ centred + alpha * np.eye(x.shape[1])) @ centred.T @ (y[train] - ym)
    want = np.clip((x - xm) @ weights + ym, 0, None)[~train]
    fitted = ml.fit_models(modeling, [config])
    got = [r["prediction"] for r in fitted.predictions.orderBy("tag_type", "tag", "date").collect()]
    np.testing.assert_allclose(got, want, atol=1e-4)
    assert set(fitted.seconds) == {config.name}


def test_preparation_equals_numpy(modeling):
    preparation = ml.prepare(modeling.where("split = 'train'"))
    split, x, _ = design(modeling, preparation)
    assert x.shape[1] == len(NUMERIC_FEATURES) + 6 + 2
    numeric = x[split == "train"][:, : len(NUMERIC_FEATURES)]
    np.testing.assert_allclose(numeric.mean(axis=0), 0, atol=1e-9)
    np.testing.assert_allclose(numeric.std(axis=0), 1, atol=1e-9)
    assert (x[:, len(NUMERIC_FEATURES):].sum(axis=1) == 2).all()


@pytest.mark.parametrize("alpha", [0.0, 0.5, 10.0])
def test_block_elimination_equals_the_whole_system(spark, alpha):
    """Also where columns repeat each other, tags occur once, categories are missing and new tags are scored."""
    rnd = np.random.default_rng(4)
    rows = []
    for i in range(400):
        tag = None if i % 50 == 0 else f"t{rnd.integers(0, 60)}"
        a, b = (None if rnd.random() < 0.05 else float(x) for x in rnd.normal(size=2))
        rows.append((tag, ["u", "v", None][rnd.integers(0, 3)], a, b, None if a is None or b is None else a - b, float(rnd.normal() + i % 7)))
    table = spark.createDataFrame(rows, "tag string, tag_type string, a double, b double, c double, y double")
    train, new = table, table.withColumn("tag", F.lit("new"))
    design = pooled.design_of(train, ["a", "b", "c"])
    fit = pooled.fit_pooled(train, {"m": alpha}, design, "y")["m"]

    from collections import Counter

    fill = [min(v for v, n in c.items() if n == max(c.values())) for c in (Counter(r[k] for r in rows if r[k] is not None) for k in (0, 1))]
    assert design.fills == {"tag": fill[0], "tag_type": fill[1]}
    x = np.array([[np.nan if v is None else v for v in r[2:5]] for r in rows])
    x = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    tags, types = ([r[k] or fill[k] for r in rows] for k in (0, 1))
    names = sorted(set(tags))
    whole = np.hstack([x, [[t == n for n in ("u", "v")] for t in types], [[t == n for n in names] for t in tags]]).astype(float)
    y = np.array([r[5] for r in rows])
    centred, mean = whole - whole.mean(axis=0), whole.mean(axis=0)
    w = np.linalg.pinv(centred.T @ centred + alpha * np.eye(whole.shape[1]), rcond=1e-10) @ centred.T @ (y - y.mean())
    for frame, design_rows in ((train, whole), (new, np.hstack([whole[:, :5], np.zeros((400, len(names)))]))):
        want = (design_rows - mean) @ w + y.mean()
        got = pooled.with_predictions(frame.withColumn("at", F.monotonically_increasing_id()), {"p": fit}).orderBy("at").select("p").collect()
        np.testing.assert_allclose([r.p for r in got], want, atol=1e-6)
    assert pooled.optimum_gaps(train, fit, "y").where("imbalance > 1e-8").isEmpty()


@pytest.mark.parametrize("n_tags", [5_000, 200_000])
def test_fits_over_many_tags_are_optimal(spark, n_tags):
    rows = spark.range(3 * n_tags).select(
        F.concat(F.lit("#"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % n_tags)).alias("tag"),  # one tag has a third of the rows
        F.when(F.col("id") % 2 == 0, "hashtag").otherwise("cashtag").alias("tag_type"),
        (F.pmod(F.xxhash64("id"), 1000) / 10).alias("a"),
        (F.pmod(F.xxhash64("id", F.lit(1)), 1000) / 10).alias("b"),
        (F.pmod(F.xxhash64("id", F.lit(2)), 100) + F.col("id") % 11).cast("double").alias("y"),
    )
    rows = staged(rows, "many-tags")
    fits = pooled.fit_pooled(rows, {"linear": 0.0, "ridge": 10.0}, pooled.design_of(rows, ["a", "b"]), "y")
    for fit in fits.values():
        gaps = pooled.optimum_gaps(rows, fit, "y").agg(F.max("imbalance"), F.count(F.lit(1))).first()
        assert gaps[0] < 1e-5 and gaps[1] > 0.6 * n_tags


def test_columns_of_the_small_system_are_bounded(spark):
    rows = spark.range(100).selectExpr("'t' AS tag", "cast(id AS string) AS tag_type", "1.0 AS a", "1.0 AS y")
    with pytest.raises(ValueError, match="name the one with most of them first"):
        pooled.design_of(rows, ["a"])
    swapped = pooled.fit_pooled(rows, {"m": 1.0}, pooled.design_of(rows, ["a"], ["tag_type", "tag"]), "y")
    assert pooled.optimum_gaps(rows, swapped["m"], "y").count() == 100 + 3
    with pytest.raises(ValueError, match="no train rows"):
        pooled.fit_pooled(rows.limit(0), {"m": 1.0}, pooled.design_of(rows, ["a"], ["tag_type", "tag"]), "y")


def test_missing_categories_take_the_most_frequent(modeling):
    train = modeling.where("split = 'train'")
    gappy = train.withColumn("tag", F.when(F.col("date") > "2020-04-20", F.col("tag")))
    most = pooled.category_fills(gappy, ["tag"])["tag"]
    encoder = ml.prepare(gappy).encoder
    assert most in ml.category_labels(encoder, "tag") and "unknown" not in ml.category_labels(encoder, "tag")
    missing = gappy.where("tag is null").count()
    filled = dict(rows(ml.category_totals(encoder, gappy.fillna({"tag": most}), "tag")))
    assert missing and sum(filled.values()) == gappy.count()


def test_unknown_categories_encode_as_zeros(modeling):
    preparation = ml.prepare(modeling.where("split = 'train' and tag <> '#t0'"))
    totals = dict(rows(ml.category_totals(preparation.encoder, modeling, "tag")))
    assert "#t0" not in totals and sum(totals.values()) == modeling.where("tag <> '#t0'").count()
    wide = ml.prepare(modeling.where("split = 'train' and tag <> '#t0'"), encode_over=modeling)
    assert "#t0" in dict(rows(ml.category_totals(wide.encoder, modeling, "tag")))


def test_too_many_categories_are_refused(modeling):
    with pytest.raises(ValueError, match="more than 3 categories"):
        ml.require_bounded_categories(modeling, ["tag"], bound=3)


def test_tree_models_learn_and_are_clipped(modeling):
    configs = [
        ml.ModelConfig("forest", "random_forest", {"numTrees": 20, "maxDepth": 6, "minInstancesPerNode": 2, "seed": 42}),
        ml.ModelConfig("boosting", "gradient_boosting", {"maxIter": 15, "stepSize": 0.2, "maxDepth": 3, "seed": 42}),
    ]
    fitted = ml.fit_models(modeling, configs)
    metrics = {(r["split"], r["model"]): r["MAE"] for r in fc.overall_metrics(fitted.predictions).collect()}
    spread = modeling.where("split = 'test'").agg(F.avg(F.abs(F.col(TARGET) - F.col("rolling_mean_7")))).first()[0]
    assert metrics["test", "forest"] < 1.5 * spread and metrics["test", "boosting"] < 1.5 * spread
    assert fitted.predictions.where("prediction < 0").isEmpty()
    with pytest.raises(ValueError, match="unknown model kind"):
        ml.fit_models(modeling, [ml.ModelConfig("x", "x")])


def test_target_scaling_round_trip(modeling):
    scaled = scaling.standardise_target(modeling, TARGET)
    moments = scaling.split_moments(modeling, TARGET).select(F.struct("mean", "std")).scalar()
    back = scaling.restore_target(scaled, f"{TARGET}_scaled", moments, "back")
    assert back.where(F.abs(F.col("back") - F.col(TARGET)) > 1e-9).isEmpty()
    train = scaled.where("split = 'train'").agg(F.avg(f"{TARGET}_scaled"), F.stddev_pop(f"{TARGET}_scaled")).first()
    assert train[0] == pytest.approx(0, abs=1e-9) and train[1] == pytest.approx(1)


def test_whole_run_and_its_files(spark, features, tmp_path):
    run = forecasting.run(features, "t1", ml.MODEL_CONFIGS[:2], "features.parquet")
    assert run.overall.count() == 6 and run.baseline_overall.count() == 8
    assert run.by_tag.count() == 6 and run.by_type.count() == 2 * 2 * 3
    summary = run.summary.first()
    assert summary["best_learned_model"] in summary["models_compared"] and len(summary["models_compared"]) == 2
    assert summary["best_learned_test_metrics"]["model"] == summary["best_learned_model"]
    assert summary["baseline_validation_metrics"]["split"] == "validation"
    assert set(summary["model_training_seconds"]) == {c.name for c in ml.MODEL_CONFIGS[:2]}
    forecasting.save(run, str(tmp_path))
    again = forecasting.run(features, "t2", ml.MODEL_CONFIGS[:1])
    forecasting.save(again, str(tmp_path))
    stored = spark.read.option("header", True).csv(str(tmp_path / "model_metrics_overall"))
    assert rows(stored.groupBy("run_label").count()) == [("t1", 6), ("t2", 4)]
    assert spark.read.json(str(tmp_path / "run_summary")).first()["run_label"] == "t2"


def test_sums_per_tag_hold_no_products(spark):
    """The products of the small columns are needed over all rows only: per tag they would grow with the square of the columns."""
    rows = spark.range(60).selectExpr("concat('#', id % 20) AS tag", "if(id % 2 = 0, 'a', 'b') AS tag_type", "double(id % 7) AS a", "double(id) AS y")
    design = pooled.design_of(rows, ["a"])
    sums = pooled.tag_sums(rows, design, "y")
    assert sums.columns == ["key", "n", "s", "r"] and sums.count() == 20
    products = pooled.total_products(rows, design, "y")
    assert len(products["cross"]) == 10 and products["cross"][0] == 60 and products["c"][0] == sum(range(60))


def test_trees_and_train_mean_share_one_feature_table(spark, sf, monkeypatch):
    from checks import q_modelling as q

    derived = []
    real = q.t.stored_features
    monkeypatch.setattr(q.t, "stored_features", lambda *a: derived.append(a) or real(*a))
    monkeypatch.setattr(q, "_RUNS", {})
    monkeypatch.setattr(q, "_TABLES", {}, raising=False)

    def fit(rows):
        scored = rows.where("split = 'test'").select(F.lit("random_forest_pooled").alias("model"), "split", "target_next_count", F.lit(1.0).alias("prediction"))
        return ml.FittedModels({}, scored, {})

    monkeypatch.setattr(q.ml, "fit_models", fit)
    assert q.trees_beat_the_mean(spark, sf).count() == 1
    assert len(derived) == 1
