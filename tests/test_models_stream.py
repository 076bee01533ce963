"""Metrics, models, gates, the composed analysis and streaming refresh."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sondeo.operators import gates, metrics, models
from sondeo.plans import analysis
from sondeo.streaming import refresh


def test_single_class_has_no_auc(spark):
    df = spark.createDataFrame([(0.1, 1), (0.9, 1)], "s double, y int")
    assert metrics.roc_auc(df, "s", F.col("y") == 1).first()["roc_auc"] is None


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "s double, y int")
    assert metrics.roc_auc(df, "s", F.col("y") == 1).first()["roc_auc"] == pytest.approx(0.875)


def test_auc_agrees_with_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = spark.range(500).select((F.pmod(F.xxhash64("id"), F.lit(37)) / 37).alias("s"), (F.col("id") % 3 == 0).cast("double").alias("y"))
    expected = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y").evaluate(df)
    assert metrics.roc_auc(df, "s", F.col("y") == 1).first()["roc_auc"] == pytest.approx(expected)


def test_confusion_matrix_lists_zeros(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "y string, p string")
    assert {tuple(r) for r in metrics.confusion_matrix(df, "y", "p").collect() if r["n"]} == {("a", "a", 1), ("b", "a", 1), ("c", "c", 1)}
    assert metrics.confusion_matrix(df, "y", "p").count() == 9


def test_constant_target_has_no_r2(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "y double, p double")
    row = metrics.regression_metrics(df, "y", "p").first()
    assert row["r2"] is None and row["mae"] == 1.0 and row["mape"] == 0.5


@pytest.fixture(scope="module")
def three_classes(spark):
    """Fifteen rows, three text classes in turn."""
    rows = [(i, float(i), float(3 + (i - 1) % 5), "lnh"[(i - 1) % 3]) for i in range(1, 16)]
    df = spark.createDataFrame(rows, "id int, f1 double, f2 double, y string")
    return models.prepare(df, "y", "id", models.CLASSIFICATION)


def test_three_class_training(three_classes):
    trained = models.train(three_classes, "random_forest", {"n_estimators": 5, "max_depth": 3})
    assert three_classes.classes == ["h", "l", "n"]
    assert trained.name == "random_forest_clf"
    assert not math.isnan(trained.cv_mean)
    evaluation = trained.evaluation().first()
    assert evaluation["roc_auc"] > 0.5 and 0 <= evaluation["accuracy"] <= 1
    assert {r["feature"] for r in trained.importance().collect()} == {"f1", "f2"}


def test_one_vs_rest_probabilities_sum_to_one(three_classes):
    trained = models.train(three_classes, "logistic_regression")
    sums = models.with_scores(trained.predictions()).select(F.aggregate("scores", F.lit(0.0), lambda a, b: a + b).alias("s"))
    assert all(r["s"] == pytest.approx(1.0) for r in sums.collect())


def test_two_class_models_score_after_an_observed_query(spark):
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("rows")).count()
    df = spark.range(60).select("id", (F.col("id") % 7).alias("x"), (F.col("id") % 2).alias("y"))
    data = models.prepare(df, "y", "id", models.CLASSIFICATION)
    for name in ("logistic_regression", "random_forest_clf"):
        estimator = models.build_estimator(name, models.DEFAULTS[name] | {"n_estimators": 2}, data.n, 2)
        assert 0 <= models.score(models.fitted(estimator, data.rows), data.rows, data) <= 1
    assert seen.get["rows"] == 5


def test_training_rows_are_dealt_to_tasks_by_their_number(spark):
    # Small in bytes, so the shuffles before leave one file; keys repeat and are missing.
    df = spark.range(20_000).select(F.when(F.col("id") % 9 > 0, F.col("id") % 500).alias("id"), (F.col("id") % 7).alias("x"), (F.col("id") % 2).alias("y"))
    data = models.prepare(df, "y", "id", models.CLASSIFICATION)
    assert data.n == 20_000 and data.rows.rdd.getNumPartitions() == 3
    counts = {(r["id"], r["label"]): r["count"] for r in data.rows.groupBy("id", "label").count().collect()}
    assert counts == {(r["id"], float(r["y"])): r["count"] for r in df.groupBy("id", "y").count().collect()}
    few = models.prepare(df.limit(100), "y", "id", models.CLASSIFICATION)
    assert few.rows.rdd.getNumPartitions() == 1


def test_names_resolve():
    assert models.resolve_name("random_forest", "regression") == "random_forest_reg"
    assert models.resolve_name("boosted", "classification") == "boosted_clf"
    assert models.resolve_name("ridge", "regression") == "ridge"
    assert models.resolve_name("unknown", "classification") == "random_forest_clf"


def test_regression_candidates_and_search(spark):
    df = spark.range(120).select("id", (F.col("id") % 11).cast("double").alias("a"), F.pmod(F.xxhash64("id"), F.lit(7)).cast("double").alias("b"))
    df = df.withColumn("y", F.col("a") * 3 - F.col("b") + 1)
    data = models.prepare(df, "y", "id", models.REGRESSION)
    champion, ranking = models.compete(data, ["ridge", "random_forest_reg"], trials=2, params={"n_estimators": 5, "max_depth": 3})
    assert champion.name == "ridge" and champion.cv_mean > 0.95
    assert [r["model"] for r in ranking.orderBy("rank").collect()] == ["ridge", "random_forest_reg"]
    lost = {r["feature"]: r["importance"] for r in models.permutation_importance(champion).collect()}
    assert lost["a"] > lost["b"] > 0


def test_failing_candidates_are_ranked_last_with_the_reason(three_classes, monkeypatch):
    with pytest.raises(ValueError):
        models.compete(three_classes, ["ridge"], params={"alpha": "wrong"})
    train = models.train

    def fails(data, name, params):
        if name == "random_forest_clf":
            raise RuntimeError("no trees today")
        return train(data, name, params)

    monkeypatch.setattr(models, "train", fails)
    _, ranking = models.compete(three_classes, ["random_forest_clf", "logistic_regression"])
    rows = ranking.orderBy("rank").collect()
    assert [(r["model"], r["cv_mean"] is None) for r in rows] == [("logistic_regression", False), ("random_forest_clf", True)]
    assert rows[1]["error"] == "RuntimeError: no trees today"


def test_keys_and_unselected_columns_are_no_features(spark):
    df = spark.range(60).select("id", (F.col("id") * 2).alias("other_key"), (F.col("id") % 5).alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") % 2).alias("y"))
    data = models.prepare(df, "y", ["id", "other_key"], models.CLASSIFICATION, ["a"])
    assert data.features == ["a"]
    assert models.prepare(df, "y", ["id", "other_key"], models.CLASSIFICATION).features == ["a", "b"]


def gate(df):
    return {(r["metric"]): r["passed"] for r in df.collect()}


def test_cleaning_gate_thresholds(spark):
    def table(gaps):
        return spark.range(100).select("id", F.when(F.col("id") >= gaps, 1).alias("v"))

    assert gate(gates.cleaning_gate(table(1)))["max_missing_pct"] == 1
    assert gate(gates.cleaning_gate(table(10)))["max_missing_pct"] == 0
    loose = {"data_cleaning": {"max_missing_pct_after": 0.15}}
    assert gate(gates.cleaning_gate(table(10), settings=loose))["max_missing_pct"] == 1
    assert gate(gates.cleaning_gate(table(1).limit(70), table(1)))["rows_retained_pct"] == 0


def test_model_gate_thresholds(spark):
    def result(value):
        return spark.createDataFrame([(value,)], "roc_auc double")

    assert [gate(gates.model_gate(result(v)))["roc_auc"] for v in (0.8, 0.5, None)] == [1, 0, 1]


def test_feature_and_exploration_gates(spark):
    chosen = spark.createDataFrame([("a", 0.5), ("b", 0.0005)], "feature string, mi double")
    assert gate(gates.feature_gate(chosen)) == {"n_features": 0, "n_features_most": 1, "min_mi": 0}
    assert gate(gates.exploration_gate(chosen.limit(0))) == {"findings": 0}
    assert gate(gates.collection_gate(chosen)) == {"rows": 0, "columns": 1}


def test_recommendation_rules(spark):
    importance = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.1), ("d", 0.05)], "feature string, importance double")
    area = spark.createDataFrame([(0.7,)], "roc_auc double")
    log = spark.createDataFrame([(3,)], "rows_affected bigint")
    found = {r["rule"]: r["evidence"] for r in gates.recommendations(spark, importance, area, log).collect()}
    assert found == {
        "deploy_with_monitoring": "always", "act_on_top_features": "a, b, c",
        "improve_accuracy": "roc_auc=0.7", "improve_data_integrity": "rows_affected=3",
    }
    good = spark.createDataFrame([(0.9,)], "roc_auc double")
    assert gates.recommendations(spark, metrics=good, log=log.limit(0)).count() == 1


def test_analysis_end_to_end(spark):
    df = spark.range(200).select(
        "id",
        F.when(F.col("id") % 11 != 0, (F.col("id") % 17).cast("double")).alias("a"),
        (F.pmod(F.xxhash64("id"), F.lit(9))).cast("double").alias("b"),
        F.when(F.col("id") % 2 == 0, "x").otherwise("w").alias("c"),
        F.when(F.col("id") % 17 > 8, "hi").otherwise("lo").alias("y"),
    )
    report = analysis.analyse(df.union(df.limit(5)), "y", ["id"], model_names=["random_forest_clf"], model_params={"n_estimators": 5, "max_depth": 3})
    assert report.cleaned.count() == 200
    assert report.cleaned.where("a IS NULL").isEmpty()
    assert report.selected.orderBy("rank").first()["feature"] == "a"
    assert report.model.cv_mean > 0.8
    stages = {r["stage"] for r in report.gates.collect()}
    assert stages == {"data_collection", "data_cleaning", "eda", "feature_engineering", "modeling"}
    assert report.recommendations.count() >= 2
    chosen = {r["feature"] for r in report.selected.collect()}
    assert set(report.model.data.features) == chosen == {r["feature"] for r in report.lineage.collect()}
    assert "id" not in chosen


def test_refresh_writes_each_file_once(spark, tmp_path):
    landing, table, progress = (str(tmp_path / n) for n in ("landing", "table", "progress"))
    spark.range(5).write.parquet(landing)
    schema = spark.read.parquet(landing).schema
    seen = []

    def cycle(source="firms", keep=24):
        stream = refresh.read_stream(spark, landing, schema)
        refresh.start_refresh(stream, table, source, f"{progress}-{source}", once=True, keep=keep, after=lambda df: seen.append(df.count())).awaitTermination()
        return refresh.snapshots(spark, table).where(F.col("source") == source).count()

    assert refresh.load_latest(spark, table, ["firms"]) == {}
    assert cycle() == 5
    assert cycle() == 5
    spark.range(5, 8).write.mode("append").parquet(landing)
    assert cycle() == 8
    assert seen == [5, 3]
    latest = refresh.load_latest(spark, table, ["firms", "eonet"])
    assert set(latest) == {"firms"}
    assert sorted(r["id"] for r in latest["firms"].collect()) == [5, 6, 7]


def test_retention_keeps_newest_per_source(spark, tmp_path):
    table = str(tmp_path / "table")
    for i in range(12):
        spark.range(1).write.parquet(refresh.snapshot_folder(table, "firms", i))
    for i in range(2):
        spark.range(1).write.parquet(refresh.snapshot_folder(table, "eonet", i))
    assert len(refresh.drop_expired(spark, table, keep=5)) == 7
    kept = {(r["source"], r["snapshot"]) for r in refresh.snapshots(spark, table).select("source", "snapshot").collect()}
    assert kept == {("firms", i) for i in range(7, 12)} | {("eonet", 0), ("eonet", 1)}
