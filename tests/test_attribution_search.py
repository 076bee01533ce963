"""Attributions against the definition of Shapley values, search against random draws."""

from __future__ import annotations

import math
import random
import statistics
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sondeo.operators import attribution, models, search

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    value = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("double")
    df = spark.range(240).select("id", value(1, 11).alias("a"), value(2, 7).alias("b"), value(3, 5).alias("c"), value(4, 3).alias("d"))
    df = df.withColumns({"y": (F.col("a") * F.col("b") - 3 * F.col("c")), "two": (F.col("a") > F.col("b")).cast("double"), "three": F.col("d")})
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df).cache()


def shapley(model, spark, x):
    """By the definition: all subsets of known features, unknown ones averaged by the rows that went each way."""
    nodes = attribution._nodes(model, spark)
    boosted = type(model).__name__.startswith("GBT")
    classes = 1 if boosted else getattr(model, "numClasses", 1)

    def expected(tree, at, known):
        prediction, stats, rows, left, right, feature, threshold = tree[at]
        if left < 0:
            return np.array(stats) / sum(stats) if classes > 1 else np.array([prediction])
        if feature in known:
            return expected(tree, left if x[feature] <= threshold else right, known)
        return sum(tree[c][2] / rows * expected(tree, c, known) for c in (left, right))

    weights = np.array(model.treeWeights) / (1 if boosted else sum(model.treeWeights))
    game = lambda known: sum(w * expected(nodes[t], 0, known) for t, w in enumerate(weights))
    out = []
    for i in range(len(x)):
        others = [j for j in range(len(x)) if j != i]
        total = 0
        for size in range(len(x)):
            for s in combinations(others, size):
                part = math.factorial(size) * math.factorial(len(x) - size - 1) / math.factorial(len(x))
                total = total + part * (game({*s, i}) - game(set(s)))
        out.append(total)
    return np.array(out), game(set())


@pytest.mark.parametrize("name,label", [("random_forest_clf", "two"), ("random_forest_clf", "three"), ("random_forest_reg", "y"), ("boosted_clf", "two"), ("boosted_reg", "y")])
def test_attributions_are_shapley_values(spark, rows, name, label):
    estimator = models.build_estimator(name, {"n_estimators": 3, "max_depth": 5}, 240, 2)
    model = estimator.fit(rows.withColumn("label", F.col(label)))
    found = attribution.attributions(model, rows, "id").orderBy("id", "output").collect()
    points = {r.id: r for r in model.transform(rows.withColumn("label", F.col(label))).collect()}
    for r in found:
        predicted = points[r.id]
        given = predicted.prediction if name.endswith("reg") else predicted.rawPrediction[1] if name == "boosted_clf" else predicted.probability[r.output]
        assert r.total == pytest.approx(given, abs=1e-9)
        if r.id < 6:
            values, base = shapley(model, spark, predicted.features.toArray())
            o = r.output if len(base) > 1 else 0
            assert r.attribution == pytest.approx(list(values[:, o]), abs=1e-9) and r.base == pytest.approx(base[o], abs=1e-9)
    assert len(found) == 240 * (3 if label == "three" else 1)


def test_one_against_the_rest_has_an_output_per_class(rows):
    estimator = models.build_estimator("boosted_clf", {"n_estimators": 2, "max_depth": 2}, 240, 3)
    model = estimator.fit(rows.withColumn("label", F.col("three")))
    found = attribution.attributions(model, rows, "id")
    assert {r.output: r["count"] for r in found.groupBy("output").count().collect()} == {0: 240, 1: 240, 2: 240}
    with pytest.raises(ValueError):
        attribution.attributions(models.build_estimator("logistic_regression", {"C": 1.0}, 240, 2).fit(rows.withColumn("label", F.col("two"))), rows, "id")


def test_constant_models_and_empty_tables(rows):
    model = models.build_estimator("random_forest_reg", {"n_estimators": 2}, 240, 0).fit(rows.withColumn("label", F.lit(2.5)))
    found = attribution.attributions(model, rows, "id").collect()
    assert {(r.base, r.total, tuple(r.attribution)) for r in found} == {(2.5, 2.5, (0.0,) * 4)}
    assert attribution.attributions(model, rows.limit(0), "id").count() == 0


def test_importance_is_the_mean_absolute_attribution(spark, rows):
    data = models.prepare(rows.select("id", *NAMES, F.col("y").alias("target")), "target", "id", models.REGRESSION)
    trained = models.train(data, "random_forest", {"n_estimators": 3, "max_depth": 4})
    found = attribution.attribution_importance(trained.model, data).collect()
    phi = np.array([r.attribution for r in attribution.attributions(trained.model, data.rows, "id").collect()])
    expected = dict(zip(data.features, np.abs(phi).mean(axis=0)))
    assert {r.feature: r.importance for r in found} == pytest.approx(expected)
    assert [r.importance for r in found] == sorted(expected.values(), reverse=True)
    assert attribution.attribution_importance(trained.model, data, k=2).count() == 2


RANGES = {"depth": (3, 20, "int"), "rate": (0.001, 100.0, "log"), "share": (0.6, 1.0, "float")}


def surface(p):
    return -(((p["depth"] - 8) / 6) ** 2) - (math.log10(p["rate"]) - 0.5) ** 2 - ((p["share"] - 0.8) / 0.2) ** 2


def test_search_beats_random_draws():
    gains = []
    for seed in range(20):
        rng = random.Random(1000 + seed)
        chance = max(surface(search.random_point(RANGES, rng)) for _ in range(30))
        gains.append(max(s for _, s in search.maximise(surface, RANGES, 30, seed)) - chance)
    assert statistics.mean(gains) > 0.05 and sum(g > 0 for g in gains) >= 14


def test_search_stays_in_range_and_repeats():
    first, again = (search.maximise(surface, RANGES, 25, seed=3, in_flight=4) for _ in range(2))
    assert first == again and len(first) == 25
    for p, _ in first:
        assert isinstance(p["depth"], int)
        assert all(low <= p[name] <= high for name, (low, high, _) in RANGES.items())
    failing = search.maximise(lambda p: None if p["depth"] > 10 else surface(p), RANGES, 30)
    assert sum(s is None for _, s in failing[20:]) <= sum(s is None for _, s in failing[:10]) + 3
    assert len(search.maximise(lambda p: None, RANGES, 14)) == 14


def test_tuned_model_is_trained_on_the_best_trial(rows):
    data = models.prepare(rows.select("id", "a", "b", F.col("y").alias("target")), "target", "id", models.REGRESSION)
    trained = models.tune(data, "ridge", trials=4)
    assert trained.name == "ridge" and 0.001 <= trained.params["alpha"] <= 100
