"""Edge semantics of profiling, exploring and quantiles."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from sondeo.functions import moments
from sondeo import workspace
from sondeo.operators import explore, profile, quantiles


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_constant_column_has_no_shape_and_no_correlation(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(4)], "c double, x double")
    row = profile.column_moments(df, ["c"]).first()
    assert (row["skewness"], row["kurtosis"], row["std"]) == (0.0, 0.0, 0.0)
    assert df.agg(moments.skewness("c"), moments.kurtosis("c")).first()[:] == (0.0, 0.0)
    assert explore.correlation_pairs(df, [("c", "x")]).first()["correlation"] is None
    assert df.agg(moments.correlation("c", "x")).first()[0] is None
    assert explore.high_correlations(df).isEmpty()


def test_shape_needs_three_and_four_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "x double")
    row = profile.column_moments(df, ["x"]).first()
    assert row["count"] == 3 and row["missing"] == 1 and row["missing_pct"] == 0.25
    assert row["skewness"] is not None and row["kurtosis"] is None


def test_correlation_uses_complete_pairs(spark):
    data = [(1.0, 2.0), (2.0, None), (3.0, 5.0), (None, 1.0), (4.0, 6.5)]
    df = spark.createDataFrame(data, "a double, b double")
    assert explore.correlation_pairs(df, [("a", "b")]).first()["correlation"] == pytest.approx(1.0)
    assert df.agg(moments.correlation("a", "b")).first()[0] == pytest.approx(1.0)


def test_many_pairs_span_several_scans(spark, monkeypatch):
    monkeypatch.setattr(workspace, "MEASURES_PER_SCAN", 5)
    rng = random.Random(1)
    data = [tuple(rng.random() if rng.random() > 0.1 else None for _ in range(4)) for _ in range(200)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double")
    for r in explore.correlation_matrix(df).collect():
        complete = [(x[r["col_a"]], x[r["col_b"]]) for x in df.collect() if None not in (x[r["col_a"]], x[r["col_b"]])]
        expected = statistics.correlation(*map(list, zip(*complete)))
        assert r["correlation"] == pytest.approx(expected, abs=1e-12)


def test_duplicates_treat_null_as_equal(spark):
    data = [(1, None), (1, None), (2, 3), (2, 3), (3, 1)]
    df = spark.createDataFrame(data, "a int, b int")
    assert profile.duplicate_count(df).first()[0] == 2


def test_zero_spread_fences(spark):
    df = spark.createDataFrame([(v,) for v in (5.0, 5.0, 5.0, 5.0, 9.0)], "x double")
    assert rows(profile.outlier_counts(df)) == [("x", 1)]
    assert profile.outlier_counts(df, positive_spread=True).isEmpty()


def brute_quantiles(values, probabilities):
    values = sorted(values)
    out = []
    for p in probabilities:
        at = p * (len(values) - 1)
        low = int(at)
        high = min(low + (at > low), len(values) - 1)
        out.append(values[low] + (values[high] - values[low]) * (at - low))
    return out


@pytest.mark.parametrize("kind", ["uniform", "ties", "spikes", "constant", "two", "tiny"])
def test_narrowed_quantiles_are_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "INTERVAL_ROWS", 20)
    monkeypatch.setattr(quantiles, "SAMPLE_ROWS", (200, 1000))
    rng = random.Random(3)
    draw = {
        "uniform": lambda: rng.uniform(-5, 5),
        "ties": lambda: float(rng.randint(0, 6)),
        "spikes": lambda: rng.choice([0.0, 0.0, 0.0, 1e18 * rng.random(), -1e-9]),
        "constant": lambda: 2.5,
        "two": lambda: float(rng.random() < 0.5),
        "tiny": lambda: rng.random(),
    }[kind]
    values = [draw() for _ in range(2 if kind == "tiny" else 3000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    wanted = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    assert quantiles.fit_quantiles(df, ["x"], wanted)["x"] == pytest.approx(brute_quantiles(values, wanted), rel=1e-12)


@pytest.mark.parametrize("way", ["series", "percentile", "sliced"])
def test_grouped_quantiles_agree(spark, monkeypatch, way):
    if way != "series":
        monkeypatch.setattr(quantiles, "MOST_SERIES", 1)
    if way == "sliced":
        monkeypatch.setattr(quantiles, "EXACT_ROWS", 0)
    rng = random.Random(5)
    # Group "hot" holds most rows.
    data = [("hot" if rng.random() < 0.7 else f"g{rng.randint(0, 5)}", rng.gauss(0, 10), float(rng.randint(0, 3))) for _ in range(2000)]
    df = spark.createDataFrame(data, "g string, x double, y double")
    found = quantiles.quantile_rows(df, ["x", "y"], [0.25, 0.5, 0.9], ["g"]).collect()
    assert len(found) == 2 * len({d[0] for d in data})
    for r in found:
        values = [d[1 if r["column"] == "x" else 2] for d in data if d[0] == r["g"]]
        assert r["n"] == len(values)
        assert r["quantiles"] == pytest.approx(brute_quantiles(values, [0.25, 0.5, 0.9]))


def test_empty_columns_have_no_quantiles(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert quantiles.fit_quantiles(df, ["a", "b"], [0.5]) == {"b": [1.0]}


def test_histogram_of_constant_and_empty(spark):
    df = spark.createDataFrame([(4.0,)] * 3, "x double")
    counts = {r["bin"]: r["n"] for r in explore.histogram(df, "x", 5).collect()}
    assert counts == {1: 3, 2: 0, 3: 0, 4: 0, 5: 0}
    assert explore.histogram(df.where(F.lit(False)), "x").isEmpty()


def test_group_means_needs_two_to_twenty_groups(spark):
    many = spark.createDataFrame([(f"k{i}", float(i)) for i in range(21)], "k string, y double")
    assert explore.group_means(many, "k", "y").isEmpty()
    assert explore.group_means(many.limit(0), "k", "y").isEmpty()
    two = spark.createDataFrame([("a", 1.0), ("b", 3.0), (None, 9.0)], "k string, y double")
    assert rows(explore.group_means(two, "k", "y")) == [("a", 1.0), ("b", 3.0)]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (0,), (10,)], "x int")
    assert [r[0] for r in df.select(moments.clip("x", 1, 5)).collect()] == [None, 1, 5]


def test_distribution_labels(spark):
    df = spark.createDataFrame([(0.4,), (0.7,), (1.2,), (-1.2,), (None,)], "s double")
    found = [r[0] for r in df.select(moments.distribution_label(F.col("s"))).collect()]
    assert found == ["approximately_normal", "moderately_skewed", "right_skewed", "left_skewed", "unknown"]


def test_target_chart_switches_on_cardinality(spark):
    few = spark.createDataFrame([(i % 3,) for i in range(9)], "y int")
    assert explore.target_chart(few, "y").columns == ["y", "n"]
    many = spark.createDataFrame([(i,) for i in range(40)], "y int")
    assert "median" in explore.target_chart(many, "y").columns


def test_empty_table_is_refused(spark):
    with pytest.raises(ValueError):
        profile.validation_warnings(spark.createDataFrame([], "a int"), "a")
