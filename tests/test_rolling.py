"""Rolling summaries against windows computed row by row."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from sondeo.operators import ordering, rolling

STATS = {"n": "rows", "c": "count", "s": "sum", "m": "avg", "low": "min", "high": "max", "sd": "std"}


def plain(rows, width):
    out = []
    for i, k, t, v in rows:
        if t is None:
            out.append((i, *[None] * 7))
            continue
        window = [x for _, kk, tt, x in rows if kk == k and tt is not None and t - width <= tt <= t]
        known = [x for x in window if x is not None]
        out.append((
            i, len(window), len(known), sum(known) if known else None, statistics.mean(known) if known else None,
            min(known, default=None), max(known, default=None), statistics.stdev(known) if len(known) > 1 else None,
        ))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    return [
        (i, rng.choice([None, "a", "b", "b", "b"]), rng.choice([None, *[rng.randint(-300, 300)] * 15]), rng.choice([None, *[rng.uniform(1e6, 1e6 + 9)] * 7]))
        for i in range(400)
    ]


@pytest.mark.parametrize("width,pieces", [(50, 1), (50, 8), (7, 3), (1000, 4), (1, 2)])
def test_rolling_summary(spark, rows, width, pieces):
    df = spark.createDataFrame(rows, "i long, k string, t long, v double").repartition(3)
    found = rolling.rolling_summary(df, ["k"], F.col("t"), width, "v", STATS, pieces)
    assert found.columns == ["i", "k", "t", "v", *STATS]
    got = sorted(tuple(r) for r in found.select("i", *STATS).collect())
    for a, b in zip(got, plain(rows, width), strict=True):
        assert a[:3] == b[:3] and a[5:7] == b[5:7]
        for x, y in ((a[3], b[3]), (a[4], b[4]), (a[7], b[7])):
            assert x is y is None or x == pytest.approx(y, rel=1e-6)


def test_one_key_is_spread_over_tasks(spark):
    df = spark.range(4000).select("id", F.lit("k").alias("k"), F.lit(1.0).alias("v"))
    found = rolling.rolling_summary(df, ["k"], F.col("id"), 1000, "v", {"n": "rows"}, 16)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert found.where(F.col("n") != F.least(F.col("id") + 1, F.lit(1001))).isEmpty()
    spans = df.select(F.floor(F.col("id") * 16 / 1000).alias("s")).distinct().count()
    assert spans == 64 and sum(sizes) == 4000
    with pytest.raises(ValueError):
        rolling.rolling_summary(df, ["k"], F.col("id"), 10, "v", {"n": "median"})
    assert rolling.rolling_summary(df.limit(0), ["k"], F.col("id"), 10, "v", STATS).count() == 0


def test_lags_keep_rows_without_an_id(spark):
    df = spark.createDataFrame([(1, "a", 1, 10.0), (None, "a", 2, 20.0), (3, "a", 3, 30.0)], "id long, k string, t long, v double")
    found = ordering.lagged(df, ["k"], ["t"], "v", [1], F.floor(F.col("t") / 2), "id").collect()
    assert sorted((r.v, r.v_lag_1) for r in found) == sorted([(10.0, None), (20.0, 10.0), (30.0, 20.0)], key=lambda x: x[0])
