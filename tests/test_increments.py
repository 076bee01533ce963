"""Profiles merged from states, and gates observed on the way, against those of the whole table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sondeo.operators import gates, increments, profile
from sondeo.streaming import refresh


@pytest.fixture(scope="module")
def df(spark):
    rows = spark.range(3000)
    return rows.select(
        "id", F.when(F.col("id") % 7 != 0, F.pmod(F.xxhash64("id"), F.lit(997)) + 1e6).alias("far"), F.lit(4.5).alias("flat"),
        F.pow(F.col("id") / 100, F.lit(3)).alias("skewed"), (F.col("id") % 40).cast("string").alias("text"), F.lit(None).cast("double").alias("none"),
    )


def merged(parts):
    states = [increments.profile_state(p) for p in parts]
    total = states[0]
    for s in states[1:]:
        total = total.unionAll(s)
    return increments.merge_states(total)


def test_merged_states_are_the_profile_of_the_whole(df):
    parts = [df.where("id < 10"), df.where("id >= 10 AND id < 2500"), df.where("id < 0"), df.where("id >= 2500")]
    found = {r["column"]: r for r in increments.state_profile(merged(parts)).collect()}
    assert set(found) == set(df.columns)
    numeric = ["id", "far", "flat", "skewed", "none"]
    for r in profile.column_moments(df, numeric).collect():
        got = found[r["column"]]
        assert (got["count"], got["missing"], got["missing_pct"], got["min"], got["max"]) == (r["count"], r["missing"], r["missing_pct"], r["min"], r["max"])
        for m in ("mean", "std", "skewness", "kurtosis"):
            assert got[m] is r[m] is None or got[m] == pytest.approx(r[m], rel=1e-9, abs=2e-4)
    for c, n in (("id", 3000), ("far", df.select("far").distinct().where("far IS NOT NULL").count()), ("flat", 1), ("text", 40), ("none", 0)):
        assert abs(found[c]["distinct_estimate"] - n) <= 0.06 * n
    assert found["text"]["mean"] is None and found["text"]["count"] == 3000


def test_merging_is_associative(df):
    a, b, c = (increments.profile_state(df.where(F.col("id") % 3 == i)) for i in range(3))
    left = increments.merge_states(increments.merge_states(a.unionAll(b)).select(a.columns).unionAll(c))
    right = increments.merge_states(a.unionAll(increments.merge_states(b.unionAll(c)).select(a.columns)))
    one, two = (increments.state_profile(x).orderBy("column").collect() for x in (left, right))
    for x, y in zip(one, two, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or p == pytest.approx(q, abs=1e-3)


def test_refresh_keeps_the_profile_of_all_rows(spark, df, tmp_path):
    landing, table, profiles = (str(tmp_path / n) for n in ("landing", "table", "profiles"))
    assert refresh.running_profile(spark, profiles) is None
    schema = df.schema
    for i in range(3):
        df.where(F.col("id") % 3 == i).write.mode("append").parquet(landing)
        stream = refresh.read_stream(spark, landing, schema)
        refresh.start_refresh(stream, table, "firms", f"{table}-progress", once=True, keep=1, profiles=profiles).awaitTermination()
    assert refresh.snapshots(spark, table).count() == 1000  # the other snapshots have expired
    found = {r["column"]: r for r in refresh.running_profile(spark, profiles, "firms").collect()}
    assert found["id"]["source"] == "firms" and found["id"]["count"] == 3000 and found["far"]["missing"] == 429
    whole = profile.column_moments(df, ["skewed"]).first()
    assert found["skewed"]["kurtosis"] == pytest.approx(whole["kurtosis"], abs=2e-4)


def test_observed_gates_need_no_job(spark, df, tmp_path):
    raw = gates.ObservedGates(df)
    cleaned = gates.ObservedGates(raw.rows.where("id < 2900").drop("none"))
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    cleaned.rows.write.parquet(str(tmp_path / "out"))
    context.setJobGroup("gates", "")
    found = raw.collection_gate().unionByName(cleaned.cleaning_gate(raw))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("gates")) == 0
    stored = spark.read.parquet(str(tmp_path / "out"))
    expected = gates.collection_gate(df).unionByName(gates.cleaning_gate(stored, df))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_observed_gates_of_wide_and_empty_tables(spark):
    wide = gates.ObservedGates(spark.range(20).select(*[F.when(F.col("id") >= i, 1).alias(f"c{i}") for i in range(70)]))
    wide.rows.write.format("noop").mode("overwrite").save()
    rows, gaps = wide.figures()
    assert rows == 20 and gaps == {f"c{i}": min(i, 20) for i in range(70)}
    empty = gates.ObservedGates(spark.range(0))
    empty.rows.write.format("noop").mode("overwrite").save()
    assert [(r.metric, r.passed) for r in empty.collection_gate().collect()] == [("rows", 0), ("columns", 0)]
    assert [(r.metric, r.value, r.passed) for r in empty.cleaning_gate(wide).collect()] == [("max_missing_pct", 0.0, 1), ("rows_retained_pct", 0.0, 0)]
