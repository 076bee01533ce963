"""Cleaning, encoding, ordering and selection on small tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sondeo.operators import clean, features, ordering, registry, selection


def column(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_mode_takes_smallest_tie_and_default(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None)], "s string, e string")
    assert clean.fit_modes(df, ["s", "e"]) == {"s": "a", "e": "Unknown"}


def test_median_makes_integers_double(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, v int")
    assert column(clean.impute_median(df, ["v"]), "v") == [1.0, 2.0, 1.5]


def test_plan_and_log(spark):
    data = [(i, float(i % 10), "x" if i % 2 else None) for i in range(40)] + [(40, None, "y"), (41, 900.0, "y")]
    df = spark.createDataFrame(data + data[:3], "id int, v double, s string")
    steps = clean.cleaning_plan(df, exclude=["id"])
    assert steps == ["drop_duplicates", "fill_numeric_missing", "fill_categorical_missing", "cap_outliers_iqr"]
    cleaned, log = clean.clean(df, exclude=["id"])
    changed = {r["operation"]: r["rows_affected"] for r in log.collect()}
    assert changed == dict(zip(steps, [3, 1, 20, 1]))
    assert cleaned.count() == 42
    assert cleaned.where("v IS NULL OR s IS NULL OR v > 100").isEmpty()


def test_failing_step_is_logged(spark):
    df = spark.createDataFrame([(1,)], "id int")
    same, log = clean.clean(df, steps=["no_such_step"])
    assert same.count() == 1
    assert log.first()["status"] == "failed: KeyError"


def test_label_codes_treat_null_as_nan(spark):
    df = spark.createDataFrame([(1, "z"), (2, None), (3, "a")], "id int, s string")
    assert column(features.label_encode(df, "s"), "s") == [2, 1, 0]


def test_ordered_codes_of_a_long_list(spark):
    values = [f"v{random.Random(i).randint(0, 10**6):07d}" for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "s string").repartition(7)
    codes = {r["s"]: r["code"] for r in ordering.ordered_codes(df, "s", limit=10).collect()}
    assert codes == {v: i for i, v in enumerate(sorted(set(values)))}


def test_one_hot_drops_first_and_single_value(spark):
    df = spark.createDataFrame([(1, "b", "k"), (2, "a", "k"), (3, None, "k")], "id int, s string, one string")
    hot = features.one_hot(features.one_hot(df, "s"), "one")
    assert hot.columns == ["id", "s_b"]
    assert column(hot, "s_b") == [1, 0, 0]


def test_encoding_by_cardinality(spark):
    df = spark.createDataFrame([(i, f"c{i % 2}", f"h{i % 5}", f"m{i % 12}") for i in range(24)], "id int, two string, few string, many string")
    assert features.encoding_plan(df, ["two", "few", "many"]) == {"two": "label", "few": "onehot", "many": "label"}


def test_origins_are_noted_as_features_are_made(spark):
    rows = [(i, float(i % 7), 2.0**i, f"c{i % 2}", f"h{i % 3}", i % 2) for i in range(24)]
    df = spark.createDataFrame(rows, "id int, a double, wide double, two string, few string, y int")
    built, origins = features.transform_with_origins(df, "y", [("a", "wide")], ["id"])
    assert origins == {
        "a": "original:a", "wide": "original:wide", "two": "encoded:two", "few_h1": "encoded:few", "few_h2": "encoded:few",
        "log_wide": "log_transform:wide", "a_x_wide": "interaction:a*wide",
    }
    assert set(built.columns) == {"id", "y", *origins}
    assert sorted(r["id"] for r in built.collect()) == list(range(24))
    assert {r["feature"] for r in features.lineage(spark, origins, ["a", "two"]).collect()} == {"a", "two"}


def joins(df):
    return str(df._jdf.queryExecution().optimizedPlan()).count("Join ")


def test_encoding_takes_a_join_a_column(spark):
    df = spark.createDataFrame([tuple(f"v{i * k % 13}" for k in range(1, 7)) for i in range(40)], ", ".join(f"c{k} string" for k in range(6)))
    for k in (2, 4, 6):
        encoded = features.encode(df.select(*[f"c{i}" for i in range(k)]))
        assert joins(encoded) <= k and encoded.count() == 40


def test_correlations_take_two_scans_whatever_the_columns(spark):
    from itertools import combinations

    from sondeo.operators import explore

    rows = spark.range(300)
    df = rows.select(*[F.when(F.col("id") % (k + 3) != 0, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100))).alias(f"c{k}") for k in range(50)])
    df = df.cache()
    df.count()
    tracker, counts = spark.sparkContext.statusTracker(), []
    for k in (5, 50):
        spark.sparkContext.setJobGroup(f"corr{k}", "")
        found = explore.correlation_pairs(df, list(combinations(df.columns[:k], 2)))
        counts.append(len(tracker.getJobIdsForGroup(f"corr{k}")))
        pair = found.where("col_a = 'c1' AND col_b = 'c4'").first()
        assert abs(pair["correlation"] - df.select(F.corr("c1", "c4")).first()[0]) < 1e-9
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1] <= 4


def gappy(spark):
    rows = [(k if k != "n" else None, t if t % 5 else None, i, v) for i, (k, t, v) in enumerate(
        [("abn"[i % 3], i % 20, None if i % 4 == 0 else i) for i in range(100)])]
    return spark.createDataFrame(rows, "k string, t long, i long, v long")


def test_spans_lose_no_rows_with_nulls(spark):
    from sondeo.operators import ordering

    df = gappy(spark)
    span = F.floor(F.col("t") / 3)
    plain = ordering.running_number(df, ["k"], ["t", "i"], "n")
    split = ordering.running_number(df, ["k"], ["t", "i"], "n", span)
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect())) and split.count() == 100
    whole = ordering.forward_filled(df, ["k"], "t", ["v"], F.lit(0), ["i"])
    filled = ordering.forward_filled(df, ["k"], "t", ["v"], span, ["i"])
    assert sorted(map(str, filled.collect())) == sorted(map(str, whole.collect()))
    lagged = ordering.lagged(df.withColumnsRenamed({"t": "to"}), ["k"], ["to", "i"], "v", [1, 2], F.floor(F.col("to") / 3), "i")
    assert lagged.count() == 100


@pytest.mark.parametrize("by", [None, ["k"]])
def test_running_totals_agree_on_both_paths(spark, by):
    from sondeo.operators import ordering

    df = gappy(spark).groupBy("k", "t").agg(F.count("*").alias("n"))
    df = df if by else df.groupBy("t").agg(F.sum("n").alias("n"))
    found = [ordering.running_total(df, "t", {"before": "n"}, by, rows).collect() for rows in (10**6, 7)]
    assert sorted(map(str, found[0])) == sorted(map(str, found[1]))


def test_auc_with_null_scores_agrees_on_both_paths(spark, monkeypatch):
    from sondeo.operators import metrics, ordering

    df = spark.range(1000).select(F.when(F.col("id") % 7 != 0, F.col("id") * 37 % 501).cast("double").alias("s"), (F.col("id") % 3 == 0).alias("y"))
    whole = metrics.roc_auc(df, "s", F.col("y")).first()
    split = ordering.running_total

    def narrow(groups, order, totals, by=None):
        return split(groups, order, totals, by, 40)

    monkeypatch.setattr(metrics, "running_total", narrow)
    again = metrics.roc_auc(df, "s", F.col("y")).first()
    assert (round(again["roc_auc"], 12), again["positives"]) == (round(whole["roc_auc"], 12), whole["positives"])


def test_quantiles_by_group_keep_the_null_group_on_every_path(spark, monkeypatch):
    from sondeo.operators import quantiles

    df = gappy(spark)
    found = []
    for most, large in ((64, 10**9), (1, 10**9), (1, 1)):
        monkeypatch.setattr(quantiles, "MOST_SERIES", most)
        monkeypatch.setattr(quantiles, "EXACT_ROWS", large)
        rows = quantiles.quantile_rows(df, ["i", "v"], [0.25, 0.5], ["k"]).collect()
        found.append(sorted(str((r["k"], r["column"], r["n"], r["quantiles"])) for r in rows))
    assert len(found[0]) == 6 and found[0] == found[1] == found[2]


def test_time_since_previous_counts_null_keys_as_one(spark):
    from sondeo.operators import ordering

    df = gappy(spark).select("k", "t").where("t IS NOT NULL").distinct()
    found = ordering.time_since_previous(df, ["k"], F.col("t"), F.floor(F.col("t") / 3), "since")
    for key in ("a", "b", None):
        rows = sorted((r["t"], r["since"]) for r in found.where(F.col("k").eqNullSafe(F.lit(key))).collect())
        assert rows and [s for _, s in rows] == [None, *(b[0] - a[0] for a, b in zip(rows, rows[1:]))]


def test_masks_and_hashes(spark):
    df = spark.createDataFrame([(1, "abcdefg", "x"), (2, "ab", None)], "id int, a string, b string")
    assert column(clean.mask_columns(df, ["a"]), "a") == ["***defg", "**"]
    hashed = column(clean.hash_columns(df, ["b"], "s"), "b")
    assert len(hashed[0]) == 64 and hashed[1] is None


def test_clusters_and_components(spark):
    df = spark.range(60).select("id", (F.col("id") % 2 * 100 + F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 2 * 50).cast("double").alias("b"))
    found = {(r["id"] % 2, r["cluster"]) for r in features.clustered(df, ["a", "b"], 2).collect()}
    assert len(found) == 2
    scores, shares = features.principal_components(df, ["a", "b"], 2)
    assert scores.columns == ["id", "pc_1", "pc_2"] and shares[0] > 0.95 and abs(sum(shares) - 1) < 1e-9


def test_constant_columns_have_no_zscore_row(spark):
    df = spark.range(5).select(F.lit(1).alias("a"), F.lit(None).cast("int").alias("b"))
    assert clean.zscore_outliers(df, ["a", "b"]).collect() == []


@pytest.mark.parametrize("span_rows", [10, 10_000])
def test_folds_are_even_per_class(spark, span_rows):
    # One class holds most of the rows.
    df = spark.createDataFrame([(i, "hot" if i % 7 else f"c{i % 3}") for i in range(500)], "id int, y string")
    folded = ordering.assign_folds(df, "id", "y", span_rows=span_rows)
    sizes = {}
    for r in folded.groupBy("y", "fold").count().collect():
        sizes.setdefault(r["y"], []).append(r["count"])
    assert all(len(s) == 5 and max(s) - min(s) <= 1 for s in sizes.values())


def test_spans_do_not_change_folds(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(300)], "id int, y int")
    one = ordering.assign_folds(df, "id", "y").orderBy("id").collect()
    assert one == ordering.assign_folds(df, "id", "y", span_rows=7).orderBy("id").collect()


def test_spans_do_not_change_running_totals(spark):
    rng = random.Random(2)
    data = sorted({round(rng.gauss(0, 1), 3) for _ in range(400)})
    df = spark.createDataFrame([(v, i % 5, "ab"[i % 2]) for i, v in enumerate(data)], "s double, n int, g string")
    for by in (None, ["g"]):
        whole = ordering.running_total(df, "s", {"t": "n"}, by).orderBy("s").collect()
        assert whole == ordering.running_total(df, "s", {"t": "n"}, by, span_rows=30).orderBy("s").collect()


def test_permutation_keeps_values_and_moves_rows(spark):
    df = spark.createDataFrame([(i, i * 10, None if i % 4 == 0 else i) for i in range(200)], "id int, a int, b int")
    moved = ordering.permuted(df, ["a", "b"], "id", "p_").collect()
    assert sorted(r["p_a"] for r in moved) == sorted(r["a"] for r in moved)
    assert sum(r["p_b"] is None for r in moved) == 50
    assert sum(r["p_a"] != r["a"] for r in moved) == 200


def test_rolling_pieces_agree(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, "hot" if rng.random() < 0.6 else "k", rng.randint(0, 500)) for i in range(300)], "id int, k string, t int")
    data = df.collect()
    for pieces in (1, 3):
        rolled = ordering.rolling_by_time(df, ["k"], F.col("t"), 60, {"n": F.count("*")}, pieces).collect()
        assert len(rolled) == 300
        for r in rolled:
            assert r["n"] == sum(d["k"] == r["k"] and r["t"] - 60 <= d["t"] <= r["t"] for d in data)


def test_forward_fill_crosses_spans(spark):
    data = [(1, 0, 5.0), (2, 3, None), (3, 25, None), (4, 26, 7.0), (5, 60, None)]
    df = spark.createDataFrame([("k", i, t, v) for i, t, v in data], "k string, id int, t int, v double")
    filled = ordering.forward_filled(df, ["k"], "t", ["v"], F.floor(F.col("t") / 10))
    assert column(filled, "v") == [5.0, 5.0, 5.0, 7.0, 7.0]


def test_redundant_pair_drops_left_on_a_tie(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i % 3)) for i in range(60)], "a double, b double, c double")
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.1)], "feature string, mi double")
    assert [r[0] for r in selection.redundant_features(df, ["a", "b", "c"], scores).collect()] == ["a"]


def test_uninformative_features_fall_back_to_ten(spark):
    df = spark.createDataFrame([(1.0, 1.0, "k") for _ in range(20)], "a double, b double, y string")
    assert {r["feature"] for r in selection.select_features(df, "y", ["a", "b"]).collect()} == {"a", "b"}


def test_group_median_and_zscore(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "a", None), (4, "b", None)], "id int, g string, v double")
    assert column(clean.impute_group_median(df, "v", ["g"]), "v") == [1.0, 3.0, 2.0, None]
    flat = spark.createDataFrame([(0.0,)] * 30 + [(100.0,)], "v double")
    assert [tuple(r) for r in clean.zscore_outliers(flat, ["v"]).collect()] == [("v", 1)]


def test_registry_names_and_sql(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "a int")
    doubled = registry.sql_transform(df, "SELECT a, a * :k AS b FROM {df} ORDER BY a", k=2)
    assert [r["b"] for r in doubled.collect()] == [2, 4, 6]
    assert "drop_duplicates" in [o.name for o in registry.list_operators("cleaning")]
    assert registry.apply(df.union(df), "drop_duplicates").count() == 3
    with pytest.raises(KeyError):
        registry.get("nothing")
