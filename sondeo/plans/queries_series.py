"""Time-ordered and association queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondeo.functions.timestamps import day, wall_micros
from sondeo.operators import ordering, rolling, series
from sondeo.plans.catalog import query, table

_DAY = 86_400_000_000


def _events(spark, folder):
    return table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query(
    """SELECT event_id, count(*) OVER w AS n_7d, round(avg(value) OVER w, 9) AS mean_7d, min(value) OVER w AS min_7d,
      max(value) OVER w AS max_7d, round(stddev_samp(value) OVER w, 4) AS std_7d
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)"""
)
def rolling_7d(spark, folder):
    stats = {"n_7d": "rows", "mean_7d": "avg", "min_7d": "min", "max_7d": "max", "std_7d": "std"}
    rolled = rolling.rolling_summary(_events(spark, folder), ["user_id"], wall_micros("ts"), 7 * _DAY, "value", stats)
    return rolled.select(
        "event_id", "n_7d", F.round("mean_7d", 9).alias("mean_7d"), "min_7d", "max_7d",
        F.round("std_7d", 4).alias("std_7d"),
    )


@query(
    """SELECT event_id, count(*) OVER w AS n_30d, round(avg(value) OVER w, 9) AS mean_30d
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)"""
)
def rolling_30d(spark, folder):
    stats = {"n_30d": "rows", "mean_30d": "avg"}
    rolled = rolling.rolling_summary(_events(spark, folder), ["user_id"], wall_micros("ts"), 30 * _DAY, "value", stats)
    return rolled.select("event_id", "n_30d", F.round("mean_30d", 9).alias("mean_30d"))


@query(
    """SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS micros_since
    FROM events"""
)
def time_since(spark, folder):
    since = ordering.time_since_previous(
        _events(spark, folder), ["user_id"], wall_micros("ts"), day("ts"), "micros_since", ["event_id"]
    )
    return since.select("event_id", "micros_since")


@query(
    """SELECT user_id FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)
    ORDER BY (((user_id + 42) % 2147483648) * 2654435761) % 4294967296, user_id LIMIT 10"""
)
def key_sample(spark, folder):
    return ordering.sampled_keys(_events(spark, folder), "user_id")


@query(
    """SELECT user_id, event_id, value, lag(value, 1) OVER w AS value_lag_1, lag(value, 7) OVER w AS value_lag_7,
      lag(value, 30) OVER w AS value_lag_30 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def lag_features(spark, folder):
    return ordering.lagged(
        _events(spark, folder), ["user_id"], ["ts", "event_id"], "value", [1, 7, 30], day("ts"), "event_id"
    )


@query(
    """SELECT event_id, user_id, ts, coalesce(last_value(known IGNORE NULLS) OVER
        (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS known
    FROM (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS known FROM events)"""
)
def forward_fill(spark, folder):
    sparse = _events(spark, folder).select(
        "event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("known")
    )
    return ordering.forward_filled(sparse, ["user_id"], "ts", ["known"], day("ts"), ["event_id"])


@query(
    """WITH l AS (SELECT value, lag(value, 1) OVER w AS a, lag(value, 2) OVER w AS b FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT 1 AS lag, round(corr(value, a), 4) AS autocorrelation FROM l UNION ALL SELECT 2, round(corr(value, b), 4) FROM l"""
)
def autocorrelation(spark, folder):
    rows = series.autocorrelation(
        _events(spark, folder), ["user_id"], ["ts", "event_id"], "value", [1, 2], day("ts"), "event_id"
    )
    return rows.withColumn("autocorrelation", F.round("autocorrelation", 4))


@query(
    """SELECT event_type, count(*) AS n, round(regr_slope(value, CAST(event_id AS DOUBLE)) * 1000, 6) AS slope
    FROM events GROUP BY event_type"""
)
def trend_slope(spark, folder):
    rows = series.trend_slope(_events(spark, folder), F.col("event_id"), "value", ["event_type"])
    return rows.withColumn("slope", F.round(F.col("slope") * 1000, 6))


@query(
    """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2),
      g AS (SELECT a, b, (SELECT sum(n) FROM c y WHERE y.a = ra.a) * (SELECT sum(n) FROM c y WHERE y.b = rb.b) / (SELECT sum(n) FROM c) AS e
        FROM (SELECT DISTINCT a FROM c) ra, (SELECT DISTINCT b FROM c) rb)
    SELECT round(sum((coalesce(n, 0) - e) * (coalesce(n, 0) - e) / e), 4) AS chi2,
      (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof, CAST(sum(n) AS BIGINT) AS n FROM g LEFT JOIN c USING (a, b)"""
)
def chi_square(spark, folder):
    result = series.chi_square(table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus")
    return result.withColumn("chi2", F.round("chi2", 4))


@query(
    """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O",
      count(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY o_orderpriority"""
)
def crosstab(spark, folder):
    return series.crosstab(table(spark, folder, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


# Weights per line status, as a region or season would have them.
_WEIGHTS = [("F", 0.5, 0.3, 0.2), ("O", 0.2, 0.3, 0.5)]
_RISK_SQL = """
r AS (SELECT l_orderkey, l_linenumber, l_linestatus, l_quantity * 2 AS flood, l_discount * 1000 AS drought, l_tax * 1000 AS fire FROM lineitem),
w(l_linestatus, wf, wd, wi) AS (VALUES ('F', 0.5::DOUBLE, 0.3::DOUBLE, 0.2::DOUBLE), ('O', 0.2, 0.3, 0.5)),
fused AS (SELECT l_orderkey, l_linenumber, l_linestatus, flood, drought, fire, flood * wf + drought * wd + fire * wi AS risk FROM r LEFT JOIN w USING (l_linestatus))
"""


def _fused(spark, folder):
    weights = spark.createDataFrame(
        _WEIGHTS, "l_linestatus string, w_flood double, w_drought double, w_fire double"
    )
    risks = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_linestatus",
        (F.col("l_quantity") * 2).alias("flood"),
        (F.col("l_discount") * 1000).alias("drought"),
        (F.col("l_tax") * 1000).alias("fire"),
    )
    return series.risk_fusion(risks, weights, ["l_linestatus"], ["flood", "drought", "fire"])


@query(
    f"WITH {_RISK_SQL} SELECT l_linestatus, l_orderkey, l_linenumber, flood, drought, fire, round(risk, 4) AS risk FROM fused"
)
def risk_fusion(spark, folder):
    return _fused(spark, folder).withColumn("risk", F.round("risk", 4))


@query(
    f"""WITH {_RISK_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN flood > 70 AND l_linenumber * 50 < 250 THEN 'drainage_expansion' END AS action
    FROM fused WHERE risk > 60"""
)
def risk_alerts(spark, folder):
    alerted = series.alerts(_fused(spark, folder), "risk", 60.0)
    action = series.flood_action(F.col("flood"), F.col("l_linenumber") * 50)
    return alerted.select("l_orderkey", "l_linenumber", action.alias("action"))


@query(
    """WITH s AS (SELECT p_partkey, p_brand, p_size * (p_partkey % 10) * 0.5 / nullif(p_retailprice - 900, 0) AS priority FROM part)
    SELECT p_brand, p_partkey, round(priority, 6) AS priority, rank FROM
      (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY priority DESC NULLS LAST, p_partkey) AS INTEGER) AS rank FROM s) WHERE rank <= 3"""
)
def ranked_actions(spark, folder):
    actions = table(spark, folder, "part").select(
        "p_partkey",
        "p_brand",
        F.col("p_size").cast("double").alias("impact"),
        (F.col("p_partkey") % 10).cast("double").alias("risk"),
        F.lit(0.5).alias("feasibility"),
        (F.col("p_retailprice") - 900).alias("cost"),
    )
    ranked = series.ranked_actions(actions, ["p_brand"], "p_partkey", 3)
    return ranked.select("p_brand", "p_partkey", F.round("priority", 6).alias("priority"), "rank")
