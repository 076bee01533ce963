"""Profiling queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.operators import increments, ordering, profile
from sondeo.plans.catalog import query, table, union_sql
from sondeo.plans.inputs import DIRTY_ORDERS_SQL, LINEITEM_NUMBERS, dirty_orders

_PROFILE = """
SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing,
  round(CAST(count(*) - count({c}) AS DOUBLE) / count(*), 4) AS missing_pct,
  round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
  round(coalesce(skewness({c}), 0), 4) AS skewness, round(coalesce(kurtosis({c}), 0), 4) AS kurtosis,
  round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median,
  round(quantile_cont({c}, 0.75), 4) AS q3
FROM lineitem
"""


@query(union_sql(_PROFILE, LINEITEM_NUMBERS))
def profile_numeric(spark, folder):
    return profile.numeric_profile(table(spark, folder, "lineitem"), LINEITEM_NUMBERS)


_MISSING = """
SELECT '{c}' AS "column", count(*) - count({c}) AS missing,
  round(CAST(count(*) - count({c}) AS DOUBLE) / count(*), 4) AS missing_pct FROM dirty
"""
_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query(f"WITH {DIRTY_ORDERS_SQL} {union_sql(_MISSING, _ORDER_COLUMNS)}")
def profile_table(spark, folder):
    return profile.missing_rates(dirty_orders(spark, folder))


@query(
    f"""WITH {DIRTY_ORDERS_SQL}
    SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns, CAST(3 AS BIGINT) AS n_numeric,
      CAST(2 AS BIGINT) AS n_categorical,
      round((2.0 - CAST(count(o_totalprice) + count(o_orderpriority) AS DOUBLE) / count(*)) / 5, 4)
        AS avg_missing_pct FROM dirty"""
)
def table_shape(spark, folder):
    return profile.table_shape(dirty_orders(spark, folder))


@query(
    f"""WITH {DIRTY_ORDERS_SQL}, rates AS ({union_sql(_MISSING, _ORDER_COLUMNS)})
    SELECT * FROM rates WHERE missing_pct > 0 ORDER BY missing_pct DESC, "column" LIMIT 5"""
)
def worst_missing(spark, folder):
    return profile.worst_missing(dirty_orders(spark, folder))


_SUMMARY = """
SELECT '{c}' AS "column", {d} AS dtype, CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS nullable,
  count(DISTINCT {c}) AS distinct_values,
  (SELECT string_agg(v, '|' ORDER BY v) FROM
     (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM customer WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)) AS samples
FROM customer
"""
_CUSTOMER_TYPES = {
    "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int",
    "c_acctbal": "double", "c_mktsegment": "string",
}


@query("\nUNION ALL\n".join(_SUMMARY.format(c=c, d=f"'{d}'") for c, d in _CUSTOMER_TYPES.items()))
def schema_summary(spark, folder):
    return profile.schema_summary(table(spark, folder, "customer"))


_OUTLIERS = """
SELECT '{c}' AS "column", count(*) AS outliers FROM dirty_numbers,
  (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM dirty_numbers) q
WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) HAVING count(*) > 0
"""


@query(
    f"""WITH {DIRTY_ORDERS_SQL}, dirty_numbers AS (SELECT o_orderkey, o_custkey, o_totalprice FROM dirty)
    {union_sql(_OUTLIERS, ["o_orderkey", "o_custkey", "o_totalprice"])}"""
)
def outliers_iqr(spark, folder):
    return profile.outlier_counts(dirty_orders(spark, folder))


@query(
    f"""WITH {DIRTY_ORDERS_SQL}
    SELECT (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicates"""
)
def duplicate_count(spark, folder):
    return profile.duplicate_count(dirty_orders(spark, folder))


@query(
    """SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM
    (SELECT count(*) AS n FROM events GROUP BY user_id, event_type)"""
)
def duplicate_count_projected(spark, folder):
    return profile.duplicate_count(table(spark, folder, "events").select("user_id", "event_type"))


_TOP = """
(SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem
 WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, value LIMIT 10)
"""


@query(union_sql(_TOP, ["l_returnflag", "l_linestatus", "l_partkey", "l_suppkey"]))
def top_values(spark, folder):
    df = table(spark, folder, "lineitem")
    return profile.top_values(df, ["l_returnflag", "l_linestatus", "l_partkey", "l_suppkey"], 10)


@query(
    """SELECT quality, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(quality) FROM labels), 4) AS share
    FROM labels WHERE quality IS NOT NULL GROUP BY quality"""
)
def class_balance(spark, folder):
    return profile.class_balance(table(spark, folder, "labels"), "quality")


@query(
    """SELECT count(*) AS n_rows, CAST(3 AS BIGINT) AS n_columns, CAST(3 AS BIGINT) AS n_numeric,
      CAST(0 AS BIGINT) AS n_categorical, round(1 - CAST(count(doc_id) + count(quality) + count(toxic) AS DOUBLE) / 3 / count(*), 4) AS avg_missing_pct,
      CASE WHEN (SELECT count(*) FROM (SELECT DISTINCT * FROM labels)) < count(*) THEN 1 ELSE 0 END AS has_duplicates,
      CASE WHEN count(DISTINCT quality) = 2 THEN 'binary_classification'
           WHEN count(DISTINCT quality) <= 20 THEN 'multiclass_classification' ELSE 'regression' END AS task_type
    FROM labels"""
)
def data_traits(spark, folder):
    return profile.data_traits(table(spark, folder, "labels"), "quality")


@query(
    """SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns, CAST(3 AS BIGINT) AS n_numeric,
      CAST(2 AS BIGINT) AS n_categorical,
      round(1 - CAST(count(c_custkey) + count(c_name) + count(c_nationkey) + count(c_acctbal) + count(c_mktsegment) AS DOUBLE) / 5 / count(*), 4) AS avg_missing_pct,
      CASE WHEN (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) < count(*) THEN 1 ELSE 0 END AS has_duplicates,
      'classification' AS task_type FROM customer"""
)
def data_traits_text_target(spark, folder):
    return profile.data_traits(table(spark, folder, "customer"), "c_mktsegment")


_DISTINCT = """SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_values FROM lineitem"""
_LINEITEM_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINEITEM_NUMBERS, "l_returnflag", "l_linestatus",
]


@query(union_sql(_DISTINCT, _LINEITEM_COLUMNS))
def distinct_counts(spark, folder):
    return profile.distinct_counts(table(spark, folder, "lineitem"), _LINEITEM_COLUMNS)


_LABEL = """
SELECT '{c}' AS "column", s AS skewness, CASE WHEN s IS NULL THEN 'unknown' WHEN abs(s) < 0.5 THEN 'approximately_normal'
  WHEN s > 1 THEN 'right_skewed' WHEN s < -1 THEN 'left_skewed' ELSE 'moderately_skewed' END AS distribution
FROM (SELECT round(coalesce(skewness({c}), 0), 4) AS s FROM dirty)
"""


@query(
    f"""WITH {DIRTY_ORDERS_SQL} {union_sql(_LABEL, ["o_orderkey", "o_custkey", "o_totalprice"])}
    UNION ALL SELECT 'o_orderstatus', NULL, 'categorical' UNION ALL SELECT 'o_orderpriority', NULL, 'categorical'"""
)
def distribution_label(spark, folder):
    return profile.distributions(dirty_orders(spark, folder))


_PROFILE_NUMBERS = """
SELECT '{c}' AS "column", 'mean' AS metric, round(avg({c}), 4) AS value FROM customer
UNION ALL SELECT '{c}', 'std', round(stddev_samp({c}), 4) FROM customer
UNION ALL SELECT '{c}', 'min', CAST(min({c}) AS DOUBLE) FROM customer
UNION ALL SELECT '{c}', 'max', CAST(max({c}) AS DOUBLE) FROM customer
UNION ALL SELECT '{c}', 'skewness', round(skewness({c}), 4) FROM customer
UNION ALL SELECT '{c}', 'outliers', CAST(count(*) AS DOUBLE) FROM customer,
  (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM customer) q
  WHERE q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) HAVING count(*) > 0
"""
_PROFILE_ALL = """
SELECT '{c}' AS "column", 'missing_pct' AS metric,
  round(CAST(count(*) - count({c}) AS DOUBLE) / count(*), 4) AS value FROM customer
UNION ALL SELECT '{c}', 'distinct_values', CAST(count(DISTINCT {c}) AS DOUBLE) FROM customer
"""


@query(
    union_sql(_PROFILE_ALL, list(_CUSTOMER_TYPES))
    + "\nUNION ALL\n"
    + union_sql(_PROFILE_NUMBERS, ["c_custkey", "c_nationkey", "c_acctbal"])
    + """\nUNION ALL SELECT NULL, 'rows', CAST(count(*) AS DOUBLE) FROM customer
    UNION ALL SELECT NULL, 'duplicates',
      CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) AS DOUBLE) FROM customer"""
)
def data_profile(spark, folder):
    return profile.data_profile(table(spark, folder, "customer"))


@query(
    f"""WITH {DIRTY_ORDERS_SQL}, wide AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'x' END AS sparse FROM dirty)
    SELECT 'mostly_missing' AS warning, 'sparse' AS "column" FROM wide
    HAVING CAST(count(*) - count(sparse) AS DOUBLE) / count(*) > 0.5
    UNION ALL SELECT 'target_not_found', 'absent_target'"""
)
def validation_warnings(spark, folder):
    df = dirty_orders(spark, folder)
    wide = df.withColumn("sparse", F.when(F.col("o_orderkey") % 3 == 0, "x"))
    return profile.validation_warnings(wide, "absent_target")


@query(
    """SELECT event_id, ts, user_id, event_type, value FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn = 1"""
)
def latest_per_key(spark, folder):
    df = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return ordering.latest_per_key(df, ["user_id"], "ts", ["event_id"])


@query(
    """SELECT event_id, ts, user_id, event_type, value FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn <= 3"""
)
def last_k_per_key(spark, folder):
    df = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return ordering.top_k_per_key(df, ["user_id"], [F.desc("ts"), F.col("event_id")], 3)


@query(
    """WITH dirty AS (SELECT user_id, ts, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value,
        CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type FROM events)
    SELECT user_id, max(ts) AS ts,
      max({'t': ts, 'v': value}) FILTER (WHERE value IS NOT NULL)['v'] AS value,
      max({'t': ts, 'v': event_type}) FILTER (WHERE event_type IS NOT NULL)['v'] AS event_type
    FROM dirty GROUP BY user_id"""
)
def latest_known_per_key(spark, folder):
    df = table(spark, folder, "events").select(
        "user_id",
        "ts",
        F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("event_type"),
    )
    return ordering.latest_per_key(df, ["user_id"], "ts", skip_null=True)


@query(
    """SELECT c_custkey, bal_key, c_name FROM
    (SELECT c_custkey, c_name, round_even(c_acctbal / 1000, 0) AS bal_key,
       row_number() OVER (PARTITION BY round_even(c_acctbal / 1000, 0) ORDER BY c_custkey) AS rn FROM customer)
    WHERE rn = 1 ORDER BY c_custkey LIMIT 5"""
)
def first_per_rounded_key(spark, folder):
    df = table(spark, folder, "customer").select(
        "c_custkey", F.bround(F.col("c_acctbal") / 1000, 0).alias("bal_key"), "c_name"
    )
    return ordering.first_per_key(df, ["bal_key"], "c_custkey", 5)


_INCREMENTS = """
SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing,
  round(CAST(count(*) - count({c}) AS DOUBLE) / count(*), 4) AS missing_pct,
  CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  round(coalesce(skewness({c}), 0), 4) AS skewness, round(coalesce(kurtosis({c}), 0), 4) AS kurtosis
FROM lineitem
"""


# The states of the items of each ship year, merged, are the profile of all items.
@query(union_sql(_INCREMENTS, LINEITEM_NUMBERS))
def merged_profile(spark, folder):
    items = table(spark, folder, "lineitem").select(F.year("l_shipdate").alias("_year"), *LINEITEM_NUMBERS)
    years = [r[0] for r in items.select("_year").distinct().collect()]
    parts = [increments.profile_state(items.where(F.col("_year").eqNullSafe(y)).drop("_year")) for y in years]
    return increments.state_profile(increments.merge_states(reduce(DataFrame.unionAll, parts))).drop("distinct_estimate")
