"""Exploration queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from sondeo.operators import explore
from sondeo.plans.catalog import query, table, union_sql
from sondeo.plans.inputs import DIRTY_ORDERS_SQL, LINEITEM_NUMBERS, dirty_orders

# Line items with columns derived so that some pairs correlate, one is constant, one has gaps.
RELATED_SQL = """
related AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
  l_extendedprice * (1 - l_discount) AS net,
  l_quantity + l_discount AS near_quantity,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE -l_extendedprice END AS gappy,
  CAST(1 AS DOUBLE) AS constant FROM lineitem)
"""
RELATED_COLUMNS = [*LINEITEM_NUMBERS, "net", "near_quantity", "gappy", "constant"]


def related(spark, folder):
    price = F.col("l_extendedprice")
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        *LINEITEM_NUMBERS,
        (price * (1 - F.col("l_discount"))).alias("net"),
        (F.col("l_quantity") + F.col("l_discount")).alias("near_quantity"),
        F.when(F.col("l_orderkey") % 5 != 0, -price).alias("gappy"),
        F.lit(1.0).alias("constant"),
    )


def corr_sql(a: str, b: str, source: str = "related") -> str:
    return (
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, CASE WHEN isnan(r) THEN NULL ELSE r END AS correlation "
        f"FROM (SELECT corr({a}, {b}) AS r FROM {source})"
    )


PAIRS_SQL = "\nUNION ALL\n".join(corr_sql(a, b) for a, b in combinations(RELATED_COLUMNS, 2))


@query(
    f"""WITH {RELATED_SQL}, pairs AS ({PAIRS_SQL})
    SELECT col_a, col_b, round(correlation, 4) AS correlation FROM pairs WHERE abs(correlation) > 0.5
    ORDER BY abs(round(correlation, 4)) DESC, col_a, col_b LIMIT 20"""
)
def corr_pairs(spark, folder):
    return explore.high_correlations(related(spark, folder), RELATED_COLUMNS)


@query(f"WITH {RELATED_SQL}, pairs AS ({PAIRS_SQL}) SELECT col_a, col_b, round(correlation, 4) AS correlation FROM pairs")
def corr_matrix(spark, folder):
    matrix = explore.correlation_matrix(related(spark, folder), RELATED_COLUMNS)
    return matrix.withColumn("correlation", F.round("correlation", 4))


_TARGET = "\nUNION ALL\n".join(corr_sql(c, "l_extendedprice") for c in RELATED_COLUMNS if c != "l_extendedprice")


@query(
    f"""WITH {RELATED_SQL}, pairs AS ({_TARGET})
    SELECT col_a AS "column", round(correlation, 4) AS correlation, round(abs(correlation), 4) AS abs_correlation
    FROM pairs WHERE abs(correlation) > 0.1"""
)
def corr_target(spark, folder):
    return explore.target_correlations(related(spark, folder), "l_extendedprice", RELATED_COLUMNS)


@query(
    f"""WITH {DIRTY_ORDERS_SQL}, m AS (SELECT o_orderpriority AS category, round(avg(o_totalprice), 4) AS mean
      FROM dirty WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority)
    SELECT * FROM m WHERE (SELECT count(*) FROM m) BETWEEN 2 AND 20"""
)
def group_means(spark, folder):
    return explore.group_means(dirty_orders(spark, folder), "o_orderpriority", "o_totalprice")


@query(
    """WITH s AS (SELECT min(value) AS lo, (max(value) - min(value)) / 30 AS w FROM events),
      c AS (SELECT CAST(least(floor((value - lo) / w) + 1, 30) AS INTEGER) AS bin, count(*) AS n
        FROM events, s WHERE value IS NOT NULL GROUP BY 1)
    SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + (b.bin - 1) * w, 4) AS low, round(lo + b.bin * w, 4) AS high,
      coalesce(n, 0) AS n, round((SELECT quantile_cont(value, 0.5) FROM events), 4) AS median
    FROM range(1, 31) b(bin) CROSS JOIN s LEFT JOIN c ON c.bin = b.bin"""
)
def histogram(spark, folder):
    bins = explore.histogram_with_median(table(spark, folder, "events"), "value")
    return bins.withColumns({c: F.round(c, 4) for c in ("low", "high", "median")})


_BOX = """
SELECT l_returnflag, '{c}' AS "column", count({c}) AS n, round(any_value(q1), 4) AS q1, round(any_value(med), 4) AS median,
  round(any_value(q3), 4) AS q3,
  round(min({c}) FILTER (WHERE {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS whisker_low,
  round(max({c}) FILTER (WHERE {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS whisker_high,
  count(*) FILTER (WHERE {c} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
FROM spread JOIN (SELECT l_returnflag, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med,
  quantile_cont({c}, 0.75) AS q3 FROM spread GROUP BY l_returnflag) USING (l_returnflag) GROUP BY l_returnflag
"""


@query(
    f"""WITH spread AS (SELECT l_returnflag, l_quantity * l_quantity * l_quantity AS cubed, l_extendedprice FROM lineitem)
    {union_sql(_BOX, ["cubed", "l_extendedprice"])}"""
)
def box_summary(spark, folder):
    quantity = F.col("l_quantity")
    df = table(spark, folder, "lineitem").select(
        "l_returnflag", (quantity * quantity * quantity).alias("cubed"), "l_extendedprice"
    )
    boxes = explore.box_summary(df, ["cubed", "l_extendedprice"], "l_returnflag")
    return boxes.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")})


@query(
    """SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 15"""
)
def count_chart(spark, folder):
    return explore.count_chart(table(spark, folder, "part"), "p_brand")


@query("""SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality ORDER BY n DESC, quality LIMIT 15""")
def target_chart(spark, folder):
    return explore.target_chart(table(spark, folder, "labels"), "quality")


@query(
    """SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem
    WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 1000"""
)
def pair_sample(spark, folder):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return explore.pair_sample(table(spark, folder, "lineitem"), order, LINEITEM_NUMBERS)


_RECOMMEND_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", "double_price"]
_RECOMMEND = "\nUNION ALL\n".join(
    corr_sql(c, "o_totalprice", "wide") for c in _RECOMMEND_COLUMNS if c != "o_totalprice"
)


@query(
    f"""WITH {DIRTY_ORDERS_SQL}, wide AS (SELECT *, o_totalprice * 2 + 1 AS double_price FROM dirty),
      pairs AS ({_RECOMMEND}),
      c AS (
        SELECT col_a AS feature, 1 AS priority FROM pairs WHERE abs(correlation) > 0.1
        UNION ALL SELECT unnest(['o_orderkey', 'o_custkey', 'double_price']), 2
        UNION ALL SELECT 'o_orderstatus', 3 FROM wide HAVING count(DISTINCT o_orderstatus) <= 20
        UNION ALL SELECT 'o_orderpriority', 3 FROM wide HAVING count(DISTINCT o_orderpriority) <= 20),
      g AS (SELECT feature, min(priority) AS priority FROM c GROUP BY feature)
    SELECT feature, priority, row_number() OVER (ORDER BY priority,
      list_position(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderpriority', 'double_price'], feature)) AS position
    FROM g"""
)
def feature_recommend(spark, folder):
    df = dirty_orders(spark, folder)
    wide = df.withColumn("double_price", F.col("o_totalprice") * 2 + 1)
    return explore.recommended_features(wide, "o_totalprice")


_SKEW = """SELECT 'univariate' AS kind, '{c}' AS "column", NULL AS other, 'skewness' AS metric,
  round(coalesce(skewness({c}), 0), 4) AS value FROM wide"""


@query(
    f"""WITH {DIRTY_ORDERS_SQL}, wide AS (SELECT o_totalprice, o_orderstatus, o_orderpriority, o_totalprice * 2 + 1 AS double_price FROM dirty)
    {union_sql(_SKEW, ["o_totalprice", "double_price"])}
    UNION ALL SELECT 'bivariate', 'double_price', NULL, 'correlation', round(corr(double_price, o_totalprice), 4) FROM wide
    UNION ALL SELECT 'group_mean', 'o_orderstatus', o_orderstatus, 'mean', round(avg(o_totalprice), 4) FROM wide GROUP BY o_orderstatus
    UNION ALL SELECT 'group_mean', 'o_orderpriority', o_orderpriority, 'mean', round(avg(o_totalprice), 4) FROM wide
      WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority
    UNION ALL SELECT 'correlation', 'o_totalprice', 'double_price', 'correlation', round(corr(double_price, o_totalprice), 4) FROM wide"""
)
def findings(spark, folder):
    df = dirty_orders(spark, folder).drop("o_orderkey", "o_custkey")
    return explore.findings(df.withColumn("double_price", F.col("o_totalprice") * 2 + 1), "o_totalprice")
