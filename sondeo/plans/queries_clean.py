"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondeo.operators import clean
from sondeo.plans.catalog import query, table
from sondeo.plans.inputs import DIRTY_ORDERS_SQL, LINEITEM_NUMBERS, dirty_orders
from sondeo.sources import canonical

_KEYS = ["o_orderkey", "o_custkey"]


@query(f"WITH {DIRTY_ORDERS_SQL} SELECT DISTINCT * FROM dirty")
def drop_duplicates(spark, folder):
    return clean.drop_duplicates(dirty_orders(spark, folder))


@query(
    f"""WITH {DIRTY_ORDERS_SQL}
    SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
      round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM dirty)), 4) AS o_totalprice FROM dirty"""
)
def impute_median(spark, folder):
    filled = clean.impute_median(dirty_orders(spark, folder), exclude=_KEYS)
    return filled.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query(
    f"""WITH {DIRTY_ORDERS_SQL}
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
      coalesce(o_orderpriority, (SELECT o_orderpriority FROM dirty WHERE o_orderpriority IS NOT NULL
        GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority FROM dirty"""
)
def impute_mode(spark, folder):
    return clean.impute_mode(dirty_orders(spark, folder))


_CAP = ", ".join(
    f"round(least(greatest(spiked.{c}, q.{c}[1] - 3 * (q.{c}[2] - q.{c}[1])), q.{c}[2] + 3 * (q.{c}[2] - q.{c}[1])), 4) AS {c}"
    for c in LINEITEM_NUMBERS
)


@query(
    f"""WITH spiked AS (SELECT l_orderkey, l_linenumber, l_discount, l_tax,
        CASE WHEN l_orderkey % 29 = 0 THEN l_quantity * 50 ELSE l_quantity END AS l_quantity,
        CASE WHEN l_orderkey % 31 = 0 THEN -10 * l_extendedprice ELSE l_extendedprice END AS l_extendedprice
        FROM lineitem),
      q AS (SELECT {", ".join(f"quantile_cont({c}, [0.25, 0.75]) AS {c}" for c in LINEITEM_NUMBERS)} FROM spiked)
    SELECT l_orderkey, l_linenumber, {_CAP} FROM spiked, q"""
)
def cap_iqr(spark, folder):
    spiked = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_orderkey") % 29 == 0, F.col("l_quantity") * 50).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_orderkey") % 31 == 0, F.col("l_extendedprice") * -10)
        .otherwise(F.col("l_extendedprice"))
        .alias("l_extendedprice"),
        "l_discount",
        "l_tax",
    )
    capped = clean.cap_outliers(spiked, LINEITEM_NUMBERS)
    return capped.withColumns({c: F.round(c, 4) for c in LINEITEM_NUMBERS})


_CLEANED_SQL = f"""
{DIRTY_ORDERS_SQL},
d AS (SELECT DISTINCT * FROM dirty),
filled AS (SELECT o_orderkey, o_custkey, o_orderstatus,
    coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM d)) AS o_totalprice,
    coalesce(o_orderpriority, (SELECT o_orderpriority FROM d WHERE o_orderpriority IS NOT NULL
      GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority FROM d),
f AS (SELECT q1 - 3 * (q3 - q1) AS lo, q3 + 3 * (q3 - q1) AS hi FROM
    (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM filled)),
cleaned AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
    least(greatest(o_totalprice, lo), hi) AS o_totalprice FROM filled, f)
"""


@query(
    f"""WITH {_CLEANED_SQL}
    SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, round(o_totalprice, 4) AS o_totalprice FROM cleaned"""
)
def clean_table(spark, folder):
    cleaned, _ = clean.clean(dirty_orders(spark, folder), exclude=_KEYS)
    return cleaned.withColumn("o_totalprice", F.round("o_totalprice", 4))


_LOG_SQL = f"""
{_CLEANED_SQL},
log AS (
  SELECT 1 AS step, 'drop_duplicates' AS operation,
    (SELECT count(*) FROM dirty) - (SELECT count(*) FROM d) AS rows_affected
  UNION ALL SELECT 2, 'fill_numeric_missing', (SELECT count(*) - count(o_totalprice) FROM d)
  UNION ALL SELECT 3, 'fill_categorical_missing', (SELECT count(*) - count(o_orderpriority) FROM d)
  UNION ALL SELECT 4, 'cap_outliers_iqr', (SELECT count(*) FROM filled, f WHERE o_totalprice < lo OR o_totalprice > hi))
"""


@query(f"WITH {_LOG_SQL} SELECT step, operation, rows_affected, 'applied' AS status FROM log")
def cleaning_log(spark, folder):
    _, log = clean.clean(dirty_orders(spark, folder), exclude=_KEYS)
    return log


@query(f"WITH {_LOG_SQL} SELECT CAST(sum(rows_affected) AS BIGINT) AS total_rows_affected FROM log")
def cleaning_total(spark, folder):
    _, log = clean.clean(dirty_orders(spark, folder), exclude=_KEYS)
    return clean.total_rows_affected(log)


@query(
    """SELECT c_custkey AS id, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier"""
)
def union_by_name(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("segment"),
    )
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_acctbal").alias("acctbal"), F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"),
    )
    return canonical.union_all(customers, suppliers)


@query(
    """SELECT l_orderkey, l_quantity AS latitude, l_extendedprice AS temperature, l_linenumber AS population,
      coalesce(CASE WHEN l_orderkey % 2 = 0 THEN l_discount END, l_tax) AS precipitation,
      l_returnflag AS region, 'wildfire' AS event_type, 'N' AS satellite, l_quantity AS latitude_copy FROM lineitem"""
)
def canonicalise(spark, folder):
    odd = table(spark, folder, "lineitem").select(
        "l_orderkey",
        F.col("l_quantity").alias("Center Lat"),
        F.col("l_extendedprice").alias("Avg_Temp"),
        F.col("l_linenumber").alias("population"),
        F.when(F.col("l_orderkey") % 2 == 0, F.col("l_discount")).alias("Rain (mm)"),
        F.col("l_tax").alias("PRECIPITATION_2"),
        F.col("l_returnflag").alias("Region"),
    )
    named = canonical.canonicalise(odd, canonical.WILDFIRE_RULES)
    named = canonical.with_defaults(named, {"event_type": "wildfire", "satellite": "N", "region": "none"})
    named = canonical.with_copies(named, {"latitude": "latitude_copy", "absent": "nowhere"})
    return canonical.keep_existing(
        named,
        ["l_orderkey", "latitude", "longitude", "temperature", "population", "precipitation", "region",
         "event_type", "satellite", "latitude_copy"],
    )


@query(
    """SELECT o_orderkey, o_orderpriority, round(coalesce(o_totalprice, m), 4) AS o_totalprice FROM
    (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders)
    LEFT JOIN (SELECT o_orderpriority, quantile_cont(CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END, 0.5) AS m
      FROM orders GROUP BY o_orderpriority) USING (o_orderpriority)"""
)
def group_median_impute(spark, folder):
    df = table(spark, folder, "orders").select(
        "o_orderkey",
        "o_orderpriority",
        F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")).alias("o_totalprice"),
    )
    filled = clean.impute_group_median(df, "o_totalprice", ["o_orderpriority"])
    return filled.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query(
    f"""WITH {DIRTY_ORDERS_SQL}
    SELECT 'o_totalprice' AS "column", count(*) AS outliers FROM dirty,
      (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM dirty)
    WHERE abs(o_totalprice - m) > 3 * s"""
)
def zscore_outliers(spark, folder):
    return clean.zscore_outliers(dirty_orders(spark, folder), ["o_totalprice"])


@query(
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso_date,
      CAST(regexp_extract(o_orderpriority, '([-+]?[0-9]+(\\.[0-9]+)?)', 1) AS DOUBLE) AS priority FROM orders"""
)
def normalised_dates_and_numbers(spark, folder):
    key = F.col("o_orderkey")
    written = F.when(key % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(
        key % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")
    ).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, folder, "orders").select(
        "o_orderkey",
        clean.parsed_date(written, ["yyyy-MM-dd", "yyyyMMdd", "dd/MM/yyyy"]).alias("iso_date"),
        clean.parsed_number(F.col("o_orderpriority")).alias("priority"),
    )


@query(
    """SELECT c_custkey, variant, coalesce(
      CASE WHEN 1 - CAST(levenshtein(lower(trim(variant)), lower(c_mktsegment)) AS DOUBLE)
        / greatest(length(trim(variant)), length(c_mktsegment)) >= 0.85 THEN c_mktsegment END, variant) AS variant_canonical
    FROM (SELECT c_custkey, c_mktsegment, CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) || ' '
      WHEN 1 THEN c_mktsegment || 'X' ELSE substr(c_mktsegment, 1, 3) END AS variant FROM customer)"""
)
def canonical_categories(spark, folder):
    name, key = F.col("c_mktsegment"), F.col("c_custkey") % 3
    variant = (
        F.when(key == 0, F.concat(F.lower(name), F.lit(" ")))
        .when(key == 1, F.concat(name, F.lit("X")))
        .otherwise(F.substring(name, 1, 3))
    )
    df = table(spark, folder, "customer").select("c_custkey", variant.alias("variant"))
    canon = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return clean.canonical_categories(df, "variant", canon)


@query(
    """WITH named AS (SELECT p_partkey, p_name || ' ' || p_type AS name FROM part),
    worn AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN substr(name, 1, 1) || substr(name, 3) WHEN 1 THEN upper(name) || 'x '
      WHEN 2 THEN substr(name, 3) || 'q' WHEN 3 THEN substr(name, 1, 4) || '-' || substr(name, 5) ELSE substr(name, 1, 6) END AS worn
      FROM named),
    near AS (SELECT v.worn, n.name, 1 - CAST(levenshtein(lower(trim(v.worn)), lower(trim(n.name))) AS DOUBLE)
        / greatest(length(trim(v.worn)), length(trim(n.name))) AS ratio
      FROM (SELECT DISTINCT worn FROM worn) v, (SELECT DISTINCT name FROM named) n),
    best AS (SELECT worn, name FROM near WHERE ratio >= 0.85 QUALIFY row_number() OVER (PARTITION BY worn ORDER BY ratio DESC, name) = 1)
    SELECT p_partkey, worn, coalesce(best.name, worn) AS worn_canonical FROM worn LEFT JOIN best USING (worn)"""
)
def canonical_names(spark, folder):
    named = table(spark, folder, "part").select("p_partkey", F.concat("p_name", F.lit(" "), "p_type").alias("name"))
    name, key = F.col("name"), F.col("p_partkey") % 5
    worn = (
        F.when(key == 0, F.expr("substring(name, 1, 1) || substring(name, 3)"))
        .when(key == 1, F.concat(F.upper(name), F.lit("x ")))
        .when(key == 2, F.expr("substring(name, 3) || 'q'"))
        .when(key == 3, F.expr("substring(name, 1, 4) || '-' || substring(name, 5)"))
        .otherwise(F.expr("substring(name, 1, 6)"))
    )
    return clean.canonical_from_table(named.select("p_partkey", worn.alias("worn")), "worn", named, "name")


@query(
    """SELECT c_custkey, sha256('pepper' || c_name) AS c_name,
      CASE WHEN length(c_mktsegment) > 4 THEN repeat('*', length(c_mktsegment) - 4) || right(c_mktsegment, 4)
        ELSE repeat('*', length(c_mktsegment)) END AS c_mktsegment FROM customer"""
)
def masked_columns(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return clean.mask_columns(clean.hash_columns(df, ["c_name"], "pepper"), ["c_mktsegment"])
