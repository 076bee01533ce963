"""Inputs the queries share: driver tables with defects or roles laid over every row.

Each ``*_SQL`` is the same derivation for the checking engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeo.plans.catalog import table

# Orders with gaps, outliers and repeated rows. All orders stay in.
DIRTY_ORDERS_SQL = """
base AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL
         WHEN o_orderkey % 23 = 0 THEN o_totalprice * 20 ELSE o_totalprice END AS o_totalprice,
    CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders),
dirty AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE o_orderkey % 40 = 0)
"""


def dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    base = table(spark, folder, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.when(key % 17 == 0, None)
        .when(key % 23 == 0, F.col("o_totalprice") * 20)
        .otherwise(F.col("o_totalprice"))
        .alias("o_totalprice"),
        F.when(key % 19 == 0, None).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    return base.unionByName(base.where(key % 40 == 0))


# Every event as a detection somewhere on the globe.
DETECTIONS_SQL = """
detections AS (
  SELECT event_id, ts, event_type, value,
    CAST((event_id * 7919) % 18000 AS DOUBLE) / 100 - 90 AS latitude,
    CAST((event_id * 104729) % 36000 AS DOUBLE) / 100 - 180 AS longitude,
    value AS frp
  FROM events)
"""


def detections(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("event_id")
    return table(spark, folder, "events").select(
        "event_id",
        "ts",
        "event_type",
        "value",
        (((key * 7919) % 18000).cast("double") / 100 - 90).alias("latitude"),
        (((key * 104729) % 36000).cast("double") / 100 - 180).alias("longitude"),
        F.col("value").alias("frp"),
    )


# Every order as a day's weather reading at some place, with missing readings as -999.
WEATHER_SQL = """
weather AS (
  SELECT CAST((o_orderkey * 7919) % 18000 AS DOUBLE) / 100 - 90 AS latitude,
    CAST((o_orderkey * 104729) % 36000 AS DOUBLE) / 100 - 180 AS longitude,
    strftime(o_orderdate, '%Y%m%d') AS date,
    CAST(o_custkey % 40 AS DOUBLE) AS t2m,
    CAST(o_custkey % 40 + 5 AS DOUBLE) AS t2m_max,
    CAST(o_custkey % 40 - 5 AS DOUBLE) AS t2m_min,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / 50000 END AS prectotcorr,
    CAST(o_custkey % 97 AS DOUBLE) AS rh2m,
    CAST(o_orderkey % 13 AS DOUBLE) AS ws2m,
    CAST(o_orderkey % 29 AS DOUBLE) AS allsky_sfc_sw_dwn,
    CAST(o_orderkey % 7 AS DOUBLE) / 5 AS gwetroot
  FROM orders)
"""


def weather(spark: SparkSession, folder: str) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    rain = F.when(key % 3 == 0, F.lit(-999.0)).otherwise(F.col("o_totalprice") / 50000)
    return table(spark, folder, "orders").select(
        (((key * 7919) % 18000).cast("double") / 100 - 90).alias("latitude"),
        (((key * 104729) % 36000).cast("double") / 100 - 180).alias("longitude"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("date"),
        (customer % 40).cast("double").alias("t2m"),
        (customer % 40 + 5).cast("double").alias("t2m_max"),
        (customer % 40 - 5).cast("double").alias("t2m_min"),
        F.nullif(rain, F.lit(-999.0)).alias("prectotcorr"),
        (customer % 97).cast("double").alias("rh2m"),
        (key % 13).cast("double").alias("ws2m"),
        (key % 29).cast("double").alias("allsky_sfc_sw_dwn"),
        ((key % 7).cast("double") / 5).alias("gwetroot"),
    )


# Labels with a rule score from the length of the document, and its 0/1 prediction.
SCORED_SQL = """
scored AS (
  SELECT doc_id, quality, toxic, score, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS prediction
  FROM (SELECT l.doc_id, l.quality, l.toxic,
               CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS score
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id))
"""


def scored_labels(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "n_chars")
    score = (F.col("n_chars") % 1000).cast("double") / 1000
    joined = table(spark, folder, "labels").join(documents, "doc_id")
    return joined.select(
        "doc_id",
        "quality",
        "toxic",
        score.alias("score"),
        F.when(score > 0.5, 1).otherwise(0).alias("prediction"),
    )


LINEITEM_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
