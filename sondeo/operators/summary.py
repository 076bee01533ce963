"""Grouped summaries of detections and snapshots against fixed lists of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Disaster types and snapshot sources that are always listed.
DISASTER_TYPES = ["fire", "flood", "drought"]
SOURCES = ["firms", "eonet", "power"]
TOTAL = "total"


def disaster_summary(df: DataFrame, disaster: str = "disaster_type") -> DataFrame:
    """One row per disaster type and a total; an empty type shows zeros.

    Severity is taken without sign except for the drought index. Metrics of another
    type are NULL.
    """
    kind = F.lower(F.coalesce(F.col(disaster), F.lit("fire")))
    severity = F.abs("severity_value")

    def mean(value: str | Column, digits: int) -> Column:
        return F.round(F.avg(value), digits)

    measured = (
        df.withColumn("_kind", kind)
        .rollup("_kind")
        .agg(
            F.grouping("_kind").alias("_all"),
            F.count("*").alias("count"),
            F.count_if(F.col("confidence") == "high").alias("high_count"),
            mean(severity, 2).alias("avg_severity"),
            F.round(F.max(severity), 2).alias("max_severity"),
            mean("brightness", 1).alias("avg_brightness"),
            mean("frp", 1).alias("avg_frp"),
            mean(severity, 2).alias("avg_water_level"),
            mean("precipitation", 2).alias("avg_precipitation"),
            mean("severity_value", 2).alias("avg_pdsi"),
            mean("soil_moisture", 3).alias("avg_soil_moisture"),
        )
        .withColumn("kind", F.when(F.col("_all") == 1, TOTAL).otherwise(F.col("_kind")))
        .where(F.col("kind").isin([*DISASTER_TYPES, TOTAL]))
    )
    listed = df.sparkSession.createDataFrame([(k,) for k in [*DISASTER_TYPES, TOTAL]], "kind string")
    rows = listed.join(F.broadcast(measured), "kind", "left")

    def only(name: str, *kinds: str) -> Column:
        return F.when(F.col("kind").isin(*kinds), F.coalesce(name, F.lit(0.0))).alias(name)

    return rows.select(
        "kind",
        F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("high_count", F.lit(0)).alias("high_count"),
        only("avg_severity", *DISASTER_TYPES),
        only("max_severity", *DISASTER_TYPES),
        only("avg_brightness", "fire"),
        only("avg_frp", "fire"),
        only("avg_water_level", "flood"),
        only("avg_precipitation", "flood"),
        only("avg_pdsi", "drought"),
        only("avg_soil_moisture", "drought"),
    )


def type_summary(df: DataFrame, kind: str, value: str) -> DataFrame:
    """Counts and absolute-value statistics per type with a grand total."""
    size = F.abs(F.col(value))
    return (
        df.rollup(kind)
        .agg(
            F.grouping(kind).alias("_all"),
            F.count("*").alias("count"),
            F.round(F.avg(size), 2).alias("avg_severity"),
            F.round(F.max(size), 2).alias("max_severity"),
        )
        .withColumn(kind, F.when(F.col("_all") == 1, TOTAL).otherwise(F.col(kind)))
        .drop("_all")
    )


def freshness(
    df: DataFrame, source: str = "source", stamp: str = "snapshot_ts", sources: list[str] | None = None
) -> DataFrame:
    """Rows and newest timestamp for each listed source, absent ones included."""
    sources = sources or SOURCES
    seen = (
        df.where(F.col(source).isin(sources))
        .groupBy(source)
        .agg(F.count("*").alias("n_rows"), F.max(stamp).alias("last_updated"))
    )
    listed = df.sparkSession.createDataFrame([(s,) for s in sources], f"{source} string")
    return listed.join(F.broadcast(seen), source, "left").select(
        source,
        F.col("n_rows").isNotNull().cast("int").alias("available"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        "last_updated",
    )
