"""Telemetry feeds as they land on storage: detections, events and daily weather."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeo.functions.schema import nan_to_null

# Weather parameters of the daily feed.
WEATHER_PARAMETERS = [
    "T2M", "T2M_MAX", "T2M_MIN", "PRECTOTCORR", "RH2M", "WS2M", "ALLSKY_SFC_SW_DWN", "GWETROOT",
]
# Fixed value: marks a missing reading in the daily feed.
MISSING_READING = -999.0

DETECTION_SCHEMA = """
    latitude double, longitude double, brightness double, scan double, track double,
    acq_date string, acq_time int, satellite string, confidence string, version string,
    bright_t31 double, frp double, daynight string
"""

# Coordinates are read as text: a polygon nests arrays where a point has numbers.
EVENTS_SCHEMA = """
    events array<struct<
        id: string, title: string, closed: string,
        categories: array<struct<title: string>>,
        geometry: array<struct<
            date: string, coordinates: array<string>,
            magnitudeValue: double, magnitudeUnit: string>>>>
"""

WEATHER_SCHEMA = """
    geometry struct<coordinates: array<double>>,
    properties struct<parameter: map<string, map<string, double>>>
"""


def read_detections(spark: SparkSession, path: str, region_names: DataFrame | None = None) -> DataFrame:
    """Detection CSV files with a fixed schema.

    A folder laid out as ``region_key=<key>/`` adds ``region_key``; given the region
    table, its display name becomes ``region`` (twenty rows, joined by key).
    """
    schema = DETECTION_SCHEMA
    df = nan_to_null(spark.read.csv(path, schema=schema, header=True))
    if region_names is None or "region_key" not in df.columns:
        return df
    names = region_names.select("region_key", F.col("name").alias("region"))
    return df.join(names, "region_key", "left")


def read_event_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per tracked event, still nested."""
    documents = spark.read.json(path, schema=EVENTS_SCHEMA, multiLine=True)
    return documents.select(F.explode("events").alias("event")).select("event.*")


def select_events(
    events: DataFrame,
    asof: Column | None = None,
    days: int | None = None,
    status: str = "open",
    limit: int | None = None,
) -> DataFrame:
    """The feed's request options as filters: recency, open or closed, newest ``limit``."""
    newest = F.array_max(F.transform("geometry", lambda g: F.try_to_timestamp(g["date"])))
    out = events.withColumn("newest", newest)
    if status == "open":
        out = out.where(F.col("closed").isNull())
    elif status == "closed":
        out = out.where(F.col("closed").isNotNull())
    if days is not None:
        start = (F.current_timestamp() if asof is None else asof) - F.expr(f"INTERVAL {int(days)} DAYS")
        out = out.where(F.col("newest") >= start)
    if limit is not None:
        out = out.orderBy(F.desc("newest"), "id").limit(limit)
    return out.drop("newest")


def last_k(array: str | Column, k: int) -> Column:
    """The last ``k`` elements, or all of a shorter array."""
    array = F.col(array) if isinstance(array, str) else array
    return F.slice(array, F.greatest(F.size(array) - (k - 1), F.lit(1)), k)


def flatten_events(events: DataFrame, observations: int = 3) -> DataFrame:
    """Nested events to one row per recent point observation."""
    rows = events.select(
        F.coalesce("id", F.lit("")).alias("eonet_id"),
        F.coalesce("title", F.lit("")).alias("eonet_title"),
        F.when(F.size("categories") > 0, F.coalesce(F.get("categories", F.lit(0))["title"], F.lit("")))
        .otherwise("Unknown")
        .alias("eonet_category"),
        F.explode(last_k("geometry", observations)).alias("g"),
    )
    return rows.where(F.size("g.coordinates") >= 2).select(
        "eonet_id",
        "eonet_title",
        "eonet_category",
        F.coalesce("g.date", F.lit("")).alias("eonet_date"),
        F.get("g.coordinates", F.lit(1)).try_cast("double").alias("eonet_latitude"),
        F.get("g.coordinates", F.lit(0)).try_cast("double").alias("eonet_longitude"),
        F.col("g.magnitudeValue").alias("eonet_magnitude_value"),
        F.coalesce("g.magnitudeUnit", F.lit("")).alias("eonet_magnitude_unit"),
        F.lit("nasa_eonet").alias("data_source"),
    )


def read_weather_documents(spark: SparkSession, path: str) -> DataFrame:
    """(latitude, longitude, parameters) per landed weather document."""
    documents = spark.read.json(path, schema=WEATHER_SCHEMA, multiLine=True)
    return documents.select(
        F.get("geometry.coordinates", F.lit(1)).alias("latitude"),
        F.get("geometry.coordinates", F.lit(0)).alias("longitude"),
        F.col("properties.parameter").alias("parameters"),
    )


def pivot_parameters(
    df: DataFrame, keys: list[str], parameters: str, names: list[str], missing: float = MISSING_READING
) -> DataFrame:
    """Map of parameter -> {date -> value} to one row per key and date.

    The known names are read straight from the map, so the pivot is a grouped
    conditional maximum with one column each and no second pass to discover names.
    """
    wanted = F.array(*[F.lit(n) for n in names])
    series = df.select(*keys, F.explode(F.map_filter(parameters, lambda k, _: F.array_contains(wanted, k))))
    readings = series.select(
        *keys, F.lower("key").alias("parameter"), F.explode("value").alias("date", "reading")
    ).withColumn("reading", F.nullif("reading", F.lit(missing)))
    return readings.groupBy("date", *keys).agg(
        *[
            F.max(F.when(F.col("parameter") == n.lower(), F.col("reading"))).alias(n.lower())
            for n in names
        ]
    )


def flatten_weather(documents: DataFrame) -> DataFrame:
    """Weather documents to one row per place and day."""
    wide = pivot_parameters(documents, ["latitude", "longitude"], "parameters", WEATHER_PARAMETERS)
    return wide.withColumn("data_source", F.lit("nasa_power"))


def recent_days(df: DataFrame, asof: Column | None = None, days: int = 7) -> DataFrame:
    """Rows of the last ``days`` days; ``date`` is ``yyyyMMdd`` text."""
    end = F.current_date() if asof is None else asof
    first = F.date_format(F.date_sub(end, days), "yyyyMMdd")
    return df.where(F.col("date").between(first, F.date_format(end, "yyyyMMdd")))
