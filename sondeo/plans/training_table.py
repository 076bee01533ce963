"""Building the disaster training table and aligning it to detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondeo.functions import domain
from sondeo.functions.schema import numeric_columns, string_columns
from sondeo.operators.clean import fill_numbers, fill_strings, fit_medians
from sondeo.sources import canonical, tables
from sondeo.sources.files import load_directory
from sondeo.workspace import path_exists

# Columns of the training table, in order.
TRAINING_COLUMNS = [
    "event_type", "latitude", "longitude", "region", "year", "month", "temperature",
    "precipitation", "humidity", "wind_speed", "soil_moisture", "severity", "crop_type",
    "crop_impact", "crop_yield_loss_pct", "data_source",
]
# Event type -> (rules, name of the source).
RAW_SOURCES = {
    "flood": (canonical.FLOOD_RULES, "kaggle_flood"),
    "drought": (canonical.DROUGHT_RULES, "kaggle_drought"),
    "wildfire": (canonical.WILDFIRE_RULES, "kaggle_wildfire"),
}


def _number(df: DataFrame, *names: str) -> Column:
    """The first named column that exists, if it is a number; text counts as absent."""
    for name in names:
        if name in df.columns:
            numeric = isinstance(df.schema[name].dataType, T.NumericType)
            return F.col(name).cast("double") if numeric else F.lit(None).cast("double")
    return F.lit(None).cast("double")


def add_crop_impact(df: DataFrame, noise_keys: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Adds crop_type, crop_impact and crop_yield_loss_pct by event type.

    Noise is drawn from ``noise_keys``; without them each draw is its mean.
    """

    def noise(sd: float, offset: int) -> Column | float:
        return domain.key_normal(noise_keys, seed + offset, sd) if noise_keys else 0.0

    event = F.col("event_type")
    loss = domain.yield_loss(
        event,
        _number(df, "flood_probability", "precipitation"),
        _number(df, "drought_score"),
        noise(15.0, 0),
        noise(10.0, 2),
        noise(20.0, 4),
        domain.key_uniform(noise_keys, seed + 6) if noise_keys else 0.5,
    )
    # Without a key, rows are told apart by their own content.
    keys = noise_keys or df.columns
    return (
        df.withColumn("_loss", loss)
        .withColumns(
            {
                "crop_type": domain.crop_of(keys, seed + 8),
                "crop_impact": domain.loss_band(event, F.col("_loss")),
                "crop_yield_loss_pct": F.round("_loss", 1),
            }
        )
        .drop("_loss")
    )


def canonical_source(df: DataFrame, event_type: str) -> DataFrame:
    """A raw source under canonical names, tagged with its event type and origin."""
    rules, origin = RAW_SOURCES[event_type]
    named = canonical.canonicalise(df, rules)
    return named.withColumns({"event_type": F.lit(event_type), "data_source": F.lit(origin)})


def combine_sources(frames: list[DataFrame]) -> DataFrame:
    """Union by name, keep the training columns, fill gaps (median, ``unknown``)."""
    combined = canonical.keep_existing(canonical.union_all(*frames), TRAINING_COLUMNS)
    filled = fill_numbers(combined, fit_medians(combined, numeric_columns(combined)))
    return fill_strings(filled, {c: "unknown" for c in string_columns(combined)})


def build_training_table(
    spark: SparkSession,
    folder: str,
    output: str | None = None,
    force: bool = False,
    supplements: list[DataFrame] | None = None,
) -> DataFrame:
    """Read the raw folders that exist, combine them, and keep the result for reuse."""

    def build() -> DataFrame:
        frames = [
            add_crop_impact(canonical_source(load_directory(spark, f"{folder}/{event}"), event))
            for event in RAW_SOURCES
            if path_exists(spark, f"{folder}/{event}")
        ]
        frames += supplements or []
        if not frames:
            raise ValueError(f"no training source below {folder}")
        return combine_sources(frames)

    return tables.cached_table(spark, output or f"{folder}/combined_disaster_training", build, force)


def align_to_detections(training: DataFrame, noise_keys: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Training rows with the detection columns they lack, ready for a union."""

    def noise(sd: float, offset: int) -> Column | float:
        return domain.key_normal(noise_keys, seed + offset, sd) if noise_keys else 0.0

    df = canonical.with_copies(
        training, {"temperature": "temperature_2m", "humidity": "relative_humidity", "severity": "frp"}
    )
    power = F.col("frp") if "frp" in df.columns else F.lit(10.0)
    if {"year", "month"} <= set(df.columns):
        date = domain.mid_month_date(F.col("year"), F.col("month"))
    else:
        date = F.lit("2025-01-15")
    return canonical.with_defaults(
        df,
        {
            "brightness": domain.brightness_from_power(power, noise(8.0, 0)),
            "confidence": domain.confidence_band(power, noise(5.0, 2)),
            "satellite": "N",
            "daynight": "D",
            "acq_date": date,
            "data_source": "kaggle_training",
        },
    )
