"""Weather enrichment of geo-located rows through a rounded-coordinate key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondeo.functions import domain
from sondeo.functions.moments import clip
from sondeo.operators.ordering import latest_per_key
from sondeo.workspace import broadcast_if_small

# Reading -> enriched column.
WEATHER_COLUMNS = {
    "t2m": "temperature_2m",
    "t2m_max": "temperature_max",
    "t2m_min": "temperature_min",
    "prectotcorr": "precipitation",
    "rh2m": "relative_humidity",
    "ws2m": "wind_speed",
    "allsky_sfc_sw_dwn": "solar_radiation",
    "gwetroot": "soil_moisture",
}
# Means of what a place without weather gets. Wind is the mean of exp(N(1, 0.5)).
WEATHER_DEFAULTS = {
    "temperature_2m": 28.0,
    "precipitation": 2.0,
    "relative_humidity": 50.0,
    "wind_speed": math.exp(1.125),
    "solar_radiation": 15.0,
    "soil_moisture": 0.4,
}
VEGETATION_MEAN = 0.5


def whole_degree(coordinate: str | Column) -> Column:
    """Nearest whole degree, halves to even."""
    value = F.col(coordinate) if isinstance(coordinate, str) else coordinate
    return F.bround(value, 0)


def cluster_sizes(df: DataFrame, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    keys = [whole_degree(latitude).alias("lat_key"), whole_degree(longitude).alias("lon_key")]
    return df.groupBy(*keys).agg(F.count("*").alias("count")).orderBy("lat_key", "lon_key")


def lookup_with_defaults(
    df: DataFrame, lookup: DataFrame, on: list[str], defaults: dict[str, Column]
) -> DataFrame:
    """Left look-up: a miss takes the default, a hit keeps its value even when NULL."""
    flagged = lookup.withColumn("_hit", F.lit(True))
    joined = df.join(broadcast_if_small(flagged), on, "left")
    values = {
        name: F.when(F.col("_hit").isNull(), default).otherwise(F.col(name))
        for name, default in defaults.items()
    }
    return joined.withColumns(values).drop("_hit")


def latest_weather(weather: DataFrame, skip_null: bool = False) -> DataFrame:
    """Newest readings per whole-degree place, under their enriched names."""
    keyed = weather.select(
        whole_degree("latitude").alias("lat_key"),
        whole_degree("longitude").alias("lon_key"),
        "date",
        *[F.col(source).alias(name) for source, name in WEATHER_COLUMNS.items()],
    )
    # Two places may share a key; equal dates are settled by the readings themselves.
    names = list(WEATHER_COLUMNS.values())
    return latest_per_key(keyed, ["lat_key", "lon_key"], "date", names, skip_null).drop("date")


def enrich_with_weather(
    detections: DataFrame,
    weather: DataFrame,
    noise_keys: list[str] | None = None,
    noise_scale: float = 0.0,
    skip_null: bool = True,
    seed: int = 42,
) -> DataFrame:
    """Detections with weather columns and the indices derived from them.

    Rows are never dropped or capped: every place with weather is looked up. Noise is
    drawn from ``noise_keys`` when ``noise_scale`` is above zero.
    """

    def noise(sd: float, offset: int) -> Column | float:
        if not noise_scale or not noise_keys:
            return 0.0
        return domain.key_normal(noise_keys, seed + offset, sd * noise_scale)

    keyed = detections.withColumns(
        {"lat_key": whole_degree("latitude"), "lon_key": whole_degree("longitude")}
    )
    defaults: dict[str, Column] = {n: F.lit(v) for n, v in WEATHER_DEFAULTS.items()}
    defaults["temperature_max"] = F.lit(WEATHER_DEFAULTS["temperature_2m"] + 5)
    defaults["temperature_min"] = F.lit(WEATHER_DEFAULTS["temperature_2m"] - 5)
    joined = lookup_with_defaults(keyed, latest_weather(weather, skip_null), ["lat_key", "lon_key"], defaults)

    frp = F.col("frp") if "frp" in detections.columns else F.lit(10.0)
    rain, humidity = F.col("precipitation"), F.col("relative_humidity")
    indices = {
        "vegetation_index": F.round(clip(F.lit(VEGETATION_MEAN) + noise(0.12, 0), 0.05, 0.9), 4),
        "drought_severity_index": domain.drought_index(frp, rain, noise(0.8, 2)),
        "flood_risk_score": domain.flood_score(rain, humidity, noise(0.3, 4)),
        "days_since_rain": domain.days_since_rain(rain),
        "elevation_proxy": domain.elevation_proxy(F.col("latitude"), noise(50.0, 6)),
    }
    rounded = {
        name: F.round(F.col(name), 2)
        for name in ("temperature_2m", "temperature_max", "temperature_min", "precipitation", "wind_speed", "solar_radiation")
    }
    rounded["relative_humidity"] = F.round(clip(humidity, 5.0, 100.0), 2)
    rounded["soil_moisture"] = F.round(clip("soil_moisture", 0.0, 1.0), 4)
    added = [*WEATHER_COLUMNS.values(), *indices]
    kept = [c for c in detections.columns if c not in added]
    return joined.withColumns(indices).withColumns(rounded).select(*kept, *added)
