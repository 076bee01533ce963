"""Rule columns of the disaster domain: indices, bands, severities and impacts.

Random noise is off by default. When asked for, it is a function of a row key and
a seed, so it does not depend on partitioning or on retries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sondeo.functions.moments import clip

# Crop names a damaged area may grow.
CROPS = ["rice", "wheat", "maize", "soybean", "cotton", "sugarcane", "vegetables"]


def key_uniform(keys: Sequence[str | Column], seed: int) -> Column:
    """A number in [0, 1) that depends only on the key columns and the seed."""
    h = F.xxhash64(*keys, F.lit(seed))
    return F.pmod(h, F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def key_normal(keys: Sequence[str | Column], seed: int, sd: float) -> Column:
    """Normal noise (mean 0) derived from two uniform draws of the key."""
    u = F.lit(1.0) - key_uniform(keys, seed)
    v = key_uniform(keys, seed + 1)
    return F.lit(sd) * F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0) * F.pi() * v)


def drought_index(frp: Column, precipitation: Column, noise: Column | float = 0.0) -> Column:
    raw = F.lit(-1.5) - frp * 0.02 + precipitation * 0.5 + noise
    return F.round(clip(raw, -6.0, 6.0), 2)


def flood_score(precipitation: Column, humidity: Column, noise: Column | float = 0.0) -> Column:
    return F.round(clip(precipitation * 0.8 + humidity * 0.03 + noise, 0.0, 10.0), 2)


def days_since_rain(precipitation: Column, extra: Column | float = 0.0) -> Column:
    days = (F.lit(7.0) - precipitation * 2 + extra).cast("int")
    return F.when(days.isNotNull(), F.greatest(days, F.lit(0)))


def elevation_proxy(latitude: Column, noise: Column | float = 0.0) -> Column:
    return F.round(F.abs(latitude) * 8 + 200 + noise, 0)


def brightness_from_power(frp: Column, noise: Column | float = 0.0) -> Column:
    return F.coalesce(frp, F.lit(10.0)) * 1.2 + 300 + noise


def confidence_band(intensity: Column, noise: Column | float = 0.0) -> Column:
    level = F.coalesce(intensity, F.lit(10.0)) + noise
    return F.when(level > 30, "h").when(level > 10, "n").otherwise("l")


def mid_month_date(year: Column, month: Column) -> Column:
    """``YYYY-MM-15``; NULL parts fall back to January 2025."""
    return F.format_string(
        "%d-%02d-15",
        F.coalesce(year.cast("int"), F.lit(2025)),
        F.coalesce(month.cast("int"), F.lit(1)),
    )


def yield_loss(
    event_type: Column,
    flood_severity: Column,
    drought_score: Column,
    flood_noise: Column | float = 0.0,
    drought_noise: Column | float = 0.0,
    fire_noise: Column | float = 0.0,
    other_draw: Column | float = 0.5,
) -> Column:
    """Expected crop loss in percent by event type, one decimal after banding."""
    flood = F.coalesce(flood_severity, F.lit(50.0)) * 0.6
    drought = F.coalesce(drought_score, F.lit(2.0)) * 15
    draw = F.lit(other_draw) if not isinstance(other_draw, Column) else other_draw
    return (
        F.when(event_type == "flood", clip(flood + 10 + flood_noise, 5.0, 95.0))
        .when(event_type == "drought", clip(drought + 5 + drought_noise, 5.0, 85.0))
        .when(event_type == "wildfire", clip(F.lit(65.0) + fire_noise, 20.0, 100.0))
        .otherwise(F.lit(5.0) + draw * 25.0)
    )


def loss_band(event_type: Column, loss: Column) -> Column:
    """low / medium / high with thresholds that depend on the event type."""

    def band(high: float, medium: float) -> Column:
        return F.when(loss > high, "high").when(loss > medium, "medium").otherwise("low")

    return (
        F.when(event_type == "flood", band(60, 30))
        .when(event_type == "drought", band(50, 25))
        .when(event_type == "wildfire", band(70, 40))
        .otherwise("low")
    )


def crop_of(keys: Sequence[str | Column], seed: int) -> Column:
    names = F.array(*[F.lit(c) for c in CROPS])
    index = F.floor(key_uniform(keys, seed) * len(CROPS)).cast("int") + 1
    return F.element_at(names, index)


def severity_value(disaster: Column, frp: Column, step: Column) -> Column:
    return F.round(
        F.when(disaster == "Flood", frp * 0.1 + step * 0.15)
        .when(disaster == "Drought", frp * -0.2 - step * 0.1)
        .otherwise(frp + step * 0.9),
        2,
    )


def severity_unit(disaster: Column) -> Column:
    return (
        F.when(disaster == "Flood", "Water Level (m)")
        .when(disaster == "Drought", "PDSI Index")
        .otherwise("MW (Radiative Power)")
    )


def damage_text(confidence: Column, frp: Column) -> Column:
    return (
        F.when((confidence == "high") | (frp > 25), "Total Destruction Expected")
        .when(confidence == "nominal", "Moderate Damage Expected")
        .otherwise("Minimal To No Harm Expected")
    )
