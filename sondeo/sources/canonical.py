"""Mapping of source columns onto the canonical schema of the training table."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NameRule:
    """``target`` takes a header that equals or contains one of the given words."""

    target: str
    contains: tuple[str, ...] = ()
    equals: tuple[str, ...] = ()
    starts_word: tuple[str, ...] = ()
    also: tuple[str, ...] = ()
    never: tuple[str, ...] = field(default=())

    def accepts(self, header: str) -> bool:
        name = header.lower().strip()
        if any(word in name for word in self.never):
            return False
        if self.also and not any(word in name for word in self.also):
            return False
        return (
            name in self.equals
            or any(word in name for word in self.contains)
            or any(re.search(rf"(^|[^a-z]){word}", name) for word in self.starts_word)
        )


# Header rules per source, tried in this order. "lat" and "lon" must start a
# word, so that a header such as "Population" stays unmapped.
FLOOD_RULES = [
    NameRule("precipitation", contains=("rain", "precip")),
    NameRule("temperature", contains=("temp",)),
    NameRule("humidity", contains=("humid",)),
    NameRule("flood_probability", contains=("flood",), also=("prob", "risk", "pred")),
    NameRule("river_discharge", contains=("river", "discharge")),
]
DROUGHT_RULES = [
    NameRule("precipitation", equals=("prectot", "prectotcorr")),
    NameRule("temperature", equals=("t2m",)),
    NameRule("temperature_max", equals=("t2m_max", "t2mmax")),
    NameRule("temperature_min", equals=("t2m_min", "t2mmin")),
    NameRule("specific_humidity", equals=("qv2m",)),
    NameRule("wind_speed", equals=("ws10m", "ws2m")),
    NameRule("drought_score", equals=("score",)),
]
WILDFIRE_RULES = [
    NameRule("latitude", starts_word=("lat",)),
    NameRule("longitude", starts_word=("lon",)),
    NameRule("temperature", contains=("temp",), never=("max", "min")),
    NameRule("wind_speed", contains=("wind",)),
    NameRule("humidity", contains=("humid",)),
    NameRule("precipitation", contains=("precip", "rain")),
    NameRule("fire_risk_level", contains=("risk",)),
    NameRule("fire_risk_level", contains=("fire",), also=("level",)),
    NameRule("region", contains=("region",)),
]


def canonical_names(headers: list[str], rules: list[NameRule]) -> dict[str, str]:
    """Header -> canonical name for every header some rule accepts; first rule wins."""
    return {h: r.target for h in headers for r in reversed(rules) if r.accepts(h)}


def canonicalise(df: DataFrame, rules: list[NameRule]) -> DataFrame:
    """Rename by rule. Headers that share a target are coalesced in column order."""
    names = canonical_names(df.columns, rules)
    sources: dict[str, list[str]] = {}
    for header in df.columns:
        sources.setdefault(names.get(header, header), []).append(header)
    return df.select(
        *[F.coalesce(*[df[f"`{h}`"] for h in headers]).alias(t) for t, headers in sources.items()]
    )


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Constant or computed columns, added only where the name is absent."""
    missing = {
        name: value if isinstance(value, Column) else F.lit(value)
        for name, value in defaults.items()
        if name not in df.columns
    }
    return df.withColumns(missing) if missing else df


def with_copies(df: DataFrame, copies: dict[str, str]) -> DataFrame:
    """Copy ``source`` to ``target`` if the source exists and the target does not."""
    return with_defaults(df, {t: F.col(s) for s, t in copies.items() if s in df.columns})


def keep_existing(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns that exist, in the order named."""
    return df.select(*[n for n in names if n in df.columns])


def union_all(*frames: DataFrame) -> DataFrame:
    """Union by name; a column absent from a frame is NULL there."""
    out, *rest = frames
    for frame in rest:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
