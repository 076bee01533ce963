"""Named table operators and ad-hoc SQL transforms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from sondeo.operators import clean, explore, features, profile


@dataclass(frozen=True)
class Operator:
    name: str
    function: Callable[..., DataFrame]
    category: str = "general"
    description: str = ""


_OPERATORS: dict[str, Operator] = {}


def register(name: str, function: Callable[..., DataFrame], category: str = "general") -> Operator:
    doc = (function.__doc__ or "").strip().splitlines()
    _OPERATORS[name] = Operator(name, function, category, doc[0] if doc else "")
    return _OPERATORS[name]


def get(name: str) -> Operator:
    if name not in _OPERATORS:
        raise KeyError(f"operator '{name}' is not registered; known: {sorted(_OPERATORS)}")
    return _OPERATORS[name]


def list_operators(category: str = "") -> list[Operator]:
    return [o for o in _OPERATORS.values() if not category or o.category == category]


def apply(df: DataFrame, name: str, *args, **options) -> DataFrame:
    return df.transform(get(name).function, *args, **options)


def sql_transform(df: DataFrame, query: str, **parameters) -> DataFrame:
    """Run a query that names the table ``{df}`` and its parameters ``:name``."""
    return df.sparkSession.sql(query, args=parameters or None, df=df)


for _function, _category in [
    (profile.numeric_profile, "data"),
    (profile.missing_rates, "data"),
    (profile.schema_summary, "data"),
    (profile.data_profile, "data"),
    (profile.outlier_counts, "data"),
    (profile.top_values, "data"),
    (clean.drop_duplicates, "cleaning"),
    (clean.impute_median, "cleaning"),
    (clean.impute_mode, "cleaning"),
    (clean.cap_outliers, "cleaning"),
    (explore.correlation_matrix, "explore"),
    (explore.high_correlations, "explore"),
    (explore.histogram, "explore"),
    (explore.box_summary, "explore"),
    (features.encode, "features"),
    (features.transform, "features"),
    (features.standard_scale, "features"),
    (sql_transform, "data"),
]:
    register(_function.__name__, _function, _category)
