"""Column lists by type, and the missing-value convention."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns in schema order; booleans are not numeric."""
    skip = set(exclude)
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.StringType) and f.name not in skip
    ]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL everywhere downstream, so floats lose their NaN at ingest."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return df
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floats})


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")


def type_names(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema}


def unpivot(df: DataFrame, columns: list[str], as_type: str = "double") -> DataFrame:
    """Rows of (column, value), one per cell of ``columns``."""
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(c).cast(as_type).alias("value"))
                for c in columns
            ]
        )
    )
    return df.select(cells.alias("cell")).select("cell.column", "cell.value")
