"""Materialised tables: build-or-reuse and versioned datasets with lineage.

A versioned store is a folder: ``data/key=<key>/version=<n>`` holds each version as
Parquet, and ``catalog`` holds one row per stored version. One writer per key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeo.operators.ordering import running_number
from sondeo.workspace import delete_path, path_exists

CATALOG_SCHEMA = "key string, version bigint, source string, created_at timestamp"


def cached_table(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False
) -> DataFrame:
    """Read ``path`` if a complete table is there, else build and write it first."""
    if force or not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def catalog(spark: SparkSession, base: str) -> DataFrame:
    if not path_exists(spark, f"{base}/catalog"):
        return spark.createDataFrame([], CATALOG_SCHEMA)
    return spark.read.schema(CATALOG_SCHEMA).parquet(f"{base}/catalog")


def current_version(spark: SparkSession, base: str, key: str) -> int:
    """Number of the newest version, 0 for an unknown key."""
    newest = catalog(spark, base).where(F.col("key") == key).agg(F.max("version")).first()[0]
    return newest or 0


def has_key(spark: SparkSession, base: str, key: str) -> bool:
    return current_version(spark, base, key) > 0


def store_version(df: DataFrame, base: str, key: str, source: str = "") -> int:
    """Write the next version of ``key``; the catalog row makes it visible."""
    spark = df.sparkSession
    version = current_version(spark, base, key) + 1
    df.write.mode("overwrite").parquet(f"{base}/data/key={key}/version={version}")
    entry = spark.range(1).select(
        F.lit(key).alias("key"),
        F.lit(version).cast("bigint").alias("version"),
        F.lit(source or None).cast("string").alias("source"),
        F.current_timestamp().alias("created_at"),
    )
    entry.write.mode("append").parquet(f"{base}/catalog")
    return version


def read_version(
    spark: SparkSession,
    base: str,
    key: str,
    index: int | None = None,
    default: DataFrame | None = None,
) -> DataFrame | None:
    """The newest version, or the one at a zero-based index; unknown key -> default."""
    newest = current_version(spark, base, key)
    if newest == 0:
        return default
    if index is not None and not 0 <= index < newest:
        raise IndexError(f"version index {index} out of range for '{key}' (0..{newest - 1})")
    version = newest if index is None else index + 1
    return spark.read.parquet(f"{base}/data/key={key}/version={version}")


def keys(spark: SparkSession, base: str) -> DataFrame:
    """One row per key: newest version and when it was stored."""
    return newest_versions(catalog(spark, base), "key", "created_at")


def lineage(spark: SparkSession, base: str) -> DataFrame:
    """Stored versions that named their source."""
    return catalog(spark, base).where(F.col("source").isNotNull())


def clear(spark: SparkSession, base: str) -> None:
    delete_path(spark, f"{base}/catalog")
    delete_path(spark, f"{base}/data")


def numbered_versions(log: DataFrame, key: str, order: list[str], span: Column | None = None) -> DataFrame:
    """Version numbers 1..n per key for a log of writes that carries none yet.

    ``span`` (such as the day of the write) splits the log of a busy key.
    """
    return running_number(log, [key], order, "version", span)


def newest_versions(log: DataFrame, key: str, stamp: str) -> DataFrame:
    return log.groupBy(key).agg(F.max("version").alias("version"), F.max(stamp).alias("updated_at"))
