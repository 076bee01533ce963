"""Shared storage, lineage cuts and size checks used by several operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side of a join is broadcast only after it was measured to stay below both.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024
MEASURES_PER_SCAN = 30


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="sondeo-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str, *parts: str) -> str:
    """A folder for this application's own intermediate tables, below the shared folder."""
    suffix = f"-{zlib.crc32('/'.join(parts).encode()):08x}" if parts else ""
    return f"{shared_dir(spark)}/sondeo/{spark.sparkContext.applicationId}/{name}{suffix}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again; the files go when the application ends.

    Later passes read only the columns and row groups they need, and lost executors cost no recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_path(spark, 'cut')}-{uuid.uuid4().hex}"
    untyped = [f.name for f in df.schema if isinstance(f.dataType, T.NullType)]  # Parquet has no type for these
    df = df.withColumns({c: F.lit(None).cast("string") for c in untyped}) if untyped else df
    df.write.parquet(path)
    folder, files = _path(spark, path)
    files.deleteOnExit(folder)
    read = spark.read.schema(df.schema).parquet(path)
    return read.withColumns({c: F.lit(None) for c in untyped}) if untyped else read


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the keys come once, from the left."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = reduce(and_, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def within_broadcast_bound(df: DataFrame) -> bool:
    """Measure ``df`` (at most one row past the limit is read) against the bounds."""
    row = (
        df.limit(BROADCAST_ROWS + 1)
        .agg(
            F.count("*").alias("n"),
            F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("b"),
        )
        .first()
    )
    return row["n"] <= BROADCAST_ROWS and row["b"] <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast when the measured size allows it, else leave the join to AQE.

    The side is written first, so measuring it does not run its plan a second time.
    """
    df = cut_lineage(df)
    return F.broadcast(df) if within_broadcast_bound(df) else df


def aggregate_wide(df: DataFrame, measures: dict[str, Column]) -> dict[str, object]:
    """Ungrouped aggregates by name, in scans of bounded width.

    Wider aggregates outgrow the JIT compiler and run many times slower. Each scan reads
    only the columns of its own measures.
    """
    names, found = list(measures), {}
    for start in range(0, len(names), MEASURES_PER_SCAN):
        chunk = names[start : start + MEASURES_PER_SCAN]
        row = df.agg(*[measures[n].alias(f"m{i}") for i, n in enumerate(chunk)]).first()
        found.update(zip(chunk, row))
    return found


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _path(spark, path)
    return fs.exists(hadoop)


def is_directory(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _path(spark, path)
    return fs.exists(hadoop) and fs.getFileStatus(hadoop).isDirectory()


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop, fs = _path(spark, path)
    fs.delete(hadoop, True)
