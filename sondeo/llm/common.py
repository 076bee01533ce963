"""Helpers shared by the training-data operators: stored tables, text hashes, numbering without hot groups."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sondeo.workspace import shared_dir

WHITESPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/sondeo-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def forget(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lost executors cost no recomputation."""
    path = scratch(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_file_order(df: DataFrame, name: str) -> DataFrame:
    """Add the 0-based position of each row in the files that ``df`` reads as they are: files by path, then rows."""
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    upto, starts = 0, []
    for r in sorted(placed.groupBy("_file").count().collect()):  # one row per file
        starts.append((r["_file"], upto))
        upto += r["count"]
    starts = df.sparkSession.createDataFrame(starts, "_file string, _first long")
    return placed.join(F.broadcast(starts), "_file").select(
        *[quoted(c) for c in df.columns], (F.col("_first") + F.col("_row")).alias(name)
    )


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that a result is about to add; the result's columns win over input of that name."""
    taken = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in taken])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame, keys: Sequence[str], cell: str, order: Sequence[Column], name: str) -> DataFrame:
    """Add the 0-based position among the rows of equal ``keys``, ordered by ``cell`` and then by ``order``.

    ``cell`` must split every key's rows into pieces of bounded share: only a (key, cell) piece meets in one
    task, and a key's cells meet as one count each. ``keys`` and ``cell`` must not be null.
    """
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*keys, cell)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, cell, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    inside = F.row_number().over(Window.partitionBy(*keys, cell).orderBy(*order))
    return (
        df.withColumn("_inside", inside)
        .join(starts, [*keys, cell])
        .withColumn(name, (F.col("_start") + F.col("_inside") - 1).cast("long"))
        .drop("_start", "_inside")
    )
