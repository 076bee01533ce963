"""Readers chosen by file extension, directory scans and plain file sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondeo.functions.schema import nan_to_null

# Extension -> (format, fixed options).
FORMATS = {
    ".csv": ("csv", {"header": True, "nullValue": ""}),
    ".tsv": ("csv", {"header": True, "nullValue": "", "sep": "\t"}),
    ".parquet": ("parquet", {}),
    ".json": ("json", {}),
    ".jsonl": ("json", {}),
}


def _documents(first: str | None, has_records: bool) -> bool:
    """True if a JSON file is one document, not a record a line.

    An array and a lone brace begin a document. Anything else does so only if no line of the file is a record: a
    broken first line among records is a broken record.
    """
    start = (first or "").strip()
    return bool(start) and (start[0] == "[" or start == "{" or not has_records)


def _json_layouts(spark: SparkSession, path: str, listing: dict) -> dict[bool, list[str]]:
    """Files below ``path`` by layout: whole documents (True) or records by line (False).

    Every file is judged by its own lines. One row per file comes to the driver.
    """
    lines = spark.read.options(**listing).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("id")).alias("place"),
        F.trim("value", F.lit(" \t\r")).alias("value"),
    )
    record = F.col("value").startswith("{") & F.col("value").endswith("}") & F.get_json_object("value", "$").isNotNull()
    judged = lines.where(F.length("value") > 0).groupBy("file").agg(
        F.min_by("value", "place").alias("first"), F.max(F.coalesce(record, F.lit(False))).alias("records")
    )
    layouts: dict[bool, list[str]] = {}
    for row in judged.orderBy("file").collect():
        layouts.setdefault(_documents(row["first"], row["records"]), []).append(row["file"])
    return layouts


def _reader(spark: SparkSession, extension: str, schema: T.StructType | str | None, options: dict):
    if extension not in FORMATS:
        raise ValueError(f"no reader is known for files that end in {extension!r}")
    fmt, fixed = FORMATS[extension]
    reader = spark.read.format(fmt).options(**{**fixed, **options})
    if schema is not None:
        return reader.schema(schema)
    return reader.option("inferSchema", True) if fmt == "csv" else reader


def _load(
    spark: SparkSession, path: str, extension: str, schema: T.StructType | str | None, options: dict
) -> DataFrame:
    if extension in FORMATS and FORMATS[extension][0] == "json" and "multiLine" not in options:
        listing = {k: v for k, v in options.items() if k in ("recursiveFileLookup", "pathGlobFilter")}
        layouts = _json_layouts(spark, path, listing)
        if len(layouts) > 1:
            parts = [
                _reader(spark, extension, schema, {**options, "multiLine": whole}).load(files)
                for whole, files in sorted(layouts.items())
            ]
            return nan_to_null(parts[0].unionByName(parts[1], allowMissingColumns=True))
        options = {**options, "multiLine": next(iter(layouts), False)}
    return nan_to_null(_reader(spark, extension, schema, options).load(path))


def load(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    **options,
) -> DataFrame:
    """Read one dataset by its lower-cased extension.

    Pass ``schema`` for large text files: inference reads them one extra time. JSON files
    of either layout may lie in one folder; pass ``multiLine`` if all are of one layout,
    which saves the pass that looks.
    """
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    return _load(spark, path, extension, schema, options)


def load_directory(
    spark: SparkSession,
    path: str,
    extension: str = ".csv",
    schema: T.StructType | str | None = None,
    limit: int | None = None,
    **options,
) -> DataFrame:
    """Read every file below ``path``; ``limit`` keeps a first-n sample when asked for."""
    options = {"recursiveFileLookup": True, "pathGlobFilter": f"*{extension}", **options}
    df = _load(spark, path, extension, schema, options)
    return df if limit is None else df.limit(limit)


def file_inventory(spark: SparkSession, path: str, extension: str = ".csv") -> DataFrame:
    """Files below ``path``, smallest first. File contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{extension}")
        .load(path)
        .select("path", "length", "modificationTime")
        .orderBy("length", "path")
    )


def load_smallest_file(
    spark: SparkSession, path: str, extension: str = ".csv", limit: int | None = None, **options
) -> DataFrame:
    """The sample the directory's smallest file gives (a quick look at a large source)."""
    first = file_inventory(spark, path, extension).select("path").first()
    if first is None:
        raise ValueError(f"no {extension} file below {path}")
    df = _load(spark, first["path"], extension, None, options)
    return df if limit is None else df.limit(limit)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", *partition_by: str) -> None:
    df.write.mode(mode).partitionBy(*partition_by).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def as_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))
