"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (key hash, documents, largest document), bucketed and sorted by the hash. A batch of documents
adds its own lines as a new run of level 0, less the lines that the runs have settled already (a merge anti-join);
``fan_in`` runs of a level are compacted into one of the next. The merged runs then say which lines go.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeo.llm.common import WHITESPACE, ascii_lower, forget, quoted, scratch, stored, without

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FAN_IN = 3
_LOWEST = -(2**63)
_HASH = ["h1", "h2"]


class LineRuns:
    """The levels of runs; ``levels[i]`` holds the names of the tables of level i, oldest first."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fan_in: int = FAN_IN):
        self.spark, self.min_docs, self.fan_in = spark, min_docs, fan_in
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (h1, h2, n_docs, last_doc), one row per line key; its documents are in no other batch.

        A key that a run has in ``min_docs`` documents, none of them smaller than the batch's largest, is
        settled: more documents change neither that it repeats nor which document keeps it.
        """
        for name in [n for level in self.levels for n in level]:
            settled = (
                self.spark.table(name)
                .where(F.col("n_docs") >= self.min_docs)
                .select("h1", "h2", F.col("last_doc").alias("_kept_by"))
            )
            known = (batch.h1 == settled.h1) & (batch.h2 == settled.h2) & (settled._kept_by >= batch.last_doc)
            batch = batch.join(settled.hint("merge"), known, "left_anti")
        self._write(batch, 0)
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            self._compact(level)
            level += 1

    def merged(self) -> DataFrame:
        """One row per line key over all runs."""
        return self._merge([n for level in self.levels for n in level])

    def close(self) -> None:
        for name in list(self.paths):
            self._drop(name)

    def _merge(self, names: list[str]) -> DataFrame:
        """The runs merged by key: bucketed and sorted alike, two runs meet in a merge join without a shuffle."""
        merged = self.spark.table(names[0])
        for name in names[1:]:
            run = self.spark.table(name).withColumnsRenamed({"n_docs": "_n", "last_doc": "_last"})
            merged = merged.join(run.hint("merge"), _HASH, "full").select(
                *_HASH,
                (F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n_docs"),
                F.greatest("last_doc", "_last").alias("last_doc"),
            )
        return merged

    def _write(self, run: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch(self.spark, name)
        (
            run.repartition(self.buckets, *_HASH)
            .write.bucketBy(self.buckets, *_HASH)
            .sortBy(*_HASH)
            .option("path", self.paths[name])
            .format("parquet")
            .saveAsTable(name)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _compact(self, level: int) -> None:
        names, self.levels[level] = self.levels[level], []
        self._write(self._merge(names), level + 1)
        for name in names:
            self._drop(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        forget(self.spark, self.paths.pop(name))


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(WHITESPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Drop lines that repeat across documents, except in the largest ``doc_id`` that holds them.

    Returns the rows of ``docs`` with ``text`` replaced by the lines that stay, plus ``n_lines`` (before) and
    ``n_dropped``. Documents come in ``batches`` of descending ranges of ``doc_id``.

    A null or empty text is one empty line. Rows of one ``doc_id`` are one document when documents are counted,
    and each row loses lines of its own text; repeated rows are repeated in the result. A null ``doc_id`` is one
    document, below all others. Extra columns stay; input columns called n_lines or n_dropped are replaced. An
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    doc, text = F.coalesce(F.col("doc_id"), F.lit(_LOWEST)), F.coalesce(F.col("text"), F.lit(""))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    later = sum((F.coalesce(F.col("_doc") <= cut, F.lit(True)).cast("int") for cut in sorted(set(cuts))), F.lit(0))
    lines = stored(
        docs.select(doc.alias("_doc"), F.xxhash64(text).alias("_text"), F.posexplode(_lines(F.col("text"))).alias("_at", "_line"))
        .select("_doc", "_text", "_at", line_key(F.col("_line")).alias("_key"))
        .where(F.char_length("_key") >= min_chars)
        .select(
            "_doc", "_text", "_at", F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit(1), F.col("_key")).alias("h2"),
            later.alias("_batch"),
        ),
        "lines",
        "_batch",
    )
    runs = LineRuns(spark, min_docs, fan_in)
    for i in range(len(set(cuts)) + 1):
        batch = lines.where(F.col("_batch") == i).select("_doc", *_HASH).distinct()
        runs.add(batch.groupBy(*_HASH).agg(F.count(F.lit(1)).alias("n_docs"), F.max("_doc").alias("last_doc")))
    repeated = stored(runs.merged().where(F.col("n_docs") >= min_docs).drop("n_docs"), "repeated_lines")
    runs.close()
    drops = (
        lines.join(repeated, _HASH)
        .where(F.col("_doc") < F.col("last_doc"))
        .groupBy("_doc", "_text")
        .agg(F.array_sort(F.collect_set("_at")).alias("_drops"))
    )
    # Positions become flags by one pass over the gaps, so a text of many lines stays linear.
    flags = F.expr(
        "flatten(transform(_drops, (p, i) -> concat(array_repeat(true, p - 1 - coalesce(get(_drops, i - 1), -1)), array(false))))"
    )
    kept = F.expr("filter(_lines, (x, i) -> coalesce(get(_flags, i), true))")
    rest = [quoted(c) for c in without(docs, "n_lines", "n_dropped").columns]
    return (
        docs.select(*rest, doc.alias("_doc"), F.xxhash64(text).alias("_text"))
        .join(drops.hint("shuffle_hash"), ["_doc", "_text"], "left")
        .withColumn("_lines", _lines(F.col("text")))
        .withColumn("_flags", flags)
        .withColumn("text", F.array_join(kept, "\n"))
        .select(
            *rest,
            F.size("_lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("_drops"), F.lit(0)).cast("long").alias("n_dropped"),
        )
    )
