"""Snapshot refresh: landed files become snapshots, newest first, old ones dropped.

A snapshot table is a folder ``source=<name>/snapshot=<batch>``. A batch always writes
its own folder, so a batch that is retried replaces itself and nothing is doubled.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sondeo.operators.increments import merge_states, profile_state, state_profile
from sondeo.operators.ordering import top_k_per_key
from sondeo.workspace import broadcast_if_small, delete_path, is_directory, path_exists

LOG = logging.getLogger(__name__)
KEEP = 24
INTERVAL = "1 hour"


def snapshot_folder(table: str, source: str, snapshot: int) -> str:
    return f"{table}/source={source}/snapshot={snapshot:010d}"


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", **options
) -> DataFrame:
    """Stream the files of a landing folder (or a single landed file)."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if is_directory(spark, path):
        return reader.load(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).load(folder)


def start_refresh(
    stream: DataFrame,
    table: str,
    source: str,
    checkpoint: str,
    once: bool = False,
    interval: str = INTERVAL,
    keep: int | None = KEEP,
    after: Callable[[DataFrame], None] | None = None,
    profiles: str | None = None,
) -> StreamingQuery:
    """Write each micro-batch as a snapshot, drop expired ones, then run ``after``.

    One query per source: a failing source does not stop the others. ``once`` takes all
    files landed so far and ends; otherwise the query polls every ``interval``. An error in
    ``after`` is logged and the stream goes on. With ``profiles``, the profile state of each snapshot is kept in that
    folder, also after the snapshot expired: see :func:`running_profile`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        stamped = batch.withColumn("snapshot_ts", F.current_timestamp())
        stamped.write.mode("overwrite").parquet(snapshot_folder(table, source, batch_id))
        if profiles is not None:  # before anything expires; a batch that is retried replaces its state
            stored = batch.sparkSession.read.parquet(snapshot_folder(table, source, batch_id)).drop("snapshot_ts")
            profile_state(stored).write.mode("overwrite").parquet(snapshot_folder(profiles, source, batch_id))
        if keep is not None:
            drop_expired(batch.sparkSession, table, keep, source)
        if after is not None:
            try:
                after(batch.sparkSession.read.parquet(snapshot_folder(table, source, batch_id)))
            except Exception:  # noqa: BLE001 - the snapshot is stored; a failing re-run must not end the refresh
                LOG.exception("re-run after the refresh of %s failed", source)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": interval}
    return writer.queryName(f"refresh_{source}").trigger(**trigger).start()


def running_profile(spark: SparkSession, profiles: str, source: str | None = None) -> DataFrame | None:
    """The profile, by source, of all rows ever refreshed, from the states alone; None while there are none."""
    states = snapshots(spark, profiles)
    if states is None:
        return None
    if source is not None:
        states = states.where(F.col("source") == source)
    return state_profile(merge_states(states.drop("snapshot"), ["source"]))


def snapshots(spark: SparkSession, table: str) -> DataFrame | None:
    """All kept snapshots; None while nothing was stored."""
    return spark.read.parquet(table) if path_exists(spark, table) else None


def latest(df: DataFrame, source: str = "source", stamp: str = "snapshot") -> DataFrame:
    """Rows of the newest snapshot of each source.

    There is one newest stamp per source; once measured to be small it is broadcast, so
    rows are matched in place and snapshot folders are pruned.
    """
    newest = df.groupBy(source).agg(F.max(stamp).alias(stamp))
    return df.join(broadcast_if_small(newest), [source, stamp], "left_semi")


def load_latest(spark: SparkSession, table: str, sources: list[str]) -> dict[str, DataFrame]:
    """Newest snapshot per source; a source without one is left out."""
    stored = snapshots(spark, table)
    if stored is None:
        return {}
    known = {r["source"] for r in stored.select("source").distinct().collect()}
    return {s: latest(stored.where(F.col("source") == s)) for s in sources if s in known}


def kept_snapshots(
    df: DataFrame, keep: int = KEEP, source: str = "source", stamp: str = "snapshot"
) -> DataFrame:
    """The newest ``keep`` (source, stamp) pairs per source."""
    return top_k_per_key(df.select(source, stamp).distinct(), [source], [F.desc(stamp)], keep)


def drop_expired(spark: SparkSession, table: str, keep: int = KEEP, source: str | None = None) -> list[str]:
    """Delete the folders of snapshots older than the newest ``keep``; returns them.

    Works on folder names of partitions only, which are few.
    """
    stored = snapshots(spark, table)
    if stored is None:
        return []
    if source is not None:
        stored = stored.where(F.col("source") == source)
    pairs = stored.select("source", "snapshot").distinct()
    expired = pairs.join(kept_snapshots(pairs, keep), ["source", "snapshot"], "left_anti").collect()
    folders = [snapshot_folder(table, r["source"], r["snapshot"]) for r in expired]
    for folder in folders:
        delete_path(spark, folder)
    return folders
