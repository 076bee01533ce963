"""File formats, versions, snapshots and streaming over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondeo.functions.timestamps import day
from sondeo.operators import registry
from sondeo.plans.catalog import query, table
from sondeo.sources import files, tables
from sondeo.streaming import refresh
from sondeo.workspace import scratch_path

_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"
_ORDER_SCHEMA = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
)


def _orders(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )


@query(_ORDERS)
def csv_scan(spark, folder):
    path = scratch_path(spark, "orders", folder) + ".csv"
    files.write_csv(_orders(spark, folder), path)
    return files.load(spark, path, schema=_ORDER_SCHEMA)


@query(_ORDERS)
def tsv_scan(spark, folder):
    path = scratch_path(spark, "orders", folder) + ".tsv"
    _orders(spark, folder).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
    return files.load(spark, path, schema=_ORDER_SCHEMA)


@query(_ORDERS)
def json_scan(spark, folder):
    path = scratch_path(spark, "orders", folder) + ".json"
    files.write_json(_orders(spark, folder), path)
    return files.load(spark, path, schema=_ORDER_SCHEMA)


@query(_ORDERS)
def parquet_scan(spark, folder):
    return files.load(spark, f"{folder}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def directory_scan(spark, folder):
    path = scratch_path(spark, "orders_by_status", folder)
    files.write_csv(_orders(spark, folder).withColumn("status", F.col("o_orderstatus")), path, "overwrite", "status")
    everything = files.load_directory(spark, path, ".csv", schema=_ORDER_SCHEMA)
    return everything.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def cached_table(spark, folder):
    path = scratch_path(spark, "status_counts", folder)

    def build():
        return _orders(spark, folder).groupBy("o_orderstatus").agg(F.count("*").alias("n"))

    tables.cached_table(spark, path, build)
    return tables.cached_table(spark, path, build)


@query(
    """SELECT to_json({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus}) AS json FROM orders"""
)
def json_lines(spark, folder):
    return files.as_json_lines(_orders(spark, folder).select("o_orderkey", "o_orderstatus"))


@query("SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus")
def sql_transform(spark, folder):
    return registry.sql_transform(
        table(spark, folder, "orders"),
        "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM {df} "
        "WHERE o_totalprice > :low GROUP BY o_orderstatus",
        low=100000,
    )


# The event log as writes to one key per user.
_LOG = "log AS (SELECT user_id, event_id, ts, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events)"


def _log(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_id", "ts", "value", "event_type")
    return tables.numbered_versions(events, "user_id", ["ts", "event_id"], day("ts"))


@query(f"WITH {_LOG} SELECT * FROM log")
def version_numbers(spark, folder):
    return _log(spark, folder)


@query(
    f"""WITH {_LOG} SELECT user_id, max(version) AS version, max(ts) AS updated_at FROM log GROUP BY user_id"""
)
def version_latest(spark, folder):
    return tables.newest_versions(_log(spark, folder), "user_id", "ts")


@query(f"WITH {_LOG} SELECT user_id, event_id, ts, value, event_type, version FROM log WHERE version = 3")
def version_at(spark, folder):
    return _log(spark, folder).where(F.col("version") == 3)


@query(f"WITH {_LOG} SELECT user_id, event_type AS source, version, ts FROM log WHERE event_type IS NOT NULL")
def lineage(spark, folder):
    named = _log(spark, folder).where(F.col("event_type").isNotNull())
    return named.select("user_id", F.col("event_type").alias("source"), "version", "ts")


@query(
    """SELECT event_type AS source, CAST(ts AS DATE) AS snapshot FROM (SELECT DISTINCT event_type, CAST(ts AS DATE) AS ts FROM events)
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) <= 24"""
)
def retention(spark, folder):
    log = table(spark, folder, "events").select(F.col("event_type").alias("source"), day("ts").alias("snapshot"))
    return refresh.kept_snapshots(log, 24)


@query(
    """SELECT event_id, event_type AS source, CAST(ts AS DATE) AS snapshot, value FROM events
    WHERE (event_type, CAST(ts AS DATE)) IN (SELECT event_type, max(CAST(ts AS DATE)) FROM events GROUP BY event_type)"""
)
def latest_snapshot(spark, folder):
    log = table(spark, folder, "events").select(
        "event_id", F.col("event_type").alias("source"), day("ts").alias("snapshot"), "value"
    )
    return refresh.latest(log).select("event_id", "source", "snapshot", "value")


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def stream_ingest(spark, folder):
    landed = f"{folder}/events.parquet"
    target = scratch_path(spark, "live", folder)
    stream = refresh.read_stream(spark, landed, spark.read.parquet(landed).schema)
    refresh.start_refresh(stream, target, "events", f"{target}-progress", once=True).awaitTermination()
    newest = refresh.load_latest(spark, target, ["events"])["events"]
    return newest.drop("source", "snapshot", "snapshot_ts")


@query(
    """SELECT version, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM
    (SELECT CAST(1 AS BIGINT) AS version, o_totalprice FROM orders UNION ALL SELECT 2, o_totalprice * 2 FROM orders) GROUP BY version"""
)
def versioned_table(spark, folder):
    base = scratch_path(spark, "versions", folder)
    tables.clear(spark, base)
    orders = _orders(spark, folder)
    tables.store_version(orders, base, "orders", "first")
    tables.store_version(orders.withColumn("o_totalprice", F.col("o_totalprice") * 2), base, "orders")
    both = [
        tables.read_version(spark, base, "orders", i).select(
            F.lit(i + 1).cast("bigint").alias("version"), "o_totalprice"
        )
        for i in (0, 1)
    ]
    return both[0].unionByName(both[1]).groupBy("version").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )
