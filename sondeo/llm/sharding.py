"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Rows of equal text are a group. Small groups are summed into a fixed number of bundles by hash; a group with a
noticeable share of the corpus stands alone. These few thousand items, whatever the size of the corpus, are placed
largest first, each where the dot product of its vector with the shard's residual capacity is highest.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sondeo.llm.common import numbered, quoted, stored, without

SHARDS = 16
BUNDLES = 4096
#: A group stands alone above this part of a shard; so at most 3 x shards x ALONE groups do.
ALONE = 64
_SIZES = ["bytes", "tokens", "rows"]
#: Bytes weigh most in the dot product: they are what must come out near equal.
WEIGHTS = np.array([16.0, 1.0, 1.0])


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (a row of sizes, each column summing to 1), largest items first."""
    residual = np.full((shards, items.shape[1]), 1.0 / shards)
    chosen = np.zeros(len(items), dtype=np.int64)
    for i in np.lexsort((np.arange(len(items)), -items.max(axis=1))):
        chosen[i] = int(np.argmax(residual @ (items[i] * WEIGHTS)))
        residual[chosen[i]] -= items[i]
    return chosen


def _text(docs: DataFrame) -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _group(docs: DataFrame) -> list[Column]:
    return [F.xxhash64(_text(docs)).alias("_g1"), F.xxhash64(F.lit(1), _text(docs)).alias("_g2")]


def _marked(docs: DataFrame, columns: list[Column], size: Column) -> DataFrame:
    crc32 = F.crc32(_text(docs).cast("binary")).cast("long")
    return docs.select(*columns, *_group(docs), size.alias("size"), crc32.alias("text_crc32"))


def _in_order(celled: DataFrame, names: list[Column], starts: DataFrame, shards: int, bundles: int) -> DataFrame:
    """The rows with their shard, numbered in it by ``_order``: by spans of it, as many pieces in all as bundles."""
    spans = max(1, bundles // shards)
    last = celled.agg(F.coalesce(F.max("_order"), F.lit(0))).first()[0]
    placed = celled.join(F.broadcast(starts.drop("_start")), "_cell").withColumn(
        "_span", F.coalesce(F.floor(F.col("_order") / (last // spans + 1)), F.lit(-1))
    )
    order = [F.col(c) for c in ("_order", "doc_id", "_g1", "_g2")]
    return numbered(placed, ["shard"], "_span", order, "slot").select(*names, "size", "text_crc32", "shard", "slot")


def shard(docs: DataFrame, shards: int = SHARDS, bundles: int = BUNDLES, order: str | None = None) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    Size is the bytes of the text in UTF-8 plus 1. Rows of equal text (null as empty) are in one shard, unless the
    group is larger than a shard in bytes, tokens or rows: then it is split by a hash of ``doc_id`` into quarters of
    a shard or less. Sums of bytes, tokens (words between white space) and rows are near equal by shard.

    With ``order``, a column of whole numbers from 0 with no long gaps and few ties, the slots of a shard follow it and
    the column is left out of the result; without, they have no order that means anything.

    Repeated rows each have a slot of their own; null ids come first among theirs. Input columns with the names of
    the result are replaced. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = without(docs, "size", "text_crc32", "shard", "slot")
    names = [quoted(c) for c in docs.columns if c != order]
    size = (F.octet_length(_text(docs)) + 1).cast("long")
    # Words begin where a byte of white space does not precede: count them by the white space between.
    words = F.size(F.split(F.translate(_text(docs), "\t\n\x0b\x0c\r", "     "), " +")).cast("long")
    rows = stored(
        docs.select(F.col("doc_id").alias("_id"), *_group(docs), size.alias("bytes"), words.alias("tokens")), "sized"
    )
    groups = stored(
        rows.groupBy("_g1", "_g2").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")),
        "groups",
    )
    total = np.array([x or 0 for x in groups.agg(*[F.sum(c) for c in _SIZES]).first()], dtype=float)
    total = np.maximum(total, 1)
    least = total / (shards * ALONE)
    alone = (F.col("bytes") > least[0]) | (F.col("tokens") > least[1]) | (F.col("rows") > least[2])
    large = groups.where(alone).orderBy("_g1", "_g2").collect()  # bounded: see ALONE
    pieces, cells, first = {}, {}, {}
    next_cell = bundles  # cells are numbered through: bundles first, then those of the large groups
    for n, r in enumerate(large):
        share = max(r[c] / t for c, t in zip(_SIZES, total)) * shards
        pieces[n] = 1 if share <= 1 else math.ceil(4 * share)
        cells[n] = pieces[n] * math.ceil(share * ALONE / pieces[n])  # what is numbered together is a small part of a shard
        first[n] = next_cell
        next_cell += cells[n]
    known = spark.createDataFrame(
        [(r["_g1"], r["_g2"], first[n], cells[n]) for n, r in enumerate(large)],
        "_g1 long, _g2 long, _first long, _cells long",
    )

    def celled(df: DataFrame, id_column: str) -> DataFrame:
        """With the cell: the bundle, or a piece of a large group by a hash of the id."""
        own = F.col("_first") + F.pmod(F.xxhash64(id_column), F.col("_cells"))
        return (
            df.join(F.broadcast(known), ["_g1", "_g2"], "left")  # bounded: see ALONE
            .withColumn("_cell", F.coalesce(own, F.pmod("_g1", F.lit(bundles))))
            .drop("_first", "_cells")
        )

    in_cell = celled(rows, "_id").groupBy("_cell").agg(*[F.sum(c).alias(c) for c in ("bytes", "tokens")], F.count(F.lit(1)).alias("rows"))
    sizes = {r["_cell"]: [r[c] for c in _SIZES] for r in in_cell.collect()}  # one row per cell: bounded
    owner = {c: c for c in sizes if c < bundles}  # of each cell, the first cell of what is placed with it
    for n in range(len(large)):
        owner |= {first[n] + c: first[n] + c % pieces[n] for c in range(cells[n])}
    placed = sorted(set(owner.values()))
    index = {o: i for i, o in enumerate(placed)}
    items = np.zeros((len(placed), 3))
    for c, size_of in sizes.items():
        items[index[owner[c]]] += size_of
    chosen = place(items / total, shards)
    starts, upto = [], [0] * shards
    for c in sorted(sizes):
        home = int(chosen[index[owner[c]]])
        starts.append((c, home, upto[home]))
        upto[home] += sizes[c][2]
    starts = spark.createDataFrame(starts, "_cell long, shard int, _start long")
    if order is not None:
        return _in_order(celled(_marked(docs, [*names, quoted(order).alias("_order")], size), "doc_id"), names, starts, shards, bundles)
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy("doc_id", "_g1", "_g2"))
    return (
        celled(_marked(docs, names, size), "doc_id")
        .withColumn("_inside", inside)
        .join(F.broadcast(starts), "_cell")
        .select(*names, "size", "text_crc32", "shard", (F.col("_start") + F.col("_inside") - 1).cast("long").alias("slot"))
    )
