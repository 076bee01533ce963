"""Connected components of a table of links, contracted in tasks, then by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.llm.common import stored


#: Links are dealt to as many tasks as it takes to have about so many in each.
LINKS_PER_TASK = 200_000


def _reached(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray] | None:
    """The nodes of a task's links, and for each the place of the least node that it reaches in them."""
    parts = [[c.to_numpy() for c in batch.columns] for batch in batches]
    if parts:
        a, b = (np.concatenate(x) for x in zip(*parts))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = np.arange(len(nodes))
        left, right = at[: len(a)], at[len(a) :]
        while True:
            low = np.minimum(root[left], root[right])
            before = root.copy()
            np.minimum.at(root, left, low)
            np.minimum.at(root, right, low)
            np.minimum.at(root, before[left], low)
            np.minimum.at(root, before[right], low)
            root = root[root]
            if np.array_equal(root, before):
                break
        return nodes, root
    return None


def _local_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if found := _reached(batches):
        nodes, root = found
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "label"])


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as links to the least node that each node reaches in them."""
    if found := _reached(batches):
        nodes, root = found
        far = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["node", "to"])


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("node").agg(F.min("to").alias("least"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b: longs, not null); the label is the least node reachable.

    Every task first contracts its own links; if they fit one task, that is all. Otherwise every round joins
    links with one minimum a node, so a hub meets in no single task but as one row.
    """
    links = stored(links.select("a", "b").where("a <> b"), "links")
    tasks = -(-links.count() // LINKS_PER_TASK)
    if tasks <= 1:
        return links.repartition(1).mapInArrow(_local_labels, "node long, label long")
    contracted = links.distinct().repartition(tasks).mapInArrow(_local_stars, "node long, to long").distinct()
    links, before = stored(contracted, "links"), None
    while True:
        both = links.unionByName(links.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = _least(both).select("node", F.least("node", "least").alias("least"))
        # Large star: larger neighbours go to the least of the neighbourhood.
        large = both.where("to > node").join(least, "node").select(F.col("to").alias("node"), F.col("least").alias("to"))
        large = large.where("node <> to").distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        least = _least(large).select("node", "least")
        small = large.join(least, "node").select(
            F.explode(F.array(F.struct("node", F.col("least").alias("to")), F.struct(F.col("to").alias("node"), F.col("least").alias("to")))).alias("l")
        )
        links = stored(small.select("l.node", "l.to").where("node <> to").distinct(), "links")
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return _labelled(links)
        before = now


def _labelled(links: DataFrame) -> DataFrame:
    labelled = links.select("node", F.col("to").alias("label"))
    roots = links.select(F.col("to").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return labelled.unionByName(roots)
