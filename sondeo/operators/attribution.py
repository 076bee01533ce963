"""Additive attributions of tree models: what each feature adds to the output of a row.

The values are Shapley values of the game in which an unknown feature is averaged over the training rows that went
each way in a tree. A leaf is a box: an interval for each feature on its path, and the share of rows that the splits on
that feature let through. With t as the chance that a feature is known, the value of a leaf for feature i is the
integral over t from 0 to 1 of (in box i - share i) times the product over the other features of
share * (1 - t) + in box * t. That is a polynomial, so a few Gauss points give it exactly, for many rows and leaves
at once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeo.operators.models import TrainingData
from sondeo.workspace import delete_path, scratch_path

# Numbers held at once: rows x leaves x features of a leaf x Gauss points.
TILE = 1 << 21
ROWS_AT_ONCE = 256


@dataclass
class Boxes:
    """Leaves with equally many features on their paths, one row each."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray  # leaves x outputs


def _nodes(model: Model, spark: SparkSession) -> dict[int, dict[int, tuple]]:
    """By tree and node: (prediction, class counts, rows, left, right, feature, threshold)."""
    path = scratch_path(spark, "trees", model.uid)
    model.write().overwrite().save(path)
    found = defaultdict(dict)
    try:
        for r in spark.read.parquet(f"{path}/data").collect():  # the model, which the driver holds already
            n = r["nodeData"]
            split = n["split"]
            if split["numCategories"] > 0:
                raise ValueError("attributions are defined for splits at thresholds")
            threshold = split["leftCategoriesOrThreshold"][0] if n["leftChild"] >= 0 else 0.0
            found[r["treeID"]][n["id"]] = (
                n["prediction"], n["impurityStats"], n["rawCount"], n["leftChild"], n["rightChild"], split["featureIndex"], threshold,
            )
    finally:
        delete_path(spark, path)
    return found


def leaf_boxes(model: Model, spark: SparkSession) -> tuple[list[Boxes], np.ndarray]:
    """The leaves of a forest or of boosted trees, and the output without any known feature.

    Outputs are the class probabilities of a classifying forest, else one number: the mean of a regression forest or
    the weighted sum of boosted trees (half the log-odds when classifying).
    """
    weights = model.treeWeights
    boosted = type(model).__name__.startswith("GBT")
    classes = 1 if boosted else getattr(model, "numClasses", 1)
    scale = 1.0 if boosted else 1.0 / sum(weights)
    by_width = defaultdict(list)
    base = np.zeros(classes)
    for tree, nodes in _nodes(model, spark).items():
        open_nodes = [(0, {}, 1.0)]
        while open_nodes:
            at, box, reached = open_nodes.pop()
            prediction, stats, rows, left, right, feature, threshold = nodes[at]
            if left < 0:
                out = np.array(stats) / sum(stats) if classes > 1 else np.array([prediction])
                out = out * weights[tree] * scale
                base += out * reached
                if box:
                    by_width[len(box)].append((sorted(box.items()), out))
                continue
            low, high, share = box.get(feature, (-np.inf, np.inf, 1.0))
            for child, bounds in ((left, (low, min(high, threshold))), (right, (max(low, threshold), high))):
                part = nodes[child][2] / rows
                open_nodes.append((child, {**box, feature: (*bounds, share * part)}, reached * part))
    found = []
    for leaves in by_width.values():
        parts = np.array([[(f, *bounds) for f, bounds in box] for box, _ in leaves])
        found.append(Boxes(parts[..., 0].astype(int), parts[..., 1], parts[..., 2], parts[..., 3], np.array([v for _, v in leaves])))
    return found, base


def attribute(x: np.ndarray, boxes: list[Boxes]) -> np.ndarray:
    """Rows x features x outputs."""
    n, n_features = x.shape
    outputs = boxes[0].value.shape[1] if boxes else 1
    total = np.zeros((n, n_features * outputs))
    for b in boxes:
        width = b.feature.shape[1]
        points, weights = np.polynomial.legendre.leggauss((width + 1) // 2)  # exact up to degree width - 1
        points, weights = (points + 1) / 2, weights / 2
        step = max(1, TILE // (n * width * len(points)))
        for start in range(0, len(b.feature), step):
            s = slice(start, start + step)
            values = x[:, b.feature[s]]
            inside = ((values > b.low[s]) & (values <= b.high[s])).astype(float)
            terms = b.share[s][..., None] * (1 - points) + inside[..., None] * points
            # Shares are positive and points below 1, so no term is 0.
            rest = np.einsum("nlq,nlwq,q->nlw", terms.prod(axis=2), 1 / terms, weights, optimize=True)
            parts = (inside - b.share[s]) * rest
            for w in range(width):
                column = np.zeros((parts.shape[1], n_features, outputs))
                column[np.arange(parts.shape[1]), b.feature[s, w]] = b.value[s]
                total += parts[:, :, w] @ column.reshape(parts.shape[1], -1)
    return total.reshape(n, n_features, outputs)


def has_trees(model: Model) -> bool:
    return all(hasattr(m, "treeWeights") for m in getattr(model, "models", [model]))


def _members(model: Model) -> list[Model]:
    """The tree models in a model: itself, or those of one class against the rest."""
    if not has_trees(model):
        raise ValueError("attributions are for forests and boosted trees")
    return getattr(model, "models", [model])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def attributions(model: Model, rows: DataFrame, key: str) -> DataFrame:
    """Per row and output: key, ``output``, ``base``, ``attribution`` (one number a feature) and ``total``.

    ``total`` is the base and all attributions together: what the model gives for the row (see :func:`leaf_boxes`).
    Of a two-class forest only output 1 is listed, since output 0 is its mirror. Models of one class against the rest
    give one output per class. The trees travel with the task; the rows stay where they are. A NULL key stays.
    """
    spark = rows.sparkSession
    tables = [leaf_boxes(m, spark) for m in _members(model)]
    kind = rows.schema[key].dataType.simpleString()
    schema = f"key {kind}, output int, base double, attribution array<double>, total double"

    def explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                x, output = _matrix(part.column(1)), 0
                for boxes, base in tables:
                    found = attribute(x, boxes)
                    for o in [1] if len(base) == 2 else range(len(base)):
                        phi = found[:, :, o] if boxes else np.zeros(x.shape)
                        number = o if len(tables) == 1 else output
                        columns = [
                            part.column(0), pa.array(np.full(len(x), number, dtype=np.int32)), pa.array(np.full(len(x), base[o])),
                            pa.array(list(phi), pa.list_(pa.float64())), pa.array(base[o] + phi.sum(axis=1)),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, names=["key", "output", "base", "attribution", "total"])
                        output += 1

    taken = rows.select(F.col(key).alias("key"), vector_to_array("features").alias("x"))
    return taken.mapInArrow(explained, schema).withColumnRenamed("key", key)


def attribution_importance(model: Model, data: TrainingData, k: int = 20) -> DataFrame:
    """(feature, importance): mean absolute attribution over all training rows and outputs, top ``k``."""
    found = attributions(model, data.rows, data.key)
    spread = found.select(F.posexplode("attribution").alias("_i", "_a"))
    means = spread.groupBy("_i").agg(F.avg(F.abs("_a")).alias("importance"))  # one row per feature
    name = F.get(F.array(*[F.lit(n) for n in data.features]), F.col("_i"))
    return means.select(name.alias("feature"), "importance").orderBy(F.desc("importance"), "feature").limit(k)
