"""Quality classifier by co-training of two views, text content and page metadata.

Each view has a logistic model. In each round every document is scored, and the documents that one view is sure of
become training rows of the other. At the end both views are calibrated on labelled rows that no model has seen and
combined into one score for every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondeo.llm.common import stored

#: About so many labelled rows at most are fitted on, and so many pseudo-labelled ones join a view in a round.
MAX_LABELLED = 20_000
MAX_PSEUDO = 4_000
ROUNDS = 2
SURE = 0.98
MIN_SCORE = 0.5
HELD_OUT = 4  # one labelled row in so many is for calibration
TRIGRAMS, SOURCES, LANGS = 256, 32, 8


def content(text: str | None) -> np.ndarray:
    """Hashed byte trigrams of the whole text (relative counts, square roots) and a few ratios."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    n = max(len(raw), 1)
    kinds = np.bincount(_KIND[raw], minlength=6) / n
    if len(raw) >= 3:
        counts = np.zeros(TRIGRAMS, dtype=np.int64)
        for start in range(0, len(raw) - 2, 1 << 20):  # blocks that overlap by two bytes
            wide = raw[start : start + (1 << 20) + 2].astype(np.uint16)
            mix = (wide[:-2] * np.uint16(40503)) ^ (wide[1:-1] * np.uint16(30011)) ^ (wide[2:] * np.uint16(52711))
            counts += np.bincount(mix >> 8, minlength=TRIGRAMS)
        share = counts / counts.sum()
    else:
        share = np.zeros(TRIGRAMS)
    even = -float(np.sum(share[share > 0] * np.log(share[share > 0])))
    return np.concatenate([np.sqrt(share), kinds, [even, float(np.sum(share**2)), 1.0 / n]])


_KIND = np.zeros(256, dtype=np.uint8)  # other
_KIND[[0x20, *range(9, 14)]] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("a") : ord("z") + 1] = 3
_KIND[ord("0") : ord("9") + 1] = 4
_KIND[128:] = 5


def metadata(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    """Language, source and the page's layout: size, lines and their mean length."""
    out = np.zeros(LANGS + SOURCES + 4)
    out[zlib.crc32((lang or "").encode()) % LANGS] = 1
    out[LANGS + zlib.crc32((source or "").encode()) % SOURCES] = 1
    size, lines = len(text or ""), (text or "").count("\n") + 1
    out[-4:] = np.log1p(size), np.log1p(lines), np.log1p(size / lines), 1.0 if lang is None or source is None else 0.0
    return out


_WIDTHS = (TRIGRAMS + 9, LANGS + SOURCES + 4)


@dataclass
class Logistic:
    """A ridge-penalised logistic model on standardised features, fitted by Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-6] = 1.0
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        w, keep = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        keep[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        return Logistic(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30)


@dataclass
class Model:
    """Two views, their calibrations (a slope and a shift each) and the weights that combine them."""

    views: list[Logistic]
    calibrated: list[Logistic]
    combined: Logistic

    def score(self, x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good by content, by metadata and by both."""
        logits = [c.logit(v.logit(part)[:, None]) for v, c, part in zip(self.views, self.calibrated, x)]
        both = self.combined.logit(np.column_stack(logits))
        return tuple(1 / (1 + np.exp(-t)) for t in (*logits, both))


def _matrices(contents: list[bytes], metas: list[bytes]) -> list[np.ndarray]:
    return [
        np.frombuffer(b"".join(part), dtype=np.float16).reshape(-1, width).astype(np.float64)
        for part, width in zip((contents, metas), _WIDTHS)
    ]


def _features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, order, label, content, metadata), stored; the label is null where there is none."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[x.as_py() for x in row] for row in zip(*batch.columns[1:])]
            first = [content(t).astype(np.float16).tobytes() for t, _, _ in rows]
            second = [metadata(*row).astype(np.float16).tobytes() for row in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(first, pa.binary()), pa.array(second, pa.binary())], names=["doc_id", "content", "metadata"]
            )

    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.min(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("label"))
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", "lang", "source").mapInArrow(made, f"doc_id {kind}, content binary, metadata binary")
    return stored(rows.join(known, "doc_id", "left").withColumn("order", F.xxhash64(F.lit(17), "doc_id")), "quality_features")


def _sample(rows: DataFrame, n: int, bound: int) -> pd.DataFrame:
    """About ``bound`` of the ``n`` rows at most: those whose hash of the id is below a threshold.

    The rows are picked where they are, so the driver receives the sample and nothing else.
    """
    part = min(1.0, bound / max(n, 1))
    picked = rows.where(F.pmod("order", F.lit(1 << 30)) < int(part * (1 << 30)) + (part == 1.0))
    return picked.select("order", "content", "metadata", "label").toPandas().sort_values(["order", "content", "metadata"])


def _sure(features: DataFrame, view: int, model: Logistic) -> pd.DataFrame:
    """Unlabelled documents that a view is sure of, with its label: scored over all rows, a bounded number returned."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = _matrices(batch.column("content").to_pylist(), batch.column("metadata").to_pylist())[view]
            p = 1 / (1 + np.exp(-model.logit(part)))
            sure = np.flatnonzero((p >= SURE) | (p <= 1 - SURE))
            picked = batch.take(pa.array(sure))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array((p[sure] > 0.5).astype(np.int32))], names=["order", "content", "metadata", "label"])

    open_rows = features.where(F.col("label").isNull()).select("order", "content", "metadata")
    sure = open_rows.mapInArrow(judged, "order long, content binary, metadata binary, label int")
    n = {r["label"]: r["n"] for r in sure.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    halves = [_sample(sure.where(F.col("label") == good), n.get(good, 0), MAX_PSEUDO // 2) for good in (0, 1)]
    return pd.concat(halves)


def train(features: DataFrame) -> Model | None:
    """The model from :func:`_features`; None without labelled rows of both classes on both sides of the split."""
    labelled = features.where(F.col("label").isNotNull())
    labelled = _sample(labelled, labelled.count(), MAX_LABELLED)
    held = labelled.order.to_numpy() % HELD_OUT == 0
    y = labelled.label.to_numpy().astype(float)
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        return None
    x = _matrices(labelled.content.tolist(), labelled.metadata.tolist())
    views = [Logistic.fit(part[~held], y[~held]) for part in x]
    for _ in range(ROUNDS):
        taught = []
        for view in (0, 1):
            more = _sure(features, 1 - view, views[1 - view])  # the other view's confident labels
            extra = _matrices(more.content.tolist(), more.metadata.tolist())[view]
            taught.append(
                Logistic.fit(np.vstack([x[view][~held], extra]), np.concatenate([y[~held], more.label.to_numpy().astype(float)]))
            )
        views = taught
    outside = [v.logit(part[held])[:, None] for v, part in zip(views, x)]
    calibrated = [Logistic.fit(t, y[held]) for t in outside]
    combined = Logistic.fit(np.column_stack([c.logit(t) for c, t in zip(calibrated, outside)]), y[held])
    return Model(views, calibrated, combined)


def classify(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, p_content, p_metadata, score, keep) for every row of ``docs``.

    ``labels`` has (doc_id, quality 0/1); several labels of a document count as their least. The models are fitted
    on about ``MAX_LABELLED`` labelled rows at most, taken by hash, plus ``MAX_PSEUDO`` pseudo-labelled rows a view and
    round; scoring covers every row. ``keep`` says that ``score``, the probability of good quality, is at least
    ``min_score``.

    Null texts are empty, null languages and sources a kind of their own. Null labels and ids teach nothing, but
    every row is scored; repeated rows are repeated. Without labelled rows of both classes the scores are null and
    all rows are kept. Extra columns are left out. An empty table gives an empty one.
    """
    features = _features(docs, labels)
    model = train(features)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        nothing = F.lit(None).cast("double")
        return features.select("doc_id", nothing.alias("p_content"), nothing.alias("p_metadata"), nothing.alias("score"), F.lit(True).alias("keep"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(_matrices(batch.column("content").to_pylist(), batch.column("metadata").to_pylist()))
            columns = [batch.column("doc_id"), *(pa.array(c) for c in p), pa.array(p[2] >= min_score)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "p_content", "p_metadata", "score", "keep"])

    out = f"doc_id {kind}, p_content double, p_metadata double, score double, keep boolean"
    return features.select("doc_id", "content", "metadata").mapInArrow(scored, out)


def good(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE) -> Column:
    """A column for ``docs`` that says which rows stay; rules as for :func:`classify`."""
    model = train(_features(docs, labels))
    if model is None:
        return F.lit(True)

    @F.pandas_udf("boolean")
    def stays(texts: pd.Series, langs: pd.Series, sources: pd.Series) -> pd.Series:
        first = [content(t).astype(np.float16).tobytes() for t in texts]
        second = [metadata(*row).astype(np.float16).tobytes() for row in zip(texts, langs, sources)]
        return pd.Series(model.score(_matrices(first, second))[2] >= min_score)

    return stays("text", "lang", "source")
