"""Model training on Spark MLlib: folds, candidates, search and importance."""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.functions.schema import numeric_columns
from sondeo.operators import metrics, search
from sondeo.operators.features import MISSING_CATEGORY, encode, standard_scale
from sondeo.operators.ordering import assign_folds, permuted
from sondeo.workspace import cut_lineage

CLASSIFICATION, REGRESSION = "classification", "regression"
FOLDS = 5
SEED = 42
# MLlib grows trees level by level and needs a bound; the cap for "unlimited" depth.
DEEPEST = 12
MLLIB_DEPTH = 30
# Few bytes a row, but much work: a task of the training gets so many rows, not what fills a file.
ROWS_PER_TASK = 8192
LOG = logging.getLogger(__name__)

# Default parameters per model.
DEFAULTS = {
    "logistic_regression": {"C": 1.0, "max_iter": 100},
    "random_forest_clf": {"n_estimators": 100, "max_depth": DEEPEST},
    "random_forest_reg": {"n_estimators": 100, "max_depth": DEEPEST},
    "ridge": {"alpha": 1.0},
    "boosted_clf": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1},
    "boosted_reg": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1},
    "boosted_deep_clf": {"n_estimators": 100, "max_depth": 10, "learning_rate": 0.1},
    "boosted_deep_reg": {"n_estimators": 100, "max_depth": 10, "learning_rate": 0.1},
}
# Search ranges as (low, high, kind).
SEARCH = {
    "random_forest": {
        "n_estimators": (50, 300, "int"),
        "max_depth": (3, 20, "int"),
        "min_samples_split": (2, 20, "int"),
        "min_samples_leaf": (1, 10, "int"),
    },
    "boosted": {
        "n_estimators": (50, 300, "int"),
        "max_depth": (3, 12, "int"),
        "learning_rate": (0.01, 0.3, "log"),
        "subsample": (0.6, 1.0, "float"),
        "colsample_bytree": (0.6, 1.0, "float"),
        "min_child_weight": (1, 10, "int"),
    },
    "logistic_regression": {"C": (0.001, 100.0, "log")},
    "ridge": {"alpha": (0.001, 100.0, "log")},
}


def resolve_name(name: str, task: str) -> str:
    """Full model name for a family and task; an unknown name means a forest."""
    suffix = "clf" if task == CLASSIFICATION else "reg"
    if f"{name}_{suffix}" in DEFAULTS:
        return f"{name}_{suffix}"
    return name if name in DEFAULTS else f"random_forest_{suffix}"


def candidates(task: str) -> list[str]:
    if task == CLASSIFICATION:
        return ["random_forest_clf", "logistic_regression", "boosted_clf", "boosted_deep_clf"]
    return ["random_forest_reg", "ridge", "boosted_reg"]


def build_estimator(name: str, params: dict, rows: int, classes: int) -> Estimator:
    """The MLlib estimator for a model name. Penalties are given per data set, MLlib's per row."""
    columns = {"featuresCol": "features", "labelCol": "label"}
    if int(params.get("max_depth", DEEPEST)) > MLLIB_DEPTH:
        LOG.warning("%s: depth %s is more than MLlib grows; %s is used", name, params["max_depth"], MLLIB_DEPTH)
    trees = {
        "maxDepth": min(int(params.get("max_depth", DEEPEST)), MLLIB_DEPTH),
        "minInstancesPerNode": max(
            int(params.get("min_samples_leaf", params.get("min_child_weight", 1))),
            int(params.get("min_samples_split", 2)) // 2,
        ),
        "seed": SEED,
        **columns,
    }
    count = int(params.get("n_estimators", 100))
    if name.startswith("random_forest"):
        kind = RandomForestClassifier if name.endswith("clf") else RandomForestRegressor
        return kind(numTrees=count, **trees)
    if name.startswith("boosted"):
        boosting = {
            "maxIter": count,
            "stepSize": float(params.get("learning_rate", 0.1)),
            "subsamplingRate": float(params.get("subsample", 1.0)),
            "featureSubsetStrategy": str(float(params.get("colsample_bytree", 1.0))),
            **trees,
        }
        if name.endswith("reg"):
            return GBTRegressor(**boosting)
        estimator = GBTClassifier(**boosting)
        return estimator if classes == 2 else OneVsRest(classifier=estimator, **columns)
    if name == "ridge":
        return LinearRegression(
            elasticNetParam=0.0, regParam=float(params["alpha"]) / rows, standardization=False, **columns
        )
    estimator = LogisticRegression(
        maxIter=int(params.get("max_iter", 100)), regParam=1.0 / (float(params["C"]) * rows), **columns
    )
    return estimator if classes == 2 else OneVsRest(classifier=estimator, **columns)


def fitted(estimator: Estimator, rows: DataFrame) -> Model:
    """The fitted model without its training summary.

    A two-class summary holds the session, and a session that has observed a query (:class:`Observation`) cannot be
    sent to tasks: nothing could be scored with the model.
    """
    model = estimator.fit(rows)
    for member in getattr(model, "models", [model]):
        if getattr(member, "hasSummary", False):
            member._java_obj.setSummary(rows.sparkSession._jvm.scala.Option.empty())
    return model


@dataclass
class TrainingData:
    """Encoded and scaled rows with ``label``, ``features`` and ``fold``, on shared storage."""

    rows: DataFrame
    task: str
    features: list[str]
    key: str
    n: int
    classes: list[str] = field(default_factory=list)


def prepare(
    df: DataFrame, target: str, keys: str | list[str], task: str, features: list[str] | None = None
) -> TrainingData:
    """Encode strings, fill gaps with 0, scale, label and deal rows into folds.

    ``keys`` identify rows and are never features; the first orders the folds. Only the
    given ``features`` are trained on, by default all columns. Scaling is fitted on all
    rows, before the folds. Every model and fold scans the result again, so it is written
    out once.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    key = keys[0]
    kept = df.where(F.col(target).isNotNull()) if task == REGRESSION else df
    if features is not None:
        kept = kept.select(*dict.fromkeys([*keys, target, *features]))
    encoded = encode(kept.withColumnRenamed(target, "_target"), "_target", keys)
    names = numeric_columns(encoded, [*keys, "_target"])
    scaled = standard_scale(encoded, names)
    classes: list[str] = []
    if task == CLASSIFICATION:
        text = F.coalesce(F.col("_target").cast("string"), F.lit(MISSING_CATEGORY))
        found = scaled.select(text.alias("c")).distinct().limit(metrics.MOST_CLASSES + 1).collect()
        if len(found) > metrics.MOST_CLASSES:
            raise ValueError(f"{target} has too many classes")
        classes = sorted(r["c"] for r in found)
        codes = F.array_position(F.array(*[F.lit(c) for c in classes]), text) - 1
        labelled = scaled.withColumn("label", codes.cast("double"))
        folded = assign_folds(labelled, key, "label", FOLDS)
    else:
        folded = assign_folds(scaled.withColumn("label", F.col("_target").cast("double")), key, None, FOLDS)
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(folded)
    rows = cut_lineage(assembled.select(key, *names, "features", "label", "fold"))
    n = rows.count()
    return TrainingData(_dealt_out(rows, n, key), task, names, key, n, classes)


def _dealt_out(rows: DataFrame, n: int, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``rows`` written anew in equal parts where they lie in too few files to keep the executors busy."""
    tasks = min(n // rows_per_task + 1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if rows.rdd.getNumPartitions() >= tasks:
        return rows
    return cut_lineage(rows.repartition(tasks).sortWithinPartitions(key, "label"))


def with_scores(predicted: DataFrame) -> DataFrame:
    """Adds ``scores``: class probabilities in class order.

    One-vs-rest models give margins only; they become probabilities that sum to 1.
    """
    if "probability" in predicted.columns:
        return predicted.withColumn("scores", vector_to_array("probability"))
    odds = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-m)))
    total = F.aggregate("_odds", F.lit(0.0), lambda a, b: a + b)
    return predicted.withColumn("_odds", odds).withColumn(
        "scores", F.transform("_odds", lambda o: o / total)
    )


def score(model: Model, rows: DataFrame, data: TrainingData) -> float | None:
    """ROC-AUC (one against the rest, weighted, for several classes) or R2."""
    predicted = model.transform(rows)
    if data.task == REGRESSION:
        return metrics.regression_metrics(predicted, "label", "prediction").first()["r2"]
    scored = with_scores(predicted)
    if len(data.classes) == 2:
        binary = scored.withColumn("score", F.get("scores", F.lit(1)))
        return metrics.roc_auc(binary, "score", F.col("label") == 1).first()["roc_auc"]
    order = [float(i) for i in range(len(data.classes))]
    return metrics.roc_auc_one_vs_rest(scored, "label", "scores", order).first()["roc_auc"]


def cross_validate(
    data: TrainingData, name: str, params: dict, parallelism: int = 2, with_training: bool = True
) -> list[tuple[int, float | None, float | None]]:
    """(fold, held-out score, training score if asked for); folds are fitted by concurrent jobs."""
    estimator = build_estimator(name, params, data.n, len(data.classes))
    with ThreadPool(parallelism) as pool:
        return pool.map(lambda fold: _fold_scores(data, estimator, fold, with_training), range(FOLDS), 1)


def _fold_scores(
    data: TrainingData, estimator: Estimator, fold: int, with_training: bool
) -> tuple[int, float | None, float | None]:
    train = data.rows.where(F.col("fold") != fold)
    model = fitted(estimator, train)
    held_out = score(model, data.rows.where(F.col("fold") == fold), data)
    return fold, held_out, score(model, train, data) if with_training else None


@dataclass
class TrainedModel:
    name: str
    params: dict
    model: Model
    data: TrainingData
    folds: DataFrame
    cv_mean: float
    cv_std: float

    def predictions(self) -> DataFrame:
        return self.model.transform(self.data.rows)

    def evaluation(self) -> DataFrame:
        """One row: fold mean and spread, train-test gap, and metrics on the training rows."""
        predicted = self.predictions()
        gap = self.folds.agg(F.round(F.avg("train_score") - F.avg("score"), 4).alias("train_test_gap"))
        if self.data.task == REGRESSION:
            fitted = metrics.regression_metrics(predicted, "label", "prediction")
        else:
            area = score(self.model, self.data.rows, self.data)
            fitted = metrics.classification_metrics(predicted, "label", "prediction").withColumn(
                "roc_auc", F.lit(None if area is None else round(area, 4)).cast("double")
            )
        return fitted.withColumns(
            {
                "model": F.lit(self.name),
                "cv_mean": F.lit(self.cv_mean),
                "cv_std": F.lit(self.cv_std),
                "train_test_gap": gap.scalar(),
            }
        )

    def importance(self, k: int = 20) -> DataFrame:
        """Impurity importance of tree models (mean over one-vs-rest members), top ``k``."""
        members = getattr(self.model, "models", [self.model])
        vectors = [m.featureImportances.toArray() for m in members if hasattr(m, "featureImportances")]
        rows = [
            (f, float(sum(v[i] for v in vectors) / len(vectors)))
            for i, f in enumerate(self.data.features)
            if vectors
        ]
        frame = self.data.rows.sparkSession.createDataFrame(rows, "feature string, importance double")
        return frame.orderBy(F.desc("importance"), "feature").limit(k)


def train(data: TrainingData, name: str, params: dict | None = None, parallelism: int | None = None) -> TrainedModel:
    """Cross-validate and fit on all rows, by concurrent jobs.

    By default two fits at a time, as the driver holds the trees of each; boosting keeps few trees but waits for many
    short jobs, so all its fits run together.
    """
    name = resolve_name(name, data.task)
    merged = {**DEFAULTS[name], **(params or {})}
    estimator = build_estimator(name, merged, data.n, len(data.classes))
    with ThreadPool(parallelism or (FOLDS + 1 if name.startswith("boosted") else 2)) as pool:
        whole = pool.apply_async(fitted, (estimator, data.rows))
        folds = pool.map(lambda fold: _fold_scores(data, estimator, fold, True), range(FOLDS), 1)
        model = whole.get()
    held_out = [s for _, s, _ in folds if s is not None]
    mean = sum(held_out) / len(held_out) if held_out else math.nan
    spread = math.sqrt(sum((s - mean) ** 2 for s in held_out) / len(held_out)) if held_out else math.nan
    frame = data.rows.sparkSession.createDataFrame(
        [(name, f, s, t) for f, s, t in folds], "model string, fold int, score double, train_score double"
    )
    return TrainedModel(name, merged, model, data, frame, round(mean, 4), round(spread, 4))


def search_ranges(name: str) -> dict[str, search.Range]:
    return SEARCH[next(f for f in SEARCH if name.startswith(f))]


def tune(data: TrainingData, name: str, trials: int = 30, seed: int = SEED, parallelism: int = 2) -> TrainedModel:
    """Search the declared ranges by the densities of past trials; the best fold mean is trained in full.

    Half of ``parallelism`` trials, one at least, are in flight, each with its folds fitted by concurrent jobs. A trial
    that fails or has no score counts as one of the worst.
    """
    name = resolve_name(name, data.task)

    def fold_mean(params: dict) -> float | None:
        try:
            folds = cross_validate(data, name, {**DEFAULTS[name], **params}, parallelism, False)
        except Exception as reason:  # noqa: BLE001 - one failing trial must not end the search
            LOG.warning("trial of %s failed: %s", name, reason)
            return None
        scores = [s for _, s, _ in folds if s is not None]
        return sum(scores) / len(scores) if scores else None

    tried = search.maximise(fold_mean, search_ranges(name), trials, seed, max(1, parallelism // 2))
    scored = [t for t in tried if t[1] is not None]
    best = max(scored, key=lambda t: t[1])[0] if scored else {}
    return train(data, name, {**DEFAULTS[name], **best}, parallelism)


def compete(
    data: TrainingData,
    names: list[str] | None = None,
    trials: int = 0,
    params: dict | None = None,
    params_of: dict[str, dict] | None = None,
) -> tuple[TrainedModel, DataFrame]:
    """Train the candidates, rank them by fold mean, tune the best if ``trials`` are given.

    ``params`` hold for all candidates, ``params_of`` for those it names.

    The tuned model is adopted only if it is better. A candidate that fails stays in the
    ranking, after the others, without scores and with the reason in ``error``.
    """
    trained, failed = [], []
    for name in names or candidates(data.task):
        try:
            trained.append(train(data, name, {**(params or {}), **(params_of or {}).get(name, {})}))
        except Exception as reason:  # noqa: BLE001 - one failing candidate must not end the contest
            failed.append((name, None, None, f"{type(reason).__name__}: {reason}"[:300]))
    if not trained:
        raise ValueError(f"no candidate could be trained: {failed}")
    champion = max(trained, key=lambda t: t.cv_mean)
    if trials:
        tuned = tune(data, champion.name, trials)
        champion = tuned if tuned.cv_mean > champion.cv_mean else champion
    summary = data.rows.sparkSession.createDataFrame(
        [*[(t.name, t.cv_mean, t.cv_std, None) for t in trained], *failed],
        "model string, cv_mean double, cv_std double, error string",
    )
    return champion, metrics.ranked_models(summary)


def permutation_importance(trained: TrainedModel, k: int = 20, seed: int = SEED) -> DataFrame:
    """Loss of score when one feature takes the values of other rows, top ``k``; NULL where there is no score."""
    data = trained.data
    base = score(trained.model, data.rows, data)
    shuffled = cut_lineage(permuted(data.rows.drop("features"), data.features, data.key, "_p_", seed))
    rows = []
    for feature in data.features:
        inputs = [f"_p_{f}" if f == feature else f for f in data.features]
        changed = VectorAssembler(inputCols=inputs, outputCol="features").transform(shuffled)
        lost = score(trained.model, changed, data)
        rows.append((feature, None if base is None or lost is None else float(base - lost)))
    frame = data.rows.sparkSession.createDataFrame(rows, "feature string, importance double")
    return frame.orderBy(F.desc("importance"), "feature").limit(k)
