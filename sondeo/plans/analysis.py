"""The stages of an analysis, composed over one table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from sondeo.functions.schema import numeric_columns
from sondeo.operators import attribution, clean, explore, features, gates, models, profile, selection
from sondeo.workspace import cut_lineage


@dataclass
class Analysis:
    """Result tables of each stage. ``model`` is None unless a model was asked for."""

    cleaned: DataFrame
    profile: DataFrame
    cleaning_log: DataFrame
    findings: DataFrame
    features: DataFrame
    selected: DataFrame
    gates: DataFrame
    lineage: DataFrame
    model: models.TrainedModel | None = None
    ranking: DataFrame | None = None
    importance: DataFrame | None = None
    recommendations: DataFrame | None = None


def engineered(cleaned: DataFrame, target: str, keys: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Features of the cleaned table with interactions of its strongest pairs, and their origins."""
    strongest = explore.high_correlations(cleaned, numeric_columns(cleaned, [target, *keys])).limit(3)
    pairs = [(r["col_a"], r["col_b"]) for r in strongest.collect()]
    return features.transform_with_origins(cleaned, target, pairs, keys)


def _importance(trained: models.TrainedModel) -> DataFrame:
    """Mean absolute attributions of tree models; of others, the loss of score when a feature is shuffled."""
    if attribution.has_trees(trained.model):
        return attribution.attribution_importance(trained.model, trained.data)
    return models.permutation_importance(trained)


def analyse(
    raw: DataFrame,
    target: str,
    keys: list[str],
    task: str = models.CLASSIFICATION,
    model_names: list[str] | None = None,
    model_params: dict | None = None,
    trials: int = 0,
) -> Analysis:
    """Profile, clean, explore, build and select features, check gates; optionally model.

    Key columns identify rows and are never imputed, capped or used as features; the
    first one orders the folds. Models are trained on the selected features of the engineered
    table. The cleaned table is written once, since every later
    stage scans it.
    """
    profiled = profile.data_profile(raw)
    cleaned, log = clean.clean(raw, exclude=[target, *keys])
    cleaned = cut_lineage(cleaned)
    usable = cleaned.drop(*keys)
    found = explore.findings(usable, target)
    built, origins = engineered(cleaned, target, keys)
    built = cut_lineage(built)
    continuous = task == models.REGRESSION
    chosen = selection.select_features(built.drop(*keys), target, continuous_target=continuous)
    names = [r["feature"] for r in chosen.orderBy("rank").collect()]
    lineage = features.lineage(raw.sparkSession, origins, names)
    checks = (
        gates.collection_gate(raw)
        .unionByName(gates.cleaning_gate(cleaned, raw))
        .unionByName(gates.exploration_gate(found))
        .unionByName(gates.feature_gate(chosen))
    )
    result = Analysis(cleaned, profiled, log, found, built, chosen, checks, lineage)
    if model_names is None:
        return result
    data = models.prepare(built, target, keys, task, names)
    result.model, result.ranking = models.compete(data, model_names, trials, model_params)
    evaluation = result.model.evaluation()
    result.gates = checks.unionByName(gates.model_gate(evaluation))
    result.importance = _importance(result.model)
    result.recommendations = gates.recommendations(raw.sparkSession, result.importance, evaluation, log)
    return result
