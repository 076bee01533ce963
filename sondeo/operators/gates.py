"""Quality gates and rule-based recommendations, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sondeo.operators.profile import missing_rates
from sondeo.workspace import MEASURES_PER_SCAN

# Thresholds per stage.
DEFAULT_GATES = {
    "data_collection": {"min_rows": 10, "min_columns": 2},
    "data_cleaning": {"max_missing_pct_after": 0.05, "min_rows_retained_pct": 0.80},
    "eda": {"min_findings": 1},
    "feature_engineering": {"min_features": 3, "max_features": 200, "min_mutual_info_score": 0.001},
    "modeling": {
        "min_roc_auc": 0.55, "max_train_test_gap": 0.20, "min_r2": 0.10, "max_mape": 0.50,
    },
}

GATE_SCHEMA = "stage string, metric string, value double, threshold double, passed int"


def gate_settings(overrides: dict | None = None) -> dict:
    """Defaults with whole stages replaced by ``overrides``."""
    return {**DEFAULT_GATES, **(overrides or {})}


def check(values: DataFrame, stage: str, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """Gate rows for a one-row table of metrics.

    ``rules`` maps a metric to ("min" or "max", threshold); an absent value passes.
    """
    cells = []
    for metric, (kind, threshold) in rules.items():
        value = F.col(metric).cast("double")
        holds = value >= threshold if kind == "min" else value <= threshold
        cells.append(
            F.struct(
                F.lit(stage).alias("stage"),
                F.lit(metric).alias("metric"),
                value.alias("value"),
                F.lit(float(threshold)).alias("threshold"),
                F.coalesce(holds, F.lit(True)).cast("int").alias("passed"),
            )
        )
    return values.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def collection_gate(df: DataFrame, settings: dict | None = None) -> DataFrame:
    limits = gate_settings(settings)["data_collection"]
    values = df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"))
    return check(
        values,
        "data_collection",
        {"rows": ("min", limits.get("min_rows", 10)), "columns": ("min", limits.get("min_columns", 2))},
    )


def cleaning_gate(cleaned: DataFrame, raw: DataFrame | None = None, settings: dict | None = None) -> DataFrame:
    """Worst missing rate after cleaning, and the share of rows kept."""
    limits = gate_settings(settings)["data_cleaning"]
    rules = {"max_missing_pct": ("max", limits.get("max_missing_pct_after", 0.05))}
    values = missing_rates(cleaned).agg(F.max("missing_pct").alias("max_missing_pct"))
    if raw is not None and "min_rows_retained_pct" in limits:
        kept = cleaned.agg(F.count("*").cast("double").alias("n")).scalar()
        before = raw.agg(F.count("*").cast("double").alias("n")).scalar()
        values = values.withColumn("rows_retained_pct", F.round(F.try_divide(kept, before), 4))
        rules["rows_retained_pct"] = ("min", limits["min_rows_retained_pct"])
    return check(values, "data_cleaning", rules)


class ObservedGates:
    """The collection or cleaning gate from figures that the job which writes the table gathers on its way.

    ``rows`` passes the table on unchanged; write or aggregate that. :meth:`gate` then needs no job of its own. It waits
    for the first action on ``rows``; a table that is never used has no gate. At most :data:`workspace.MEASURES_PER_SCAN`
    columns are watched by one observation, wider tables have several.
    """

    def __init__(self, df: DataFrame, settings: dict | None = None):
        self.settings, self.columns = settings, df.columns
        self._observations = []
        for start in range(0, max(1, len(df.columns)), MEASURES_PER_SCAN):
            chunk = df.columns[start : start + MEASURES_PER_SCAN]
            seen = Observation()
            measures = [F.count_if(F.col(c).isNull()).alias(f"gaps_{i}") for i, c in enumerate(chunk)]
            df = df.observe(seen, F.count(F.lit(1)).alias("rows"), *measures)
            self._observations.append((chunk, seen))
        self.rows = df

    def figures(self) -> tuple[int, dict[str, int]]:
        """Rows, and missing values by column."""
        found = [(chunk, seen.get) for chunk, seen in self._observations]
        gaps = {c: got[f"gaps_{i}"] for chunk, got in found for i, c in enumerate(chunk)}
        return found[0][1]["rows"], gaps

    def collection_gate(self) -> DataFrame:
        limits = gate_settings(self.settings)["data_collection"]
        values = _one_row(self.rows, rows=self.figures()[0], columns=len(self.columns))
        rules = {"rows": ("min", limits.get("min_rows", 10)), "columns": ("min", limits.get("min_columns", 2))}
        return check(values, "data_collection", rules)

    def cleaning_gate(self, raw: ObservedGates | None = None) -> DataFrame:
        """As :func:`cleaning_gate`; ``raw`` was watched in the same job or an earlier one."""
        limits = gate_settings(self.settings)["data_cleaning"]
        rows, gaps = self.figures()
        worst = max((g / rows for g in gaps.values()), default=0.0) if rows else 0.0
        figures = {"max_missing_pct": worst}
        rules = {"max_missing_pct": ("max", limits.get("max_missing_pct_after", 0.05))}
        if raw is not None and "min_rows_retained_pct" in limits:
            before = raw.figures()[0]
            figures["rows_retained_pct"] = rows / before if before else None
            rules["rows_retained_pct"] = ("min", limits["min_rows_retained_pct"])
        values = _one_row(self.rows, **figures)
        return check(values.select(*[F.round(c, 4).alias(c) for c in figures]), "data_cleaning", rules)


def _one_row(df: DataFrame, **figures: float | None) -> DataFrame:
    row = tuple(None if v is None else float(v) for v in figures.values())
    return df.sparkSession.createDataFrame([row], ", ".join(f"{n} double" for n in figures))


def exploration_gate(findings: DataFrame, settings: dict | None = None) -> DataFrame:
    limits = gate_settings(settings)["eda"]
    values = findings.agg(F.count("*").alias("findings"))
    return check(values, "eda", {"findings": ("min", limits.get("min_findings", 1))})


def feature_gate(selected: DataFrame, settings: dict | None = None) -> DataFrame:
    """Bounds on the number of features, and on the weakest kept score."""
    limits = gate_settings(settings)["feature_engineering"]
    values = selected.agg(
        F.count("*").alias("n_features"), F.count("*").alias("n_features_most"), F.min("mi").alias("min_mi")
    )
    rules = {
        "n_features": ("min", limits.get("min_features", 3)),
        "n_features_most": ("max", limits.get("max_features", 200)),
    }
    if "min_mutual_info_score" in limits:
        rules["min_mi"] = ("min", limits["min_mutual_info_score"])
    return check(values, "feature_engineering", rules)


def model_gate(metrics: DataFrame, settings: dict | None = None) -> DataFrame:
    """Checks the metrics the one-row table has: ROC-AUC, R2, train-test gap, MAPE."""
    limits = gate_settings(settings)["modeling"]
    known = {
        "roc_auc": ("min", limits.get("min_roc_auc", 0.55)),
        "r2": ("min", limits.get("min_r2", 0.10)),
        "train_test_gap": ("max", limits.get("max_train_test_gap", 0.20)),
        "mape": ("max", limits.get("max_mape", 0.50)),
    }
    return check(metrics, "modeling", {m: rule for m, rule in known.items() if m in metrics.columns})


def recommendations(
    spark: SparkSession,
    importance: DataFrame | None = None,
    metrics: DataFrame | None = None,
    log: DataFrame | None = None,
) -> DataFrame:
    """(rule, priority, confidence, evidence) rows for the rules the results trigger."""
    rows = spark.range(1).select(
        F.lit("deploy_with_monitoring").alias("rule"),
        F.lit("high").alias("priority"),
        F.lit(0.8).alias("confidence"),
        F.lit("always").alias("evidence"),
    )
    if importance is not None:
        top = importance.orderBy(F.desc("importance"), "feature").limit(3)
        named = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("i"), "feature"))).alias("t"))
        rows = rows.unionByName(
            named.where(F.size("t") > 0).select(
                F.lit("act_on_top_features").alias("rule"),
                F.lit("high").alias("priority"),
                F.lit(0.85).alias("confidence"),
                F.array_join(F.transform("t", lambda x: x["feature"]), ", ").alias("evidence"),
            )
        )
    if metrics is not None and "roc_auc" in metrics.columns:
        rows = rows.unionByName(
            metrics.where(F.col("roc_auc") < 0.85).select(
                F.lit("improve_accuracy").alias("rule"),
                F.lit("medium").alias("priority"),
                F.lit(0.7).alias("confidence"),
                F.concat(F.lit("roc_auc="), F.round("roc_auc", 4).cast("string")).alias("evidence"),
            )
        )
    if log is not None:
        changed = log.agg(F.coalesce(F.sum("rows_affected"), F.lit(0)).alias("n"))
        rows = rows.unionByName(
            changed.where(F.col("n") > 0).select(
                F.lit("improve_data_integrity").alias("rule"),
                F.lit("medium").alias("priority"),
                F.lit(0.75).alias("confidence"),
                F.concat(F.lit("rows_affected="), F.col("n").cast("string")).alias("evidence"),
            )
        )
    return rows
