"""Model metrics from prediction tables. Everything reduces to counts first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondeo.operators.ordering import running_total
from sondeo.workspace import cut_lineage

MOST_CLASSES = 1000


def confusion_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Every (label, prediction) cell, zeros included. The result is classes squared."""
    counts = confusion_counts(df, label, prediction)
    classes = counts.select(F.explode(F.array("label", "prediction")).alias("label")).distinct()
    if classes.limit(MOST_CLASSES + 1).count() > MOST_CLASSES:
        raise ValueError("too many classes for a full matrix; use confusion_counts")
    every = classes.agg(F.collect_list("label").alias("all")).scalar()
    grid = classes.select("label", F.explode(every).alias("prediction"))
    return grid.join(counts, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).alias("n")
    )


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """precision, recall, F1 and support per class; 0 where undefined."""
    counts = confusion_counts(df, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), hit.alias("hits"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"), F.lit(0).cast("bigint").alias("hits"), F.col("n").alias("predicted")),
    )
    sums = (
        counts.select(F.explode(sides).alias("s"))
        .groupBy("s.class")
        .agg(*[F.sum(f"s.{c}").cast("double").alias(c) for c in ("support", "hits", "predicted")])
    )
    zero = F.lit(0.0)
    rated = sums.withColumns(
        {
            "precision": F.coalesce(F.try_divide("hits", "predicted"), zero),
            "recall": F.coalesce(F.try_divide("hits", "support"), zero),
        }
    )
    f1 = F.try_divide(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall"))
    return rated.withColumn("f1", F.coalesce(f1, zero)).select(
        "class", F.col("support").cast("bigint").alias("support"), F.col("hits").cast("bigint").alias("hits"),
        "precision", "recall", "f1",
    )


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 in one row."""
    report = class_report(df, label, prediction)
    weight = F.sum("support").cast("double")

    def weighted(name: str) -> Column:
        return F.round(F.try_divide(F.sum(F.col(name) * F.col("support")), weight), 4).alias(name)

    accuracy = F.round(F.try_divide(F.sum("hits").cast("double"), weight), 4).alias("accuracy")
    return report.agg(accuracy, weighted("precision"), weighted("recall"), weighted("f1"))


def roc_auc(df: DataFrame, score: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve (ties count half); NULL with a single class.

    Rows collapse to counts per distinct score before anything is ordered; the counts are
    written once, as several passes read them. A NULL score ranks below all others.
    """
    by = by or []
    groups = df.groupBy(*by, score).agg(
        F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n")
    )
    ranked = running_total(cut_lineage(groups), score, {"_below": "_n"}, by)
    wins = F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2))
    pairs = F.sum("_p").cast("double") * F.sum("_n").cast("double")
    sized = [F.try_divide(wins, pairs).alias("roc_auc"), F.sum("_p").alias("positives")]
    return ranked.groupBy(*by).agg(*sized) if by else ranked.agg(*sized)


def roc_auc_one_vs_rest(df: DataFrame, label: str, scores: str, classes: list) -> DataFrame:
    """Support-weighted mean of the per-class AUC; ``scores`` is an array in class order."""
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("class"),
                    F.get(F.col(scores), F.lit(i)).cast("double").alias("score"),
                    (F.col(label) == c).alias("hit"),
                )
                for i, c in enumerate(classes)
            ]
        )
    )
    long = df.where(F.col(label).isNotNull()).select(cells.alias("cell")).select("cell.*")
    each = roc_auc(long, "score", F.col("hit"), ["class"])
    defined = F.when(F.col("roc_auc").isNotNull(), F.col("positives"))
    return each.agg(
        F.try_divide(F.sum(F.col("roc_auc") * F.col("positives")), F.sum(defined).cast("double")).alias("roc_auc")
    )


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """R2, RMSE, MAE and MAPE in one scan."""
    pairs = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    y = F.col(label).cast("double")
    error = y - F.col(prediction)
    spread = F.var_pop(y) * F.count("*")
    relative = F.avg(F.abs(F.try_divide(error, y)))
    return pairs.agg(
        F.round(F.lit(1.0) - F.try_divide(F.sum(error * error), spread), 4).alias("r2"),
        F.round(F.sqrt(F.avg(error * error)), 4).alias("rmse"),
        F.round(F.avg(F.abs(error)), 4).alias("mae"),
        F.round(relative, 4).alias("mape"),
    )


def fold_summary(scores: DataFrame, model: str = "model", score: str = "score") -> DataFrame:
    """Mean and population deviation of fold scores per model."""
    return scores.groupBy(model).agg(
        F.round(F.avg(score), 4).alias("cv_mean"), F.round(F.stddev_pop(score), 4).alias("cv_std")
    )


def ranked_models(summary: DataFrame, model: str = "model") -> DataFrame:
    """Best mean first; ties by name. One row per model."""
    order = W.orderBy(F.desc("cv_mean"), model)
    return summary.withColumn("rank", F.row_number().over(order).cast("bigint"))
