"""Trends, association tests and risk scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondeo.functions.moments import correlation
from sondeo.operators.ordering import lagged
from sondeo.workspace import broadcast_if_small


def trend_slope(df: DataFrame, time: Column, value: str, by: list[str] | None = None) -> DataFrame:
    """Least-squares slope of the value over time, per group."""
    x, y = time.cast("double"), F.col(value).cast("double")
    present = df.withColumns({"_x": x, "_y": y}).dropna(subset=["_x", "_y"])
    slope = F.try_divide(F.covar_pop("_y", "_x"), F.var_pop("_x")).alias("slope")
    return present.groupBy(*(by or [])).agg(F.count("*").alias("n"), slope)


def autocorrelation(
    df: DataFrame, keys: list[str], order: list, column: str, offsets: list[int], span: Column, row_id: str
) -> DataFrame:
    """Correlation of a value with itself ``k`` rows earlier in its key, over all keys."""
    shifted = lagged(df, keys, order, column, offsets, span, row_id)
    cells = [
        F.struct(
            F.lit(k).alias("lag"),
            correlation(column, f"{column}_lag_{k}").alias("autocorrelation"),
        )
        for k in offsets
    ]
    return shifted.agg(F.explode(F.array(*cells)).alias("x")).select("x.*")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    present = df.dropna(subset=[a, b])
    return present.groupBy(a, b).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, a: str, b: str, values: list) -> DataFrame:
    """Counts of ``a`` by the named values of ``b``, one column each."""
    return df.groupBy(a).pivot(b, values).agg(F.count(F.lit(1))).fillna(0)


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence test statistic and degrees of freedom.

    Cells never seen add exactly their expected count, so the sum over seen cells of
    ``n^2 / expected`` minus the total is the whole statistic.
    """
    cells = contingency(df, a, b)
    rows, columns = W.partitionBy(a), W.partitionBy(b)
    marked = cells.withColumns({"_r": F.sum("n").over(rows), "_c": F.sum("n").over(columns)})
    n = F.col("n").cast("double")
    part = n * n / (F.col("_r").cast("double") * F.col("_c"))
    return marked.agg(
        (F.sum(part) * F.sum(n) - F.sum(n)).alias("chi2"),
        ((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("dof"),
        F.sum("n").alias("n"),
    )


def risk_fusion(df: DataFrame, weights: DataFrame, on: list[str], risks: list[str]) -> DataFrame:
    """Adds ``risk``: the weighted sum of the risk columns, weights named ``w_<risk>``."""
    total = sum((F.col(r) * F.col(f"w_{r}") for r in risks), F.lit(0.0))
    joined = df.join(broadcast_if_small(weights), on, "left")
    return joined.withColumn("risk", total).drop(*[f"w_{r}" for r in risks])


def ranked_actions(df: DataFrame, by: list[str], row_id: str, k: int | None = None) -> DataFrame:
    """``priority = impact * risk * feasibility / cost``, ranked within each group.

    With ``k`` only the best of each group are kept, and kept early.
    """
    scored = df.withColumn(
        "priority", F.try_divide(F.col("impact") * F.col("risk") * F.col("feasibility"), F.col("cost"))
    )
    order = W.partitionBy(*by).orderBy(F.desc_nulls_last("priority"), row_id)
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def flood_action(flood_risk: Column, elevation: Column, low: float = 250.0) -> Column:
    return F.when((flood_risk > 70) & (elevation < low), "drainage_expansion")


def alerts(df: DataFrame, risk: str, threshold: float) -> DataFrame:
    return df.where(F.col(risk) > threshold)
