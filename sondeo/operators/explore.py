"""Relations between columns and the aggregates behind the standard charts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondeo.functions.schema import numeric_columns, string_columns
from sondeo.operators.profile import column_moments, distinct_counts
from sondeo.operators.quantiles import fit_quantiles, quantile_rows
from sondeo.workspace import broadcast_if_small


# A sample of this many rows places the origin; it bears on rounding only.
ORIGIN_ROWS = 1000


@dataclass
class Products:
    """Sums over all rows of products of columns, whose values are taken from an origin, absent ones as 0.

    ``both``: rows with both columns; ``values[a, b]``, ``squares[a, b]``: sums of a and of its squares where b is
    present; ``cross``: sums of a times b; ``scale``: largest magnitudes.
    """

    both: np.ndarray
    values: np.ndarray
    squares: np.ndarray
    cross: np.ndarray
    scale: np.ndarray


def correlation_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(col_a, col_b, correlation) over pairwise-complete rows; NULL where undefined.

    One scan, whatever the number of columns: all pairwise-complete sums are products of the blocks that the rows
    arrive in, see :class:`Products`.
    """
    columns = sorted({c for pair in pairs for c in pair})
    at = {c: i for i, c in enumerate(columns)}
    sums = _products(df, columns) if columns else None
    rows = [(a, b, i, _correlation_of(at[a], at[b], sums) if sums else None) for i, (a, b) in enumerate(pairs)]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, pair int, correlation double")


def _products(df: DataFrame, columns: list[str]) -> Products | None:
    """The products of all pairs of columns; None for an empty table. A task sends one row per column and kind."""
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    sample = numbers.limit(ORIGIN_ROWS).toArrow()
    if not sample.num_rows:
        return None
    k = len(columns)
    origin = np.array([pc.mean(c).as_py() or 0.0 for c in sample.columns])

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, largest = np.zeros((4, k, k)), np.zeros(k)
        for batch in batches:
            absent = np.column_stack([c.is_null().to_numpy(zero_copy_only=False) for c in batch.columns])
            values = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns])
            largest = np.maximum(largest, np.abs(values).max(axis=0, initial=0.0))
            here = (~absent).astype(float)
            values = np.where(absent, 0.0, values - origin)
            total += np.stack([here.T @ here, values.T @ here, (values * values).T @ here, values.T @ values])
        rows = [*total.reshape(4 * k, k), largest]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(rows)), pa.int32()), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], names=["line", "sums"]
        )

    parts = numbers.mapInArrow(multiplied, "line int, sums array<double>").select("line", F.posexplode("sums"))
    # Sums add up; of magnitudes, the last line, the largest counts.
    summed = parts.groupBy("line", "pos").agg(F.when(F.first("line") < 4 * k, F.sum("col")).otherwise(F.max("col")).alias("x"))
    found = np.zeros((4 * k + 1, k))
    cells = summed.toArrow()  # 4 k^2 + k numbers for k columns
    found[cells["line"].to_numpy(), cells["pos"].to_numpy()] = cells["x"].to_numpy()
    return Products(*found[: 4 * k].reshape(4, k, k), found[4 * k])


def _correlation_of(a: int, b: int, sums: Products) -> float | None:
    n = sums.both[a, b]
    if not n:
        return None
    sx, sy = sums.values[a, b], sums.values[b, a]
    spread_x = sums.squares[a, b] - sx * sx / n
    spread_y = sums.squares[b, a] - sy * sy / n
    # A column that only varies by rounding is constant.
    noise = [n * (1e-13 * sums.scale[c]) ** 2 for c in (a, b)]
    if spread_x <= noise[0] or spread_y <= noise[1]:
        return None
    r = (sums.cross[a, b] - sx * sy / n) / math.sqrt(spread_x * spread_y)
    return float(max(-1.0, min(1.0, r)))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every pair once (column order); mirror it for a square matrix."""
    columns = columns or numeric_columns(df)
    return correlation_pairs(df, list(combinations(columns, 2))).drop("pair")


def high_correlations(
    df: DataFrame, columns: list[str] | None = None, threshold: float = 0.5, k: int = 20
) -> DataFrame:
    """Strongest pairs first, at most ``k`` (the report's length)."""
    pairs = correlation_matrix(df, columns).where(F.abs("correlation") > threshold)
    rounded = pairs.withColumn("correlation", F.round("correlation", 4))
    return rounded.orderBy(F.desc(F.abs("correlation")), "col_a", "col_b").limit(k)


def target_correlations(
    df: DataFrame, target: str, columns: list[str] | None = None, threshold: float = 0.1
) -> DataFrame:
    """Numeric features whose correlation with the target passes the threshold."""
    columns = columns or numeric_columns(df, [target])
    rows = correlation_pairs(df, [(c, target) for c in columns if c != target])
    return rows.where(F.abs("correlation") > threshold).select(
        F.col("col_a").alias("column"),
        F.round("correlation", 4).alias("correlation"),
        F.round(F.abs("correlation"), 4).alias("abs_correlation"),
    )


def group_means(df: DataFrame, key: str, target: str, most: int = 20) -> DataFrame:
    """Mean target per category; no rows unless there are 2 to ``most`` categories."""
    means = (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("category"))
        .agg(F.round(F.avg(target), 4).alias("mean"))
    )
    groups = means.agg(F.count("*").alias("n")).scalar()
    return means.where(groups.between(2, most))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n) over equal-width bins, empty ones included."""
    value = F.col(column).cast("double")
    span = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("s")).first()["s"]
    if span["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n bigint")
    low, width = span["lo"], (span["hi"] - span["lo"]) / bins
    place = F.floor((value - low) / width) + 1 if width > 0 else F.lit(1)
    counts = (
        df.where(value.isNotNull())
        .groupBy(F.least(place, F.lit(bins)).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    # Both sides have at most ``bins`` rows.
    return every.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (F.lit(low) + (F.col("bin") - 1) * width).alias("low"),
        (F.lit(low) + F.col("bin") * width).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def histogram_with_median(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    median = fit_quantiles(df, [column], [0.5]).get(column, [None])[0]
    return histogram(df, column, bins).withColumn("median", F.lit(median).cast("double"))


def box_summary(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """Quartiles, whisker ends (furthest value within 1.5 IQR) and outliers per group."""
    keys = [by] if by else []
    present = df.where(F.col(by).isNotNull()) if by else df
    quartile = [F.get("quantiles", F.lit(i)) for i in range(3)]
    boxes = quantile_rows(present, columns, [0.25, 0.5, 0.75], keys).select(
        *keys,
        "column",
        "n",
        *[q.alias(name) for q, name in zip(quartile, ("q1", "median", "q3"))],
        (quartile[0] - 1.5 * (quartile[2] - quartile[0])).alias("_low"),
        (quartile[2] + 1.5 * (quartile[2] - quartile[0])).alias("_high"),
    )
    cells = F.explode(
        F.array(
            *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]
        )
    )
    cell_rows = present.select(*keys, cells.alias("cell")).select(*keys, "cell.*")
    fences = boxes.select(*keys, "column", "_low", "_high")
    inside = F.col("v").between(F.col("_low"), F.col("_high"))
    reach = (
        cell_rows.join(broadcast_if_small(fences), [*keys, "column"])
        .groupBy(*keys, "column")
        .agg(
            F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )
    return boxes.drop("_low", "_high").join(reach, [*keys, "column"])


def count_chart(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(k)


def target_chart(df: DataFrame, target: str) -> DataFrame:
    """Histogram for a numeric target with more than ten values, else a count chart."""
    numeric = isinstance(df.schema[target].dataType, T.NumericType)
    if numeric and df.select(target).where(F.col(target).isNotNull()).distinct().limit(11).count() > 10:
        return histogram_with_median(df, target)
    return count_chart(df, target)


def pair_sample(df: DataFrame, order: list[str], columns: list[str] | None = None, k: int = 1000) -> DataFrame:
    """First ``k`` complete rows in a stated order: the scatter matrix shows a sample."""
    columns = columns or numeric_columns(df)[:5]
    complete = df.dropna(subset=columns)
    return complete.orderBy(*order).limit(k).select(*columns)


def recommended_features(df: DataFrame, target: str, most_values: int = 20) -> DataFrame:
    """Features to model with: correlated ones, then numeric, then small categoricals.

    (feature, position) with each feature once, at its first position.
    """
    spark = df.sparkSession
    position = {c: i for i, c in enumerate(df.columns)}
    place = F.create_map(*[x for c, i in position.items() for x in (F.lit(c), F.lit(i))])
    numeric = [c for c in numeric_columns(df, [target])]
    correlated = target_correlations(df, target).select(
        F.col("column").alias("feature"), F.lit(1).alias("priority")
    )
    named = spark.createDataFrame([(c, 2) for c in numeric], "feature string, priority int")
    candidates = correlated.unionByName(named)
    strings = string_columns(df, [target])
    if strings:
        small = distinct_counts(df, strings).where(F.col("distinct_values") <= most_values)
        candidates = candidates.unionByName(
            small.select(F.col("column").alias("feature"), F.lit(3).alias("priority"))
        )
    # One row per schema column from here on.
    ranked = (
        candidates.groupBy("feature")
        .agg(F.min("priority").alias("priority"))
        .withColumn("_place", F.element_at(place, F.col("feature")))
    )
    order = F.row_number().over(W.orderBy("priority", "_place"))
    return ranked.select("feature", "priority", order.cast("bigint").alias("position"))


def findings(df: DataFrame, target: str) -> DataFrame:
    """Exploration findings as (kind, column, other, metric, value) rows."""
    def shaped(rows: DataFrame, kind: str, column: str, other: str | None, metric: str, value: str):
        return rows.select(
            F.lit(kind).alias("kind"),
            F.col(column).alias("column"),
            (F.col(other) if other else F.lit(None)).cast("string").alias("other"),
            F.lit(metric).alias("metric"),
            F.col(value).cast("double").alias("value"),
        )

    numeric = numeric_columns(df)
    out = shaped(column_moments(df, numeric), "univariate", "column", None, "skewness", "skewness")
    if target in numeric:
        related = target_correlations(df, target)
        out = out.unionByName(shaped(related, "bivariate", "column", None, "correlation", "correlation"))
        for c in string_columns(df):
            means = group_means(df, c, target).withColumn("column", F.lit(c))
            out = out.unionByName(shaped(means, "group_mean", "column", "category", "mean", "mean"))
    strong = high_correlations(df, numeric)
    return out.unionByName(shaped(strong, "correlation", "col_a", "col_b", "correlation", "correlation"))
