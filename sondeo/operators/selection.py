"""Mutual information, redundancy and the choice of features."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondeo.functions.schema import numeric_columns
from sondeo.operators.explore import correlation_pairs
from sondeo.operators.features import MISSING_CATEGORY, quantile_bin
from sondeo.operators.neighbours import neighbour_information
from sondeo.operators.quantiles import between_cuts, fit_quantiles

BINS = 10


def mutual_information(
    df: DataFrame, features: list[str], target: str, bins: int = BINS, continuous_target: bool = False
) -> DataFrame:
    """(feature, mi) in nats, from quantile-binned features.

    Only (feature, bin, class) counts are shuffled: ``bins`` times classes per feature.
    A continuous target is binned the same way.
    """
    probabilities = [i / bins for i in range(1, bins)]
    filled = df.fillna(0, subset=features)
    edges = fit_quantiles(filled, [*features, *([target] if continuous_target else [])], probabilities)
    if continuous_target:
        label = quantile_bin(F.col(target), edges[target]).cast("string")
    else:
        label = F.coalesce(F.col(target).cast("string"), F.lit(MISSING_CATEGORY))
    # Each feature is a branch that reads its own column and the target. A value that
    # equals an edge shares the bin below it, which codes 2k and 2k + 1 stand for.
    branches = []
    for f in features:
        cells = filled.select(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v"), label.alias("label"))
        coded, meanings = between_cuts(cells, "v", sorted(set(edges.get(f, []))))
        bin_of = F.get(F.array(*[F.lit(m // 2) for m in meanings]), F.col("code").cast("int"))
        branches.append(coded.select("feature", bin_of.alias("bin"), "label"))
    # Over N rows the information is ln N + (sum of n ln n over cells, less that over bins and over labels) / N.
    cells = reduce(DataFrame.unionAll, branches).groupBy("feature", "bin", "label").agg(F.count("*").alias("n"))
    feature, bin_, label_ = (F.col(c) for c in ("feature", "bin", "label"))
    sides = cells.groupingSets(
        [[feature, bin_, label_], [feature, bin_], [feature, label_], [feature]], feature, bin_, label_
    ).agg(F.sum("n").cast("double").alias("n"), F.grouping_id().alias("side"))
    total, part = F.max(F.when(F.col("side") == 3, F.col("n"))), F.col("n") * F.ln("n")
    signed = F.when(F.col("side") == 0, part).when(F.col("side") == 3, F.lit(0.0)).otherwise(-part)
    scores = sides.groupBy("feature").agg(F.greatest(F.ln(total) + F.sum(signed) / total, F.lit(0.0)).alias("mi"))
    # One row per feature, needed by several later steps.
    return df.sparkSession.createDataFrame(scores.collect(), "feature string, mi double")


def redundant_features(
    df: DataFrame, features: list[str], scores: DataFrame, threshold: float = 0.95
) -> DataFrame:
    """Features to drop: of each correlated pair the one with less information.

    The left one goes on a tie. A feature without a score counts as 0.
    """
    filled = df.select(*features).fillna(0)
    pairs = correlation_pairs(filled, list(combinations(features, 2)))
    close = pairs.where(F.abs("correlation") > threshold)
    # One score row per feature.
    left = F.broadcast(scores.select(F.col("feature").alias("col_a"), F.col("mi").alias("mi_a")))
    right = F.broadcast(scores.select(F.col("feature").alias("col_b"), F.col("mi").alias("mi_b")))
    zero = F.lit(0.0)
    scored = close.join(left, "col_a", "left").join(right, "col_b", "left")
    loser = F.when(F.coalesce("mi_b", zero) < F.coalesce("mi_a", zero), F.col("col_b")).otherwise(
        F.col("col_a")
    )
    return scored.select(loser.alias("feature")).distinct()


def select_features(
    df: DataFrame,
    target: str,
    features: list[str] | None = None,
    most: int = 50,
    least_mi: float = 0.001,
    continuous_target: bool = False,
    by_neighbours: bool = False,
) -> DataFrame:
    """(feature, mi, rank): informative, non-redundant features, best first.

    When none is informative the first ten of the ranking are kept. Information is estimated from quantile bins, or,
    for a class and ``by_neighbours``, from nearest neighbours.
    """
    features = features or numeric_columns(df, [target])
    if by_neighbours and continuous_target:
        raise ValueError("nearest neighbours are compared within a class; a continuous target has none")
    if by_neighbours:
        found = neighbour_information(df, features, target).collect()  # one row per feature, needed twice below
        scores = df.sparkSession.createDataFrame(found, "feature string, mi double")
    else:
        scores = mutual_information(df, features, target, continuous_target=continuous_target)
    kept = scores.join(redundant_features(df, features, scores), "feature", "left_anti")
    # One row per feature: the ranking window is as wide as the schema.
    ranked = kept.withColumn("rank", F.row_number().over(W.orderBy(F.desc("mi"), "feature")))
    top = ranked.where(F.col("rank") <= most)
    best = F.max("mi").over(W.partitionBy(F.lit(0)))
    chosen = F.when(best > least_mi, F.col("mi") > least_mi).otherwise(F.col("rank") <= 10)
    return top.withColumn("_chosen", chosen).where("_chosen").select("feature", F.round("mi", 4).alias("mi"), "rank")


def leakage_flags(df: DataFrame, target: str, features: list[str], limit: float = 0.95) -> DataFrame:
    """Numeric features so close to a numeric target that they may restate it."""
    rows = correlation_pairs(df, [(f, target) for f in features if f != target])
    return rows.where(F.abs("correlation") > limit).select(
        F.col("col_a").alias("feature"), F.round("correlation", 4).alias("correlation")
    )
