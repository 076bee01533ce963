"""Mutual information of continuous features and a class, by nearest neighbours of the same class.

For each value the distance to its k-th neighbour within the class is compared with how many values of any class lie
closer. Both need sorted values only: a class is numbered along the feature and cut into blocks that also see the few
positions beside them, and values within a distance are the difference of two running counts.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondeo.operators.features import MISSING_CATEGORY
from sondeo.operators.ordering import ROWS_PER_SPAN, running_number
from sondeo.workspace import broadcast_if_small, cut_lineage, null_safe_join

NEIGHBOURS = 3
BLOCK = 4096
# A span is sorted with both ends of each interval, three rows for one.
SPAN_ROWS = ROWS_PER_SPAN // 4
# A task that counts may hold one entry for each of its values.
VALUES_PER_TASK = 1 << 20
EULER = 0.5772156649015329


def digamma(n: Column) -> Column:
    """The digamma function of a whole number above 0: shifted up by 8, then its asymptotic series."""
    x = n.cast("double") + 8
    lifted = sum((1 / (n + i) for i in range(8)), F.lit(0.0))
    square = 1 / (x * x)
    series = square * (1 / 12 - square * (1 / 120 - square * (1 / 252 - square * (1 / 240))))
    return F.ln(x) - 1 / (2 * x) - series - lifted


def _cuts(df: DataFrame, n: int, features: list[str], span_rows: int) -> dict[str, list[float]]:
    """Approximate quantiles of each feature, so that a span between two holds about ``span_rows`` of the ``n`` rows."""
    spans = n // span_rows + 1
    if spans == 1:
        return {f: [] for f in features}
    found = df.approxQuantile(features, [i / spans for i in range(1, spans)], 0.25 / spans)
    return {f: sorted(set(c)) for f, c in zip(features, found)}


def _dealt_out(df: DataFrame, values: int, values_per_task: int = VALUES_PER_TASK) -> DataFrame:
    """Rows in tasks of about ``values_per_task`` of their ``values``: files hold as many as compress well into them."""
    tasks = values // values_per_task + 1
    return df.repartition(tasks, F.monotonically_increasing_id()) if tasks > 1 else df


def _span(cuts: dict[str, list[float]]):
    """How many cuts of the feature lie below a value; does not decrease along the feature."""
    if not any(cuts.values()):
        return lambda feature, value: F.lit(0)

    @F.pandas_udf("int")
    def place(feature: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([bisect_left(cuts[f], v) for f, v in zip(feature, value)], dtype="int32")

    return place


def _radius(df: DataFrame, k: int, block: int, span) -> DataFrame:
    """``df`` (feature, label, v, n, need) with the distance to the ``need``-th neighbour of the same class.

    Equal values are neighbours at distance 0. Beside a value at most k distinct ones matter on either side.
    """
    placed = running_number(df, ["feature", "label"], ["v"], "_at", span(F.col("feature"), F.col("v")))
    number, inside = F.floor((F.col("_at") - 1) / block), F.pmod(F.col("_at") - 1, F.lit(block))
    near = F.array_compact(
        F.array(F.lit(0), F.when(inside < k, F.lit(-1)), F.when(inside >= block - k, F.lit(1)))
    )
    seen = placed.withColumn("_side", F.explode(near)).withColumn("_block", number + F.col("_side"))
    order = W.partitionBy("feature", "label", "_block").orderBy("_at")
    beside = F.array(
        *[
            F.struct(F.abs(step("v", i).over(order) - F.col("v")).alias("d"), step("n", i).over(order).alias("n"))
            for i in range(1, k + 1)
            for step in (F.lag, F.lead)
        ]
    )
    # From the nearest on, the distance at which enough neighbours are gathered.
    start = F.struct((F.col("n") - 1).alias("have"), F.lit(0.0).alias("d"))
    gathered = F.aggregate(
        F.array_sort(F.filter("_beside", lambda s: s["d"].isNotNull())),
        start,
        lambda a, s: F.when(a["have"] >= F.col("need"), a).otherwise(F.struct((a["have"] + s["n"]).alias("have"), s["d"].alias("d"))),
        lambda a: a["d"],
    )
    return seen.withColumn("_beside", beside).where(F.col("_side") == 0).withColumn("r", gathered).drop("_at", "_side", "_block", "_beside")


def _counted_within(df: DataFrame, span) -> DataFrame:
    """``df`` (feature, label, v, n, need, r) with ``m``: values of any class closer than ``r``, or equal if it is 0.

    The counts before both ends of the interval come from one sort of values and ends; a span of a feature is summed
    on its own and shifted by the spans before it.
    """
    tight = F.col("r") == 0
    # At equal places an open end (0) comes before the values (1), a closed one (2) after them.
    ends = F.array(
        F.struct(F.col("v").alias("x"), F.lit(1).alias("kind"), F.lit(0).alias("sign")),
        F.struct((F.col("v") - F.col("r")).alias("x"), F.when(tight, 0).otherwise(2).alias("kind"), F.lit(-1).alias("sign")),
        F.struct((F.col("v") + F.col("r")).alias("x"), F.when(tight, 2).otherwise(0).alias("kind"), F.lit(1).alias("sign")),
    )
    spread = df.select("*", F.explode(ends).alias("_e")).select("*", "_e.x", "_e.kind", "_e.sign").drop("_e")
    spread = spread.withColumns({"_n": F.when(F.col("sign") == 0, F.col("n")).otherwise(0), "_span": span(F.col("feature"), F.col("x"))})
    before = W.partitionBy("feature").orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    starts = spread.groupBy("feature", "_span").agg(F.sum("_n").alias("_s"))
    starts = starts.select("feature", "_span", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    upto = W.partitionBy("feature", "_span").orderBy("x", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = spread.withColumn("_upto", F.sum("_n").over(upto)).join(starts, ["feature", "_span"])
    signed = F.col("sign") * (F.col("_upto") + F.col("_start"))
    return counted.groupBy("feature", "label", "v").agg(
        F.first("n").alias("n"), F.first("need").alias("need"), F.first("r").alias("r"), F.sum(signed).alias("m")
    )


def neighbour_information(
    df: DataFrame, features: list[str], target: str, k: int = NEIGHBOURS, span_rows: int = SPAN_ROWS, block: int = BLOCK
) -> DataFrame:
    """(feature, mi) in nats: nearest-neighbour mutual information of numeric features with a class.

    NULL features are 0, a NULL class is a class. Classes of one row are left out; where a class is small, all its
    other rows are the neighbours. Values with at least k equals in their class are compared by exact equality, so
    features with few values get the information of their counts. Negative estimates are 0. Without two rows of a
    class every feature has 0. Repeated rows count.

    Rows are counted by (feature, class, value) before anything is sorted, so frequent values are no burden. A
    class is sorted in spans of about ``span_rows`` rows and in blocks, never as a whole.
    """
    spark = df.sparkSession
    label = F.coalesce(F.col(target).cast("string"), F.lit(MISSING_CATEGORY))
    filled = df.select(label.alias("label"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    sizes = broadcast_if_small(filled.groupBy("label").agg(F.count("*").alias("size")).where("size > 1"))
    known = cut_lineage(filled.join(sizes, "label"))
    n = known.count()
    cuts = _cuts(known, n, features, span_rows)
    span = _span(cuts)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in features]))
    counts = (
        _dealt_out(known, n * len(features))
        .select("label", "size", pairs.alias("_p"))
        .groupBy("_p.feature", "label", "_p.v")
        .agg(F.count("*").alias("n"), F.first("size").alias("size"))
        .withColumn("need", F.least(F.lit(k), F.col("size") - 1))
    )
    weights = cut_lineage(counts.select("feature", "label", "v", "n", "need"))
    within = _counted_within(cut_lineage(_radius(weights, k, block, span)), span)
    same = F.when(F.col("r") == 0, F.col("n")).otherwise(F.col("need"))
    parts = within.groupBy("feature").agg(
        F.sum("n").alias("_all"),
        F.sum(F.col("n") * (digamma(same) - digamma(F.col("m")))).alias("_near"),
    )
    of_label = sizes.agg(F.sum(F.col("size") * digamma(F.col("size"))).alias("_labels"))  # one row
    scores = parts.join(F.broadcast(of_label)).select(
        "feature", F.greatest(digamma(F.col("_all")) + (F.col("_near") - F.col("_labels")) / F.col("_all"), F.lit(0.0)).alias("mi")
    )
    names = spark.createDataFrame([(f,) for f in features], "feature string")
    return null_safe_join(names, scores, ["feature"], "left").fillna(0.0, subset=["mi"])
