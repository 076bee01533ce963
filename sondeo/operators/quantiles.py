"""Exact quantiles that stay distributed.

Spark's ``percentile`` keeps every distinct value of a group in one task, which neither
scales nor is quick. Two other ways give the same answer:

* ``fit_quantiles`` narrows in on each wanted rank. A sketch over a sample proposes cut
  points, one scan counts the values between the cuts, and the interval that holds the
  rank is either small enough to be sorted or cut again. The sample decides how fast
  intervals shrink, never what the answer is. Nothing is shuffled but counts and the
  values of the last, bounded intervals.
* ``_sliced`` does one such round lazily for a table with many groups.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondeo.workspace import aggregate_wide, broadcast_if_small, null_safe_join

# Rows one task may hold for an exact answer over many groups.
EXACT_ROWS = 2_000_000
# Values of one interval that are sorted together.
INTERVAL_ROWS = 200_000
SAMPLE_ROWS = (50_000, 20_000_000)
SKETCH_ACCURACY = 10_000
# Series (group and column pairs) that are narrowed in one go.
MOST_SERIES = 64


def is_large(df: DataFrame) -> bool:
    """More rows than one task should hold; a footer count for Parquet scans."""
    return df.count() > EXACT_ROWS


def fit_quantiles(
    df: DataFrame, columns: list[str], probabilities: Sequence[float]
) -> dict[str, list[float]]:
    """Interpolated quantiles per column; a column without values is left out."""
    fitted = fit_series(df, {c: F.col(c) for c in columns}, probabilities)
    return {c: values for c, (_, values) in fitted.items()}


def fit_series(
    df: DataFrame, series: dict[object, Column], probabilities: Sequence[float]
) -> dict[object, tuple[int, list[float]]]:
    """(count, quantiles) of the non-NULL values of each named expression."""
    if not series:
        return {}
    names = list(series)
    values = [series[n].cast("double") for n in names]
    sizes = list(aggregate_wide(df, {i: F.count(v) for i, v in enumerate(values)}).values())
    positions = {i: [p * (n - 1) for p in probabilities] for i, n in enumerate(sizes) if n}
    known: dict[tuple[int, int], float] = {}
    # Per series: open intervals (low, high) -> (values below, values inside, wanted ranks).
    unsolved = {
        i: {(-math.inf, math.inf): (0, sizes[i], {f(p) for p in at for f in (math.floor, math.ceil)})}
        for i, at in positions.items()
    }
    while True:
        wide = {
            i: {k: v for k, v in intervals.items() if v[1] > INTERVAL_ROWS}
            for i, intervals in unsolved.items()
        }
        wide = {i: intervals for i, intervals in wide.items() if intervals}
        if not wide:
            break
        edges = _propose(df, values, wide, sizes)
        counts = _count_between(df, values, edges)
        for i, cuts in edges.items():
            ranks = set().union(*(r for _, _, r in wide[i].values()))
            narrow = {k: v for k, v in unsolved[i].items() if k not in wide[i]}
            unsolved[i] = {**narrow, **_locate(i, cuts, counts, sizes[i], ranks, known)}
    known.update(_sort_intervals(df, values, unsolved))
    return {
        names[i]: (sizes[i], [_between(known, i, position) for position in at])
        for i, at in positions.items()
    }


def between_cuts(df: DataFrame, column: str, cuts: list[float]) -> tuple[DataFrame, list[int]]:
    """Non-NULL rows with ``code``, and what each code means.

    Meaning 2k is "below cut k" (and above the one before), 2k + 1 is "equal to cut k".
    The place of a value is found by binary search.
    """
    present = df.where(F.col(column).isNotNull())
    splits, meanings = [-math.inf], [0]
    for k, cut in enumerate(cuts):
        if splits[-1] == cut:
            splits.pop()
            meanings.pop()
        splits += [cut, math.nextafter(cut, math.inf)]
        meanings += [2 * k + 1, 2 * k + 2]
    if not cuts:
        return present.withColumn("code", F.lit(0.0)), meanings
    bucketizer = Bucketizer(splits=[*splits, math.inf], inputCol=column, outputCol="code")
    return bucketizer.transform(present), meanings


def _between(known: dict[tuple[int, int], float], i: int, position: float) -> float:
    low, high = known[i, math.floor(position)], known[i, math.ceil(position)]
    return low + (high - low) * (position - math.floor(position))


def _propose(df: DataFrame, values: list[Column], wide: dict, sizes) -> dict[int, list[float]]:
    """Cut points just around the wanted ranks of each wide interval, from a sample."""
    rows = max(sizes)
    sample = min(max(rows // 10, SAMPLE_ROWS[0]), SAMPLE_ROWS[1])
    biggest = max(size for intervals in wide.values() for _, size, _ in intervals.values())
    fraction = min(1.0, sample / biggest)
    expressions, owners = [], []
    for i, intervals in wide.items():
        for (low, high), (below, size, ranks) in intervals.items():
            margin = 1.5 / math.sqrt(max(size * fraction, 1.0)) + 2.0 / SKETCH_ACCURACY
            around = sorted(
                {min(max((r - below) / size + s * margin, 0.0), 1.0) for r in ranks for s in (-1, 1)}
            )
            inside = F.when((values[i] > low) & (values[i] < high), values[i])
            expressions.append(F.percentile_approx(inside, around, SKETCH_ACCURACY))
            owners.append((i, low, high))
    sampled = df.sample(fraction, seed=7) if fraction < 1.0 else df
    cuts = sampled.agg(*[e.alias(str(n)) for n, e in enumerate(expressions)]).first()
    if any(c is None for c in cuts):
        # A sample may miss a narrow interval; every row cannot.
        cuts = df.agg(*[e.alias(str(n)) for n, e in enumerate(expressions)]).first()
    edges: dict[int, set[float]] = {}
    for (i, low, high), found in zip(owners, cuts):
        edges.setdefault(i, set()).update([low, high, *found])
    return {i: sorted(e for e in found if math.isfinite(e)) for i, found in edges.items()}


def _count_between(df: DataFrame, values: list[Column], edges: dict[int, list[float]]) -> dict:
    """(series, cut) -> (values below the cut, values up to and including it).

    Each series is a branch that reads its own column and keeps only a code per value:
    2k lies below cut k, 2k + 1 equals it. Codes are counted before the shuffle.
    """
    branches, codes = [], {}
    for i, cuts in edges.items():
        coded, codes[i] = between_cuts(df.select(F.lit(i).alias("series"), values[i].alias("value")), "value", cuts)
        branches.append(coded.select("series", "code"))
    rows = reduce(DataFrame.unionAll, branches).groupBy("series", "code").count().collect()
    counted = {(r[0], codes[r[0]][int(r[1])]): r[2] for r in rows}
    found = {}
    for i, cuts in edges.items():
        below = 0
        for k, cut in enumerate(cuts):
            below += counted.get((i, 2 * k), 0)
            upto = below + counted.get((i, 2 * k + 1), 0)
            found[i, cut] = (below, upto)
            below = upto
    return found


def _locate(i: int, cuts: list[float], counts: dict, size: int, ranks: set[int], known: dict) -> dict:
    """Ranks that fall on a cut are known; the others name their open interval."""
    intervals: dict[tuple[float, float], tuple[int, int, set[int]]] = {}
    for rank in ranks:
        low, below = -math.inf, 0
        high, until = math.inf, size
        for cut in cuts:
            under, upto = counts[i, cut]
            if under <= rank < upto:
                known[i, rank] = cut
                break
            if rank < under:
                high, until = cut, under
                break
            low, below = cut, upto
        if (i, rank) not in known:
            here = intervals.setdefault((low, high), (below, until - below, set()))
            here[2].add(rank)
    return intervals


def _sort_intervals(df: DataFrame, values: list[Column], unsolved: dict) -> dict:
    """Ranks read off the sorted values of intervals that hold at most INTERVAL_ROWS."""
    branches, places = [], []
    for i, intervals in unsolved.items():
        if not intervals:
            continue
        cuts = sorted({e for bounds in intervals for e in bounds if math.isfinite(e)})
        slots = {}
        for (low, _), (below, _, ranks) in intervals.items():
            slots[2 * (cuts.index(low) + 1) if math.isfinite(low) else 0] = len(places)
            places.append((i, below, sorted(ranks)))
        coded, codes = between_cuts(df.select(values[i].alias("value")), "value", cuts)
        slot_of = F.get(F.array(*[F.lit(slots.get(c)).cast("int") for c in codes]), F.col("code").cast("int"))
        branches.append(coded.select(slot_of.alias("slot"), "value"))
    if not places:
        return {}
    wanted = F.array(*[F.array(*[F.lit(r - below + 1) for r in ranks]) for _, below, ranks in places])
    picked = (
        reduce(DataFrame.unionAll, branches)
        .where("slot IS NOT NULL")
        .groupBy("slot")
        .agg(F.array_sort(F.collect_list("value")).alias("v"))
        .select("slot", F.transform(F.get(wanted, F.col("slot")), lambda r: F.element_at("v", r)).alias("at"))
    )
    found = {}
    for row in picked.collect():
        i, _, ranks = places[row["slot"]]
        found.update({(i, r): v for r, v in zip(ranks, row["at"])})
    return found


def quantile_rows(
    df: DataFrame, columns: list[str], probabilities: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """(by..., column, n, quantiles) with interpolated quantiles of the non-NULL values."""
    by, probabilities = list(by), list(probabilities)
    spark = df.sparkSession
    groups = [()]
    if by:
        groups = [tuple(r) for r in df.select(*by).distinct().limit(MOST_SERIES + 1).collect()]
    if len(groups) * len(columns) <= max(MOST_SERIES, len(columns)):
        series = {}
        for group in groups:
            member = F.lit(True)
            for name, value in zip(by, group):
                member = member & F.col(name).eqNullSafe(F.lit(value))
            for c in columns:
                series[(*group, c)] = F.when(member, F.col(c)) if by else F.col(c)
        fitted = fit_series(df, series, probabilities)
        schema = T.StructType([df.schema[name] for name in by])
        schema = schema.add("column", T.StringType()).add("n", T.LongType())
        schema = schema.add("quantiles", T.ArrayType(T.DoubleType()))
        return spark.createDataFrame([(*name, n, q) for name, (n, q) in fitted.items()], schema)
    if is_large(df):
        return _sliced(df, columns, probabilities, by)
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("n"),
            F.percentile(F.col(c).cast("double"), probabilities).alias("quantiles"),
        )
        for c in columns
    ]
    grouped = df.groupBy(*by).agg(F.explode(F.array(*cells)).alias("cell")).select(*by, "cell.*")
    return grouped.where(F.col("n") > 0)


def _sliced(df: DataFrame, columns: list[str], probabilities: list[float], by: list[str]) -> DataFrame:
    keys = [*by, "column"]
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                for c in columns
            ]
        )
    )
    long = df.select(*by, cells.alias("cell")).select(*by, "cell.*").where(F.col("value").isNotNull())
    margin = 2.0 / SKETCH_ACCURACY
    edges = sorted({min(max(p + s * margin, 0.0), 1.0) for p in probabilities for s in (-1, 1)})
    sketch = long.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.percentile_approx("value", edges, SKETCH_ACCURACY).alias("cuts"),
    )
    # Sketch rows are one per group: measured before they are broadcast.
    known = broadcast_if_small(sketch)
    slice_of = sum(
        (F.when(F.col("value") > F.get("cuts", F.lit(i)), 1).otherwise(0) for i in range(len(edges))),
        F.lit(0),
    )
    sliced = null_safe_join(long, known, keys).select(*keys, "value", slice_of.alias("slice"))

    earlier = W.partitionBy(*keys).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    sizes = (
        sliced.groupBy(*keys, "slice")
        .agg(F.count("*").alias("size"))
        .withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    )
    ranks = F.array(
        *[edge(F.lit(p) * (F.col("n") - 1)).cast("bigint") for p in probabilities for edge in (F.floor, F.ceil)]
    )
    wanted = sketch.select(*keys, F.explode(F.array_distinct(ranks)).alias("rank"))
    needed = (
        null_safe_join(wanted, sizes, keys)
        .where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("size")))
        .select(*keys, "slice", "rank", "before")
    )
    slices = needed.select(*keys, "slice").distinct()
    within = W.partitionBy(*keys, "slice").orderBy("value")
    ordered = (
        null_safe_join(sliced, broadcast_if_small(slices), [*keys, "slice"], "left_semi")
        .groupBy(*keys, "slice", "value")
        .agg(F.count("*").alias("copies"))
        .withColumn("upto", F.sum("copies").over(within))
    )
    found = null_safe_join(ordered, needed, [*keys, "slice"]).where(
        (F.col("rank") < F.col("before") + F.col("upto"))
        & (F.col("rank") >= F.col("before") + F.col("upto") - F.col("copies"))
    )
    by_rank = found.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at")
    )
    return null_safe_join(by_rank, sketch.select(*keys, "n"), keys).select(
        *keys, "n", F.array(*[_interpolated(p) for p in probabilities]).alias("quantiles")
    )


def _interpolated(p: float) -> Column:
    position = F.lit(p) * (F.col("n") - 1)
    low = F.element_at("at", F.floor(position).cast("bigint"))
    high = F.element_at("at", F.ceil(position).cast("bigint"))
    return low + (high - low) * (position - F.floor(position))


def fit_fences(
    df: DataFrame, columns: list[str], multiplier: float, positive_spread: bool = True
) -> dict[str, tuple[float, float]]:
    """Tukey fences per column; with ``positive_spread`` only where Q3 > Q1."""
    fences = {}
    for column, (q1, q3) in fit_quantiles(df, columns, [0.25, 0.75]).items():
        spread = q3 - q1
        if spread > 0 or not positive_spread:
            fences[column] = (q1 - multiplier * spread, q3 + multiplier * spread)
    return fences
