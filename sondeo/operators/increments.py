"""Profiles that grow with a table: a mergeable state per part, merged without reading the parts again.

A state has one row per column: counts, extremes, mean and central power sums, and a sketch of the distinct values.
States of any parts merge into that of their union; counts and extremes exactly, moments up to rounding, distinct
counts within the error of the sketch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondeo.functions.moments import share
from sondeo.functions.schema import numeric_columns
from sondeo.workspace import aggregate_wide

# The sketch has 2^SKETCH registers: a standard error of 1.04 / 2^(SKETCH / 2), that is 1.6 per cent.
SKETCH = 12
COLUMNS_PER_SCAN = 20
_NUMBERS = ("min", "max", "sum", "mean", "m2", "m3", "m4")


def _cells(df: DataFrame, columns: list[str], means: dict[str, float | None]) -> DataFrame:
    """State rows of some columns, in one scan of these alone."""
    cells = []
    for c in columns:
        value = F.col(c).cast("double") if c in means else F.lit(None).cast("double")
        d = value - F.lit(means.get(c))
        powers = {f"s{k}": F.sum(reduce(Column.__mul__, [d] * k)) for k in (1, 2, 3, 4)}
        cells.append(
            F.struct(
                F.lit(c).alias("column"), F.count("*").alias("rows"), F.count(c).alias("count"),
                F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"),
                *[p.alias(n) for n, p in powers.items()],
                F.hll_sketch_agg(F.col(c).cast("string"), F.lit(SKETCH)).alias("distinct_sketch"),
            )
        )
    return df.agg(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def profile_state(df: DataFrame) -> DataFrame:
    """The state of a table: a row per column (see the module). Columns that are not numeric have no moments.

    Two scans of each column: the means first, then power sums around them, which keeps them accurate. NULLs count
    as rows only. An empty table has counts of 0 and no moments.
    """
    numeric = numeric_columns(df)
    means = aggregate_wide(df, {c: F.avg(F.col(c).cast("double")) for c in numeric})
    columns = df.columns
    parts = [_cells(df, columns[i : i + COLUMNS_PER_SCAN], means) for i in range(0, len(columns), COLUMNS_PER_SCAN)]
    n = F.col("count").cast("double")
    # The mean is off by rounding; central sums follow from those around it.
    shift = F.try_divide(F.col("s1"), n)
    central = {
        "mean": F.try_divide(F.col("sum"), n),
        "m2": F.col("s2") - n * shift * shift,
        "m3": F.col("s3") - 3 * shift * F.col("s2") + 2 * n * F.pow(shift, F.lit(3)),
        "m4": F.col("s4") - 4 * shift * F.col("s3") + 6 * shift * shift * F.col("s2") - 3 * n * F.pow(shift, F.lit(4)),
    }
    found = reduce(DataFrame.unionAll, parts).withColumns(central)
    return found.select("column", "rows", "count", *_NUMBERS, "distinct_sketch")


def merge_states(states: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One state per column (and ``keys``) of all states given, whatever parts they are of; parts may be empty.

    A column that some parts lack counts in those that have it; its rows are theirs.
    """
    keys = [*(keys or []), "column"]
    n = F.col("count").cast("double")
    values = F.sum(F.when(F.col("sum").isNotNull(), n))
    means = states.groupBy(*keys).agg(F.try_divide(F.sum("sum"), values).alias("_mean"))
    apart = states.join(means, keys).withColumn("_d", F.col("mean") - F.col("_mean"))
    d, m2, m3 = F.col("_d"), F.col("m2"), F.col("m3")
    sums = {
        "m2": m2 + n * d * d,
        "m3": m3 + 3 * d * m2 + n * F.pow(d, F.lit(3)),
        "m4": F.col("m4") + 4 * d * m3 + 6 * d * d * m2 + n * F.pow(d, F.lit(4)),
    }
    return apart.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        F.sum("count").alias("count"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.sum("sum").alias("sum"),
        F.first("_mean").alias("mean"),
        *[F.sum(c).alias(name) for name, c in sums.items()],
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
    )


def state_profile(state: DataFrame) -> DataFrame:
    """The profile a state stands for: counts, missing rate, moments as the numeric profile has them, distinct values.

    Constant columns have shape 0; deviation, skewness and kurtosis need two, three and four values.
    """
    n = F.col("count").cast("double")
    gaps = F.col("rows") - F.col("count")
    variance = F.try_divide(F.col("m2"), n)
    flat = (F.col("min") == F.col("max")) | (F.col("m2") <= 0)
    skew = F.try_divide(F.col("m3") / n, F.pow(variance, F.lit(1.5))) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    heavy = F.try_divide(F.col("m4") / n, variance * variance) - 3
    kurt = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * heavy + 6)
    numbers = {
        "mean": F.col("mean"),
        "std": F.when(n > 1, F.when(flat, 0.0).otherwise(F.sqrt(F.col("m2") / (n - 1)))),
        "skewness": F.when(n > 2, F.when(flat, 0.0).otherwise(skew)),
        "kurtosis": F.when(n > 3, F.when(flat, 0.0).otherwise(kurt)),
    }
    others = [c for c in state.columns if c not in ("rows", "count", "distinct_sketch", *_NUMBERS)]
    return state.select(
        *others,
        "count",
        gaps.alias("missing"),
        F.round(F.coalesce(share(gaps, F.col("rows")), F.lit(0.0)), 4).alias("missing_pct"),
        "min",
        "max",
        *[F.round(F.when(F.col("mean").isNotNull(), c), 4).alias(name) for name, c in numbers.items()],
        F.hll_sketch_estimate("distinct_sketch").alias("distinct_estimate"),
    )
