"""Column and table profiles as rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondeo.functions.moments import distribution_label, share
from sondeo.functions.schema import numeric_columns, string_columns, type_names, unpivot
from sondeo.operators.ordering import top_k_per_key
from sondeo.operators.quantiles import fit_fences, quantile_rows
from sondeo.workspace import aggregate_wide

# Columns of one wide aggregate; more go to further branches of the same job.
COLUMNS_PER_SCAN = 30


def _per_column(df: DataFrame, columns: list[str], measures) -> DataFrame:
    """Wide aggregates without a shuffle of rows, turned into one row per column."""
    parts = []
    for start in range(0, len(columns), COLUMNS_PER_SCAN):
        chunk = columns[start : start + COLUMNS_PER_SCAN]
        cells = [F.struct(F.lit(c).alias("column"), *measures(c)) for c in chunk]
        parts.append(df.agg(F.explode(F.array(*cells)).alias("cell")).select("cell.*"))
    return reduce(DataFrame.unionAll, parts)


def missing_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    def measures(c: str) -> list[Column]:
        gaps = F.count_if(F.col(c).isNull())
        return [
            gaps.alias("missing"),
            F.round(F.coalesce(share(gaps, F.count("*")), F.lit(0.0)), 4).alias("missing_pct"),
        ]

    return _per_column(df, columns or df.columns, measures)


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Exact distinct non-NULL values per column.

    Each column is its own pruned branch of one job, so values are combined before the
    shuffle and no row is multiplied. Meant for columnar sources.
    """
    branches = [
        df.select(F.col(c).alias("_value"))
        .agg(F.count_distinct("_value").alias("distinct_values"))
        .select(F.lit(c).alias("column"), "distinct_values")
        for c in columns or df.columns
    ]
    return reduce(DataFrame.unionAll, branches)


def centred_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, rows, count, mean, std, min, max, skewness and kurtosis, not rounded.

    Powers are summed around the mean, which a first scan gives: plain sums compile to
    tight loops, and a wide table is done a few columns per scan.
    """
    values = {c: F.col(c).cast("double") for c in columns}
    means = aggregate_wide(df, {c: F.avg(v) for c, v in values.items()})
    measures = {"rows": F.count("*")}
    for c, value in values.items():
        d = value - F.lit(means[c] or 0.0)
        measures.update({f"n|{c}": F.count(c), f"lo|{c}": F.min(value), f"hi|{c}": F.max(value)})
        powers = (d, d * d, d * d * d, d * d * d * d)
        measures.update({f"s{k}|{c}": F.sum(p) for k, p in enumerate(powers, 1)})
    found = aggregate_wide(df, measures)
    rows = []
    for c in columns:
        n, low, high = (found[f"{m}|{c}"] for m in ("n", "lo", "hi"))
        powers = [found[f"s{k}|{c}"] for k in (1, 2, 3, 4)]
        rows.append((c, found["rows"], n, low, high, *_shape(n, means[c], low, high, powers)))
    schema = (
        "column string, rows bigint, count bigint, min double, max double, "
        "mean double, std double, skewness double, kurtosis double"
    )
    return df.sparkSession.createDataFrame(rows, schema)


def _shape(n: int, centre: float | None, low: float, high: float, powers: list[float]) -> tuple:
    """Mean, deviation, skewness and kurtosis from power sums around the computed mean.

    The computed mean is off by rounding, which ``shift`` corrects in the higher moments.
    """
    if n == 0:
        return None, None, None, None
    shift, a2, a3, a4 = (s / n for s in powers)
    m2 = a2 - shift**2
    m3 = a3 - 3 * shift * a2 + 2 * shift**3
    m4 = a4 - 4 * shift * a3 + 6 * shift**2 * a2 - 3 * shift**4
    if low == high or m2 <= 0:
        m2, skew, kurt = 0.0, 0.0, 0.0
    else:
        skew = m3 / m2**1.5 * math.sqrt(n * (n - 1)) / (n - 2) if n > 2 else None
        kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2**2 - 3) + 6) if n > 3 else None
    spread = math.sqrt(m2 * n / (n - 1)) if n > 1 else None
    return centre, spread, skew if n > 2 else None, kurt if n > 3 else None


def column_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts and bias-corrected moments of numeric columns, four decimals."""
    gaps = F.col("rows") - F.col("count")
    return centred_moments(df, columns).select(
        "column",
        "count",
        gaps.alias("missing"),
        F.round(F.coalesce(share(gaps, F.col("rows")), F.lit(0.0)), 4).alias("missing_pct"),
        F.round("mean", 4).alias("mean"),
        F.round("std", 4).alias("std"),
        "min",
        "max",
        F.round("skewness", 4).alias("skewness"),
        F.round("kurtosis", 4).alias("kurtosis"),
    )


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, missing, moments and quartiles per numeric column."""
    columns = columns or numeric_columns(df)
    quartiles = quantile_rows(df, columns, [0.25, 0.5, 0.75]).select(
        "column",
        *[F.round(F.get("quantiles", F.lit(i)), 4).alias(q) for i, q in enumerate(("q1", "median", "q3"))],
    )
    # Both sides hold one row per column of the schema.
    return column_moments(df, columns).join(F.broadcast(quartiles), "column", "left")


def distributions(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Shape label per column, from the corrected skewness; strings are categorical."""
    numeric = columns or numeric_columns(df)
    moments = centred_moments(df, numeric).select("column", F.round("skewness", 4).alias("skewness"))
    labelled = moments.withColumn("distribution", distribution_label(F.col("skewness")))
    if columns is not None or not string_columns(df):
        return labelled
    names = [(c, None, "categorical") for c in string_columns(df)]
    return labelled.unionByName(
        df.sparkSession.createDataFrame(names, "column string, skewness double, distribution string")
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) for non-NULL values, any column type as text."""
    cells = unpivot(df, columns, "string").where(F.col("value").isNotNull())
    return cells.groupBy("column", "value").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """The ``k`` most frequent values of each column; ties by value."""
    return top_k_per_key(value_counts(df, columns), ["column"], [F.desc("n"), F.col("value")], k)


def class_balance(df: DataFrame, column: str) -> DataFrame:
    """Share of each non-NULL value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.withColumn("share", F.round(share(F.col("n"), total), 4))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows; NULL equals NULL."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    return groups.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"))


def sample_values(df: DataFrame, columns: list[str] | None = None, k: int = 3) -> DataFrame:
    """The ``k`` smallest distinct values of each column, as text.

    One minimum per pass over all columns: ``k`` scans, and nothing is shuffled.
    """
    columns = columns or df.columns
    texts = {c: F.col(c).cast("string") for c in columns}
    samples: dict[str, list[str]] = {c: [] for c in columns}
    for _ in range(k):
        beyond = {
            c: F.min(F.when(text > samples[c][-1], text) if samples[c] else text)
            for c, text in texts.items()
        }
        for c, value in aggregate_wide(df, beyond).items():
            if value is None:
                texts.pop(c)
            else:
                samples[c].append(value)
        if not texts:
            break
    return df.sparkSession.createDataFrame(list(samples.items()), "column string, samples array<string>")


def schema_summary(df: DataFrame) -> DataFrame:
    """dtype, nullable, distinct count and three sample values per column."""
    types = type_names(df)
    dtype = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    # All three sides hold one row per column of the schema.
    return (
        missing_rates(df)
        .join(F.broadcast(distinct_counts(df)), "column", "left")
        .join(F.broadcast(sample_values(df)), "column", "left")
        .select(
            "column",
            F.element_at(dtype, F.col("column")).alias("dtype"),
            (F.col("missing") > 0).cast("int").alias("nullable"),
            "distinct_values",
            F.array_join("samples", "|").alias("samples"),
        )
    )


def outlier_counts(
    df: DataFrame, columns: list[str] | None = None, multiplier: float = 1.5, positive_spread: bool = False
) -> DataFrame:
    """Values outside the fences; only columns that have some are listed."""
    columns = columns or numeric_columns(df)
    fences = fit_fences(df, columns, multiplier, positive_spread)
    if not fences:
        return df.sparkSession.createDataFrame([], "column string, outliers bigint")

    def measures(c: str) -> list[Column]:
        low, high = fences[c]
        return [F.count_if((F.col(c) < low) | (F.col(c) > high)).alias("outliers")]

    return _per_column(df, list(fences), measures).where(F.col("outliers") > 0)


def data_profile(df: DataFrame) -> DataFrame:
    """Quality profile as (column, metric, value) rows; table-wide rows have no column."""
    numeric = numeric_columns(df)
    parts = [
        _long(missing_rates(df), ["missing_pct"]),
        _long(distinct_counts(df), ["distinct_values"]),
        duplicate_count(df).select(
            F.lit(None).cast("string").alias("column"),
            F.lit("duplicates").alias("metric"),
            F.col("duplicates").cast("double").alias("value"),
        ),
        df.agg(F.count("*").cast("double").alias("value")).select(
            F.lit(None).cast("string").alias("column"), F.lit("rows").alias("metric"), "value"
        ),
    ]
    if numeric:
        parts.append(_long(column_moments(df, numeric), ["mean", "std", "min", "max", "skewness"]))
        parts.append(_long(outlier_counts(df, numeric, positive_spread=True), ["outliers"]))
    return reduce(DataFrame.unionByName, parts)


def _long(rows: DataFrame, metrics: list[str]) -> DataFrame:
    cells = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    )
    return rows.select("column", F.explode(cells).alias("cell")).select("column", "cell.*")


def table_shape(df: DataFrame) -> DataFrame:
    """One row: rows, columns, numeric and categorical columns, mean missing rate."""
    rates = [F.coalesce(share(F.count_if(F.col(c).isNull()), F.count("*")), F.lit(0.0)) for c in df.columns]
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("n_numeric"),
        F.lit(len(string_columns(df))).cast("bigint").alias("n_categorical"),
        F.round(sum(rates, F.lit(0.0)) / len(df.columns), 4).alias("avg_missing_pct"),
    )


def data_traits(df: DataFrame, target: str) -> DataFrame:
    """Shape, duplicates and the task the target column implies, in one row."""
    has_duplicates = (duplicate_count(df).scalar() > 0).cast("int")
    if target in numeric_columns(df):
        classes = df.agg(F.count_distinct(target).alias("n")).scalar()
        task = (
            F.when(classes == 2, "binary_classification")
            .when(classes <= 20, "multiclass_classification")
            .otherwise("regression")
        )
    else:
        task = F.lit("classification")
    return table_shape(df).withColumns({"has_duplicates": has_duplicates, "task_type": task})


def worst_missing(df: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` columns with the highest missing rate above zero."""
    rates = missing_rates(df).where(F.col("missing_pct") > 0)
    return rates.orderBy(F.desc("missing_pct"), "column").limit(k)


def validation_warnings(df: DataFrame, target: str, max_missing: float = 0.5) -> DataFrame:
    """Soft checks as rows: absent target, columns mostly missing. Empty input raises."""
    if not df.columns or df.isEmpty():
        raise ValueError("the table has no columns or no rows to check")
    warnings = missing_rates(df).where(F.col("missing_pct") > max_missing).select(
        F.lit("mostly_missing").alias("warning"), "column"
    )
    if target and target not in df.columns:
        absent = df.sparkSession.createDataFrame(
            [("target_not_found", target)], "warning string, column string"
        )
        warnings = warnings.unionByName(absent)
    return warnings
