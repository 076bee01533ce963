"""Cleaning steps, the rule that plans them, and a run that logs what each changed."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondeo.functions.moments import clip
from sondeo.functions.schema import numeric_columns, string_columns
from sondeo.operators.profile import duplicate_count, missing_rates, outlier_counts, top_values
from sondeo.operators.quantiles import fit_fences, fit_quantiles, quantile_rows
from sondeo.workspace import broadcast_if_small, cut_lineage

UNKNOWN = "Unknown"


def fit_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    return {c: q[0] for c, q in fit_quantiles(df, columns, [0.5]).items()}


def fit_modes(df: DataFrame, columns: list[str], default: str = UNKNOWN) -> dict[str, str]:
    """Most frequent value per column, the smallest on a tie; ``default`` if all NULL."""
    if not columns:
        return {}
    found = {r["column"]: r["value"] for r in top_values(df, columns, 1).collect()}
    return {c: found.get(c, default) for c in columns}


def fill_numbers(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """A filled column becomes double: a median need not be an integer."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in values.items()})


def fill_strings(df: DataFrame, values: dict[str, str]) -> DataFrame:
    return df.fillna(values) if values else df


def impute_median(df: DataFrame, columns: list[str] | None = None, exclude: Iterable[str] = ()) -> DataFrame:
    return fill_numbers(df, fit_medians(df, columns or numeric_columns(df, exclude)))


def impute_mode(df: DataFrame, columns: list[str] | None = None, exclude: Iterable[str] = ()) -> DataFrame:
    return fill_strings(df, fit_modes(df, columns or string_columns(df, exclude)))


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def cap(df: DataFrame, fences: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: clip(F.col(c).cast("double"), lo, hi) for c, (lo, hi) in fences.items()})


def cap_outliers(
    df: DataFrame, columns: list[str] | None = None, multiplier: float = 3.0, exclude: Iterable[str] = ()
) -> DataFrame:
    """Winsorise at ``multiplier`` IQRs; columns without spread are left alone."""
    return cap(df, fit_fences(df, columns or numeric_columns(df, exclude), multiplier))


def cleaning_plan(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """The ordered steps the quality profile of ``df`` calls for."""
    missing = {r["column"] for r in missing_rates(df).where(F.col("missing") > 0).collect()}
    steps = []
    if duplicate_count(df).first()["duplicates"] > 0:
        steps.append("drop_duplicates")
    if missing & set(numeric_columns(df, exclude)):
        steps.append("fill_numeric_missing")
    if missing & set(string_columns(df, exclude)):
        steps.append("fill_categorical_missing")
    numeric = numeric_columns(df, exclude)
    if numeric and not outlier_counts(df, numeric, positive_spread=True).isEmpty():
        steps.append("cap_outliers_iqr")
    return steps


def _rows_where_any(df: DataFrame, conditions: list) -> int:
    if not conditions:
        return 0
    return df.agg(F.count_if(reduce(lambda a, b: a | b, conditions))).first()[0]


def _apply(df: DataFrame, step: str, exclude: Iterable[str]) -> tuple[DataFrame, int]:
    """The frame after a step and the number of rows the step changed or removed."""
    if step == "drop_duplicates":
        # Every later step scans the result several times, so the shuffle is done once.
        before = df.count()
        out = cut_lineage(drop_duplicates(df))
        return out, before - out.count()
    if step == "fill_numeric_missing":
        medians = fit_medians(df, numeric_columns(df, exclude))
        return fill_numbers(df, medians), _rows_where_any(df, [F.col(c).isNull() for c in medians])
    if step == "fill_categorical_missing":
        modes = fit_modes(df, string_columns(df, exclude))
        return fill_strings(df, modes), _rows_where_any(df, [F.col(c).isNull() for c in modes])
    if step == "cap_outliers_iqr":
        fences = fit_fences(df, numeric_columns(df, exclude), 3.0)
        outside = [(F.col(c) < lo) | (F.col(c) > hi) for c, (lo, hi) in fences.items()]
        return cap(df, fences), _rows_where_any(df, outside)
    raise KeyError(step)


def clean(
    df: DataFrame, steps: list[str] | None = None, exclude: Iterable[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """The cleaned table and its change log (step, operation, rows_affected, status).

    A step that fails is logged and skipped. Keys and the target go in ``exclude``.
    """
    exclude = list(exclude)
    log = []
    for number, step in enumerate(cleaning_plan(df, exclude) if steps is None else steps, start=1):
        try:
            df, changed = _apply(df, step, exclude)
            log.append((number, step, changed, "applied"))
        except Exception as error:  # noqa: BLE001 - the log carries the reason
            log.append((number, step, 0, f"failed: {type(error).__name__}"))
    schema = "step int, operation string, rows_affected bigint, status string"
    return df, df.sparkSession.createDataFrame(log, schema)


def total_rows_affected(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.sum("rows_affected"), F.lit(0)).alias("total_rows_affected"))


def impute_group_median(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Median of the row's group; groups without values stay NULL."""

    medians = quantile_rows(df.dropna(subset=by), [column], [0.5], by).select(
        *by, F.get("quantiles", F.lit(0)).alias("_median")
    )
    return (
        df.join(broadcast_if_small(medians), by, "left")
        .withColumn(column, F.coalesce(F.col(column).cast("double"), F.col("_median")))
        .select(*df.columns)
    )


def zscore_outliers(df: DataFrame, columns: list[str], limit: float = 3.0) -> DataFrame:
    """Values further than ``limit`` sample deviations from the mean, counted per column.

    A column without spread has no row.
    """
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.avg(c).alias("m"), F.stddev_samp(c).alias("s"))
            for c in columns
        ]
    )
    fitted = {r["column"]: r for r in df.agg(F.explode(cells).alias("x")).select("x.*").collect()}
    counts = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(F.abs(F.col(c) - r["m"]) > F.lit(limit) * r["s"]).alias("outliers"),
            )
            for c, r in fitted.items()
            if r["s"]
        ]
    ) if any(r["s"] for r in fitted.values()) else None
    if counts is None:
        return df.sparkSession.createDataFrame([], "column string, outliers long")
    return df.agg(F.explode(counts).alias("x")).select("x.*")


def parsed_date(text, formats: list[str]):
    """First format that parses, as ISO date; NULL when none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("date")


def parsed_number(text):
    """The first decimal number inside a text."""
    return F.regexp_extract(text, r"([-+]?\d+(?:\.\d+)?)", 1).try_cast("double")


def canonical_categories(df: DataFrame, column: str, canon: list[str], threshold: float = 0.85) -> DataFrame:
    """Adds ``<column>_canonical``: the closest name of a short list, if close enough.

    Similarity is ``1 - edit distance / longer length``, ties to the earlier name. The
    list is a literal, so each row is matched in place.
    """
    text = F.lower(F.trim(F.col(column)))

    def scored(i: int, name: str):
        longest = F.greatest(F.length(text), F.lit(len(name)))
        ratio = F.lit(1.0) - F.levenshtein(text, F.lit(name.lower())) / longest
        return F.struct(ratio.alias("ratio"), F.lit(-i).alias("rank"), F.lit(name).alias("name"))

    best = F.array_max(F.array(*[scored(i, n) for i, n in enumerate(canon)]))
    mapped = F.when(best["ratio"] >= threshold, best["name"]).otherwise(F.col(column))
    return df.withColumn(f"{column}_canonical", mapped)


def _keyed(text: str) -> Column:
    return F.lower(F.trim(F.col(text)))


def _segments(df: DataFrame, allowed: float) -> DataFrame:
    """Adds, for texts of ``_length``, the ``_errors`` they bear and a row for each of their ``_errors`` + 1 segments."""
    parts, i = F.col("_errors") + 1, F.col("_i")
    return (
        df.withColumn("_errors", F.floor(F.col("_length") * F.lit(allowed) + F.lit(1e-9)).cast("int"))
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_errors"))))
        .withColumn("_start", F.floor(i * F.col("_length") / parts).cast("int"))
        .withColumn("_size", F.floor((i + 1) * F.col("_length") / parts).cast("int") - F.col("_start"))
    )


def canonical_from_table(df: DataFrame, column: str, names: DataFrame, name: str, threshold: float = 0.85) -> DataFrame:
    """Adds ``<column>_canonical``: the closest name of a table, if close enough, else the value itself.

    Similarity is ``1 - edit distance / longer length`` of the trimmed lower-case texts, ties to the smallest name.
    ``threshold`` is over 0.5. NULL stays NULL; NULL and blank names match nothing.

    A name that bears k errors is cut into k + 1 segments, of which a value within k errors has one unchanged and
    little moved. Names and distinct values meet by such segments, so only values that share one are compared. The
    segments of a value grow with the cube of its length: this is for names, not for texts.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("threshold must be over 0.5 and at most 1")
    allowed = (1 - threshold) / threshold
    known = names.select(F.col(name).alias("_name"), _keyed(name).alias("_text")).where(F.length("_text") > 0).distinct()
    known = _segments(known.withColumn("_length", F.length("_text")), allowed)
    known = known.select("_name", F.col("_text").alias("_key"), "_length", "_i", F.expr("substring(_text, _start + 1, _size)").alias("_segment"))
    values = df.select(_keyed(column).alias("_value")).where(F.length("_value") > 0).distinct()
    size = F.length("_value")
    shortest, longest = F.ceil(size * F.lit(threshold) - F.lit(1e-9)), F.floor(size / F.lit(threshold) + F.lit(1e-9))
    lengths = F.sequence(F.greatest(shortest.cast("int"), F.lit(1)), longest.cast("int"))
    tried = _segments(values.withColumn("_length", F.explode(lengths)), allowed)
    # Before segment i there are at most i errors, after it at most the others: both ends bound how far it has moved.
    left, right, more = F.col("_i"), F.col("_errors") - F.col("_i"), size - F.col("_length")
    first = F.greatest(F.lit(0), F.col("_start") - left, F.col("_start") + more - right)
    last = F.least(size - F.col("_size"), F.col("_start") + left, F.col("_start") + more + right)
    tried = tried.withColumn("_at", F.explode(F.when(first <= last, F.sequence(first, last))))
    tried = tried.select("_value", "_length", "_i", F.expr("substring(_value, _at + 1, _size)").alias("_segment"))
    ratio = F.lit(1.0) - F.levenshtein("_value", "_key") / F.greatest(F.length("_value"), F.length("_key"))
    near = tried.join(known, ["_length", "_i", "_segment"]).select("_value", "_name", ratio.alias("_ratio"))
    best = near.where(F.col("_ratio") >= threshold).groupBy("_value").agg(F.min(F.struct(-F.col("_ratio"), "_name")).alias("_best"))
    found = broadcast_if_small(best.select("_value", F.col("_best._name").alias("_found")))
    joined = df.withColumn("_asked", _keyed(column)).join(found, F.col("_asked") == F.col("_value"), "left")
    return joined.withColumn(f"{column}_canonical", F.coalesce("_found", column)).drop("_asked", "_value", "_found")


def mask_columns(df: DataFrame, columns: list[str], keep: int = 4) -> DataFrame:
    """All but the last ``keep`` characters as ``*``; shorter values are masked whole."""
    masked = {}
    for c in columns:
        text = F.col(c).cast("string")
        size = F.char_length(text)
        shown = F.when(size > keep, F.right(text, F.lit(keep))).otherwise(F.lit(""))
        masked[c] = F.concat(F.repeat(F.lit("*"), size - F.char_length(shown)), shown)
    return df.withColumns(masked)


def hash_columns(df: DataFrame, columns: list[str], salt: str = "") -> DataFrame:
    """SHA-256 of salt and value in hex, so that equal values stay equal; NULL stays NULL."""
    return df.withColumns({c: F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256) for c in columns})
