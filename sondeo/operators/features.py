"""Feature building: encoding, scaling, derived columns and their lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeo.functions.schema import numeric_columns, string_columns
from sondeo.operators.ordering import ordered_codes, running_total
from sondeo.operators.profile import centred_moments, distinct_counts
from sondeo.workspace import aggregate_wide, broadcast_if_small

ONE_HOT_MOST = 10
MISSING_CATEGORY = "nan"


def encoding_plan(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Column -> ``label`` (2 or many values) or ``onehot`` (at most ten)."""
    counts = {r["column"]: r["distinct_values"] for r in distinct_counts(df, columns).collect()}
    return {
        c: "label" if counts[c] == 2 or counts[c] > ONE_HOT_MOST else "onehot" for c in columns
    }


def _category(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING_CATEGORY))


def label_encode(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """Codes 0.. in lexical order; NULL counts as the category ``nan``."""
    return label_encode_all(df, {column: output or column})


def label_encode_all(df: DataFrame, outputs: dict[str, str]) -> DataFrame:
    """Lexical codes of several columns (column -> output): one join a column, whatever their number.

    The codes of every column come from the input frame, not from a frame that already holds joins.
    """
    names = [*df.columns, *[o for o in outputs.values() if o not in df.columns]]
    keyed = df.withColumns({f"_category_{i}": _category(c) for i, c in enumerate(outputs)})
    for i, column in enumerate(outputs):
        values = df.select(_category(column).alias(f"_category_{i}"))
        codes = ordered_codes(values, f"_category_{i}").withColumnRenamed("code", f"_code_{i}")
        keyed = keyed.join(broadcast_if_small(codes), f"_category_{i}")
    code_of = {output: f"_code_{i}" for i, output in enumerate(outputs.values())}
    return keyed.select(*[F.col(code_of.get(n, n)).alias(n) for n in names])


def one_hot(df: DataFrame, column: str) -> DataFrame:
    """0/1 columns ``<column>_<value>`` for all sorted values but the first.

    Meant for a few values: they are listed on the driver to name the columns.
    """
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(ONE_HOT_MOST + 1).collect()
    if len(rows) > ONE_HOT_MOST:
        raise ValueError(f"{column} has more than {ONE_HOT_MOST} values; use label_encode")
    values = sorted(r[0] for r in rows)
    flags = {f"{column}_{v}": F.when(F.col(column) == v, 1).otherwise(0) for v in values[1:]}
    return df.withColumns(flags).drop(column)


def encode(df: DataFrame, target: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Encode every string column but the target and the keys by its cardinality."""
    columns = string_columns(df, [*keys, *([target] if target else [])])
    return _encoded(df, encoding_plan(df, columns))[0] if columns else df


def _encoded(df: DataFrame, plan: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """The encoded frame, and the column that each new feature comes from."""
    labels = [c for c, how in plan.items() if how == "label"]
    df = label_encode_all(df, {c: c for c in labels}) if labels else df
    made = {c: c for c in labels}
    for column in [c for c, how in plan.items() if how != "label"]:
        before = set(df.columns)
        df = one_hot(df, column)
        made |= {c: column for c in df.columns if c not in before}
    return df, made


def skewed_columns(df: DataFrame, columns: list[str], limit: float = 2.0) -> list[str]:
    """Columns without negative values whose skewness passes the limit either way."""
    if not columns:
        return []
    shapes = centred_moments(df, columns)
    kept = shapes.where((F.abs("skewness") > limit) & (F.col("min") >= 0)).collect()
    found = {r["column"] for r in kept}
    return [c for c in columns if c in found]


def add_logs(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"log_{c}": F.log1p(F.col(c)) for c in columns}) if columns else df


def add_squares(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_squared": F.col(c) * F.col(c) for c in columns})


def add_roots(df: DataFrame, columns: list[str]) -> DataFrame:
    """Square roots of the magnitudes."""
    return df.withColumns({f"{c}_root": F.sqrt(F.abs(c)) for c in columns})


def log_skewed(df: DataFrame, columns: list[str], limit: float = 2.0) -> DataFrame:
    return add_logs(df, skewed_columns(df, columns, limit))


def add_interactions(df: DataFrame, pairs: list[tuple[str, str]], most: int = 3) -> DataFrame:
    """Products ``<a>_x_<b>`` of the first ``most`` pairs whose columns are numeric."""
    numeric = set(numeric_columns(df))
    products = {
        f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs[:most] if a in numeric and b in numeric
    }
    return df.withColumns(products) if products else df


def transform(df: DataFrame, target: str, pairs: Sequence[tuple[str, str]] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Encode, add logs of skewed columns, add interactions, then fill gaps with 0; keys stay as they are."""
    return transform_with_origins(df, target, pairs, keys)[0]


def transform_with_origins(
    df: DataFrame, target: str, pairs: Sequence[tuple[str, str]] = (), keys: Sequence[str] = ()
) -> tuple[DataFrame, dict[str, str]]:
    """:func:`transform`, and for each feature where it comes from, noted as it is made."""
    kept = [target, *keys]
    origins = {c: f"original:{c}" for c in numeric_columns(df, kept)}
    plan = encoding_plan(df, string_columns(df, kept)) if string_columns(df, kept) else {}
    encoded, made = _encoded(df, plan)
    origins |= {f: f"encoded:{c}" for f, c in made.items()}
    skewed = skewed_columns(encoded, numeric_columns(encoded, kept))
    logged = add_logs(encoded, skewed)
    origins |= {f"log_{c}": f"log_transform:{c}" for c in skewed}
    combined = add_interactions(logged, list(pairs))
    origins |= {f"{a}_x_{b}": f"interaction:{a}*{b}" for a, b in pairs if f"{a}_x_{b}" in combined.columns}
    return combined.fillna(0, subset=numeric_columns(combined, kept)), origins


def lineage(spark: SparkSession, origins: dict[str, str], selected: Sequence[str] | None = None) -> DataFrame:
    """(feature, origin) rows of the features, or of the selected ones."""
    rows = [(f, o) for f, o in origins.items() if selected is None or f in selected]
    return spark.createDataFrame(rows, "feature string, origin string")


def fit_scaling(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column (NULL counts as 0); no spread scales by 1."""
    measures = {}
    for c in columns:
        filled = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        measures.update({("mean", c): F.avg(filled), ("spread", c): F.stddev_pop(filled)})
    found = aggregate_wide(df, measures)
    return {c: (found["mean", c] or 0.0, found["spread", c] or 1.0) for c in columns}


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    fitted = fit_scaling(df, columns)
    return df.withColumns(
        {c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - m) / s for c, (m, s) in fitted.items()}
    )


def minmax_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    measures = {}
    for c in columns:
        value = F.col(c).cast("double")
        measures.update({("low", c): F.min(value), ("high", c): F.max(value)})
    found = aggregate_wide(df, measures)
    scaled = {}
    for c in columns:
        low, high = F.lit(found["low", c]), F.lit(found["high", c])
        scaled[c] = F.try_divide(F.col(c) - low, high - low)
    return df.withColumns(scaled)


def target_means_out_of_fold(df: DataFrame, category: str, target: str, fold: str, output: str) -> DataFrame:
    """Mean target of the category over the other folds; NULL if there is none.

    Sums per (category, fold) are small next to the rows; totals come from them.
    """
    per_fold = df.groupBy(category, fold).agg(
        F.sum(F.col(target).cast("double")).alias("_s"), F.count(target).alias("_n")
    )
    totals = per_fold.groupBy(category).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    means = per_fold.join(totals, category).select(
        category,
        fold,
        F.try_divide(
            F.col("_ts") - F.coalesce("_s", F.lit(0.0)), (F.col("_tn") - F.col("_n")).cast("double")
        ).alias(output),
    )
    return df.join(broadcast_if_small(means), [category, fold], "left")


def calendar_parts(df: DataFrame, column: str) -> DataFrame:
    parts = {"hour": F.hour, "weekday": F.dayofweek, "day": F.day, "month": F.month, "quarter": F.quarter}
    return df.withColumns({f"{column}_{name}": part(column) for name, part in parts.items()})


def quantile_bin(value: Column, edges: list[float]) -> Column:
    """Number of edges below the value; equal values share a bin, NULL has none."""
    code = F.when(value.isNull(), None)
    cuts = sorted(set(edges))
    for i, edge in enumerate(cuts):
        code = code.when(value <= edge, i)
    return code.otherwise(len(cuts))


def percent_rank(df: DataFrame, column: str, output: str) -> DataFrame:
    """Share of rows with a smaller value, over non-NULL values.

    Ranked on value counts, so ties are one row and no window spans the table.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("t")).scalar()
    ranked = running_total(counts, column, {"_below": "_n"}).select(
        column, F.try_divide(F.col("_below").cast("double"), (total - 1).cast("double")).alias(output)
    )
    return df.join(broadcast_if_small(ranked), column, "left")


def principal_components(df: DataFrame, columns: list[str], k: int) -> tuple[DataFrame, list[float]]:
    """Scores ``pc_1`` to ``pc_<k>`` on the scaled columns (gaps as 0), and the share of variance of each."""
    scaled = standard_scale(df, columns).withColumnsRenamed({c: f"_z_{c}" for c in columns})
    rows = scaled.select("*", array_to_vector(F.array(*[F.col(f"_z_{c}") for c in columns])).alias("_z"))
    model = PCA(k=k, inputCol="_z", outputCol="_pc").fit(rows)
    scores = vector_to_array("_pc")
    kept = [c for c in df.columns if c not in columns]
    scored = model.transform(rows).select(*kept, *[F.get(scores, F.lit(i)).alias(f"pc_{i + 1}") for i in range(k)])
    return scored, model.explainedVariance.toArray().tolist()


def clustered(df: DataFrame, columns: list[str], k: int, seed: int = 42, name: str = "cluster") -> DataFrame:
    """The k-means cluster of each row on the scaled columns (gaps as 0)."""
    scaled = standard_scale(df, columns).select("*", array_to_vector(F.array(*columns)).alias("_z"))
    model = KMeans(k=k, seed=seed, featuresCol="_z", predictionCol=name).fit(scaled)
    return model.transform(scaled).drop("_z", *columns)
