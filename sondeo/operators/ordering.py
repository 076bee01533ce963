"""Order-dependent operators that do not gather a whole key in one task.

A window over one key sorts all its rows together, and a hot key may hold a third of
the table. Top-k windows are safe: Spark limits each group before the shuffle. The
others here split a key's rows into consecutive spans (hash range, or time span), work
per (key, span), and carry only one summary row per span across span borders.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondeo.workspace import broadcast_if_small, cut_lineage, null_safe_join

ROWS_PER_SPAN = 500_000


def _columns(order: list[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def top_k_per_key(df: DataFrame, keys: list[str], order: list[str | Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key; each task keeps at most ``k`` before the shuffle."""
    window = W.partitionBy(*keys).orderBy(*_columns(order))
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= k).drop("_rank")


def latest_per_key(
    df: DataFrame, keys: list[str], order: str, tie: list[str] | None = None, skip_null: bool = False
) -> DataFrame:
    """The newest row per key, or with ``skip_null`` each column's newest non-NULL value."""
    if not skip_null:
        return top_k_per_key(df, keys, [F.desc(order), *(tie or [])], 1)
    values = [c for c in df.columns if c not in keys and c != order]
    # Equal times are settled by the larger value.
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(c) for c in values]
    return df.groupBy(*keys).agg(F.max(order).alias(order), *newest)


def first_per_key(df: DataFrame, keys: list[str], ordinal: str, limit: int | None = None) -> DataFrame:
    """First occurrence per key in input order, optionally only the first ``limit`` keys."""
    first = top_k_per_key(df, keys, [ordinal], 1)
    return first if limit is None else first.orderBy(ordinal).limit(limit)


def _span_offsets(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key that lie in earlier spans, per (key, span)."""
    earlier = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    return (
        spans.groupBy(*keys, "_span")
        .agg(F.count("*").alias("_size"))
        .select(*keys, "_span", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    )


def running_number(
    df: DataFrame, keys: list[str], order: list[str | Column], name: str, span: Column | None = None
) -> DataFrame:
    """Consecutive numbers 1..n per key.

    ``span`` must not decrease along ``order`` (such as the day of an ordering
    timestamp). Each span is numbered on its own and shifted by the rows before it. NULL
    keys are one key and NULL spans the first one, as they are without spans.
    """
    if span is None:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*_columns(order))))
    spanned = df.withColumn("_span", span)
    offsets = _span_offsets(spanned, keys)
    window = W.partitionBy(*keys, "_span").orderBy(*_columns(order))
    return (
        null_safe_join(spanned, offsets, [*keys, "_span"])
        .withColumn(name, F.row_number().over(window) + F.col("_offset"))
        .select(*df.columns, name)
    )


def mixed_hash(key: Column) -> Column:
    """Multiplicative hash of an integer key in [0, 2^32); plain arithmetic, no overflow."""
    return F.pmod(F.pmod(key, F.lit(1 << 31)) * F.lit(2654435761), F.lit(1 << 32))


def assign_folds(
    df: DataFrame,
    key: str,
    label: str | None = None,
    folds: int = 5,
    order_hash: Column | None = None,
    name: str = "fold",
    span_rows: int = ROWS_PER_SPAN,
) -> DataFrame:
    """Shuffled folds whose sizes differ by at most one row within each class.

    Rows are dealt out in hash order per class. ``order_hash`` lies in [0, 2^32) and
    defaults to a hash of the key; equal hashes are ordered by the key. A class is cut
    into hash ranges, so a class with most of the rows is still spread over tasks.
    """
    keys = ["_class"]
    hashed = df.withColumns(
        {
            "_class": F.lit(0) if label is None else F.coalesce(F.col(label).cast("string"), F.lit("")),
            "_hash": F.pmod(F.xxhash64(key, F.lit(42)), F.lit(1 << 32)) if order_hash is None else order_hash,
        }
    )
    spans = df.count() // span_rows + 1
    order = [F.col("_hash"), F.col(key)]
    span = F.floor(F.col("_hash") * spans / float(1 << 32)) if spans > 1 else None
    numbered = running_number(hashed, keys, order, "_n", span)
    return numbered.withColumn(name, ((F.col("_n") - 1) % folds).cast("int")).select(*df.columns, name)


def ordered_codes(values: DataFrame, column: str, limit: int = ROWS_PER_SPAN) -> DataFrame:
    """(column, code) with codes 0.. in ascending order of the distinct values.

    Above ``limit`` values the sorted list is written once, and each of its partitions
    is shifted by the sizes of the partitions before it.
    """
    distinct = values.select(column).distinct()
    if distinct.count() <= limit:
        code = F.row_number().over(W.orderBy(column)) - 1
        return distinct.withColumn("code", code.cast("bigint"))
    bits = 33
    ranged = cut_lineage(
        distinct.orderBy(column).withColumn("_position", F.monotonically_increasing_id())
    ).select(
        column,
        F.shiftright("_position", bits).alias("_span"),
        F.col("_position").bitwiseAND(F.lit((1 << bits) - 1)).alias("_within"),
    )
    earlier = W.orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    # One row per partition of the sorted list.
    offsets = (
        ranged.groupBy("_span")
        .agg(F.count("*").alias("_size"))
        .select("_span", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    )
    return ranged.join(F.broadcast(offsets), "_span").select(
        column, (F.col("_offset") + F.col("_within")).alias("code")
    )


def permuted(df: DataFrame, columns: list[str], key: str, prefix: str, seed: int = 42) -> DataFrame:
    """Adds ``<prefix><column>`` holding the values of another, randomly chosen row.

    Rows are dealt into equal hash ranges and each range is rotated by one row in hash
    order: a permutation of the table that needs one shuffle for all columns.
    """
    spans = df.count() // 10_000 + 1
    draw = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 32))
    ordered = W.partitionBy("_span").orderBy("_hash", key)
    cycle = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    values = F.struct(*columns)
    donor = F.coalesce(F.lead(values).over(ordered), F.first(values).over(cycle))
    return (
        df.withColumns({"_hash": draw, "_span": F.floor(draw * spans / float(1 << 32))})
        .withColumn("_donor", donor)
        .select(*df.columns, *[F.col("_donor")[c].alias(f"{prefix}{c}") for c in columns])
    )


def forward_filled(
    df: DataFrame, keys: list[str], order: str, columns: list[str], span: Column, tie: list[str] | None = None
) -> DataFrame:
    """NULLs take the last earlier non-NULL value of the key.

    Only the last value of each (key, span) crosses span borders. NULL keys are one key;
    rows with a NULL order come first, in the order of ``tie``.
    """
    spanned = df.withColumn("_span", span)
    rank = F.struct(order, *(tie or []))
    tails = spanned.groupBy(*keys, "_span").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns]
    )
    before = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    carried = tails.select(
        *keys, "_span", *[F.last(c, ignorenulls=True).over(before).alias(f"_carry_{c}") for c in columns]
    )
    upto = (
        W.partitionBy(*keys, "_span")
        .orderBy(order, *(tie or []))
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    filled = {
        c: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"_carry_{c}")) for c in columns
    }
    return null_safe_join(spanned, carried, [*keys, "_span"]).withColumns(filled).select(*df.columns)


def time_since_previous(
    df: DataFrame, keys: list[str], time: Column, span: Column, name: str, tie: list[str] | None = None
) -> DataFrame:
    """Time units since the key's row before; NULL for its first row and where a time is NULL.

    Only the last time of each (key, span) crosses span borders.
    """
    spanned = df.withColumns({"_span": span, "_t": time})
    before = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        spanned.groupBy(*keys, "_span")
        .agg(F.max("_t").alias("_last"))
        .select(*keys, "_span", F.max("_last").over(before).alias("_carried"))
    )
    within = W.partitionBy(*keys, "_span").orderBy("_t", *(tie or []))
    previous = F.coalesce(F.lag("_t").over(within), F.col("_carried"))
    return (
        null_safe_join(spanned, carried, [*keys, "_span"])
        .withColumn(name, F.col("_t") - previous)
        .select(*df.columns, name)
    )


def sampled_keys(df: DataFrame, key: str, k: int = 10, seed: int = 42) -> DataFrame:
    """At most ``k`` distinct non-NULL keys, the first by a seeded hash."""
    distinct = df.where(F.col(key).isNotNull()).select(key).distinct()
    return distinct.orderBy(mixed_hash(F.col(key) + seed), key).limit(k)


def lagged(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    column: str,
    offsets: list[int],
    span: Column,
    row_id: str,
) -> DataFrame:
    """``<column>_lag_<k>`` for each offset, by position within the key.

    Every row sends its value to the positions that look back at it; one grouping on
    (key, position) then builds all lags, and no position is hot.
    """
    numbered = running_number(df, keys, order, "_position", span)
    sends = F.explode(
        F.array(*[F.struct(F.lit(k).alias("_k"), (F.col("_position") + k).alias("_to")) for k in [0, *offsets]])
    )
    sent = numbered.select(*keys, row_id, column, sends.alias("_s")).select(*keys, row_id, column, "_s.*")
    own = F.col("_k") == 0
    return (
        sent.groupBy(*keys, "_to")
        .agg(
            F.max(own).alias("_own"),
            F.max(F.when(own, F.col(row_id))).alias(row_id),
            F.max(F.when(own, F.col(column))).alias(column),
            *[F.max(F.when(F.col("_k") == k, F.col(column))).alias(f"{column}_lag_{k}") for k in offsets],
        )
        .where("_own")
        .drop("_to", "_own")
    )


def rolling_by_time(
    df: DataFrame, keys: list[str], time: Column, width: int, measures: dict[str, Column], pieces: int = 1
) -> DataFrame:
    """Aggregates over the trailing ``width`` time units, current row and its peers included.

    Rows are cut into spans of ``width / pieces``. Each row is also sent as context to
    the following ``pieces`` spans, which is as far as any window looks back.
    """
    spread = (
        df.withColumn("_t", time)
        .withColumn("_copy", F.explode(F.array(*[F.lit(i) for i in range(pieces + 1)])))
        .withColumn("_span", F.floor(F.col("_t") * pieces / width) + F.col("_copy"))
    )
    window = W.partitionBy(*keys, "_span").orderBy("_t").rangeBetween(-width, 0)
    return (
        spread.withColumns({name: measure.over(window) for name, measure in measures.items()})
        .where(F.col("_copy") == 0)
        .drop("_t", "_copy", "_span")
    )


def running_total(
    df: DataFrame,
    order: str,
    totals: dict[str, str],
    by: list[str] | None = None,
    span_rows: int = ROWS_PER_SPAN,
) -> DataFrame:
    """Sums over all rows before the current one; ``order`` is numeric and unique per group.

    A large table is split at approximate quantiles of ``order``: spans are summed on
    their own and shifted by the spans before them, so no task holds the whole order.
    """
    by = by or []
    spans = df.count() // span_rows + 1
    everything = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = (W.unboundedPreceding, -1)
    if spans == 1:
        window = everything.orderBy(order).rowsBetween(*before)
        return df.withColumns({n: F.coalesce(F.sum(c).over(window), F.lit(0)) for n, c in totals.items()})
    cuts = df.approxQuantile(order, [i / spans for i in range(1, spans)], 0.25 / spans)
    edges = [float("-inf"), *sorted(set(cuts)), float("inf")]
    cut = Bucketizer(splits=edges, inputCol=order, outputCol="_span", handleInvalid="keep").transform(df)
    cut = cut.withColumn("_span", F.when(F.col(order).isNull(), F.lit(-1.0)).otherwise(F.col("_span")))
    sums = cut.groupBy(*by, "_span").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in totals.items()])
    earlier = everything.orderBy("_span").rowsBetween(*before)
    offsets = sums.select(
        *by,
        "_span",
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in totals],
    )
    within = W.partitionBy(*by, "_span").orderBy(order).rowsBetween(*before)
    return (
        null_safe_join(cut, broadcast_if_small(offsets), [*by, "_span"])
        .withColumns(
            {n: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_o_{n}") for n, c in totals.items()}
        )
        .select(*df.columns, *totals)
    )
