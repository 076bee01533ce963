"""Rolling summaries over time whose cost does not grow with the width of the window.

Time is cut into spans, ``pieces`` of them to a window's width. The window of a row is then the later part of one span,
the whole spans that follow, and the earlier part of the row's own span. Earlier and later parts are running summaries
of one sort each; whole spans are summarised once. Counts, sums, extremes and moments of the three parts combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from sondeo.workspace import null_safe_join

STATS = ("rows", "count", "sum", "avg", "min", "max", "std")
PARTS = ("_early", "_whole", "_late")


def _summary(value: Column, present: Column, over: WindowSpec | None, name: str) -> dict[str, Column]:
    """Rows, values, sum, squared deviations and extremes of the rows where ``present``."""
    seen = F.when(present, value)
    squares = F.var_pop(seen), F.count(seen)
    found = {"rows": F.count(F.when(present, 1)), "n": F.count(seen), "sum": F.sum(seen), "min": F.min(seen), "max": F.max(seen)}
    if over is not None:
        found = {k: c.over(over) for k, c in found.items()}
        squares = tuple(c.over(over) for c in squares)
    return {f"{name}_{k}": c for k, c in {**found, "off": squares[0] * squares[1]}.items()}


def _combined(stat: str, parts: tuple[str, ...]) -> Column:
    zero = F.lit(0)
    total = lambda k: sum((F.coalesce(F.col(f"{p}_{k}"), zero) for p in parts), zero)
    n = total("n")
    if stat == "rows":
        return total("rows")
    if stat == "count":
        return n
    if stat in ("min", "max"):
        columns = [F.col(f"{p}_{stat}") for p in parts]
        return columns[0] if len(parts) == 1 else (F.least if stat == "min" else F.greatest)(*columns)
    if stat == "sum":
        return F.when(n > 0, total("sum"))
    mean = total("sum") / F.nullif(n, zero)
    if stat == "avg":
        return mean
    # Squared deviations from the parts' own means, and of these means from the common one.
    around = sum(
        (
            F.coalesce(F.col(f"{p}_off") + F.col(f"{p}_n") * F.pow(F.col(f"{p}_sum") / F.nullif(F.col(f"{p}_n"), zero) - mean, F.lit(2)), F.lit(0.0))
            for p in parts
        ),
        F.lit(0.0),
    )
    return F.when(n > 1, F.sqrt(around / (n - 1)))


def rolling_summary(
    df: DataFrame, keys: list[str], time: Column, width: int, value: str | Column, stats: dict[str, str], pieces: int = 1
) -> DataFrame:
    """``df`` with one column per entry of ``stats``, as ``{"mean_7d": "avg"}``, over the trailing ``width`` time units.

    The window of a row is its key's rows from ``time - width`` to ``time``, both included, whatever their order in the
    table. ``time`` is a whole number. ``rows`` counts rows, ``count`` values; ``std`` is that of a sample, NULL for
    one value; without values ``sum``, ``avg``, ``min`` and ``max`` are NULL. NULL keys are one key. A row without a
    time is in no window and has NULL for each statistic.

    Every row is sent twice whatever the width. A task sorts the rows of a key in two spans, each ``width / pieces``
    long, so a hot key is cut by time; more pieces cut it finer, for one more join with a row per span.
    """
    if wrong := set(stats.values()) - set(STATS):
        raise ValueError(f"no such statistics: {sorted(wrong)}")
    column = F.col(value) if isinstance(value, str) else value
    timed = df.withColumns({"_t": time.cast("long"), "_v": column})
    known = timed.where(F.col("_t").isNotNull())
    span = F.expr(f"(_t * {pieces}L - pmod(_t * {pieces}L, {int(width)}L)) div {int(width)}L")
    known = known.withColumn("_span", span)
    # As context, a row goes to the span whose windows begin in its own one.
    sent = known.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False))))
    own = F.col("_own")
    sent = sent.withColumns(
        {"_span": F.when(own, F.col("_span")).otherwise(F.col("_span") + pieces), "_from": F.when(own, F.col("_t") - width).otherwise(F.col("_t"))}
    )
    here = W.partitionBy(*keys, "_span")
    early = here.orderBy("_t").rangeBetween(W.unboundedPreceding, W.currentRow)
    late = here.orderBy(F.desc("_from")).rangeBetween(W.unboundedPreceding, W.currentRow)
    parts = {**_summary(F.col("_v"), own, early, "_early"), **_summary(F.col("_v"), ~own, late, "_late")}
    found = sent.withColumns(parts).where(own)
    names = PARTS
    if pieces > 1:
        summed = known.groupBy(*keys, "_span").agg(*[c.alias(n) for n, c in _summary(F.col("_v"), F.lit(True), None, "_in").items()])
        between = W.partitionBy(*keys).orderBy("_span").rangeBetween(-(pieces - 1), -1)
        spans = summed.select(*keys, "_span", *[c.alias(n) for n, c in _over_spans(between).items()])
        found = null_safe_join(found, spans, [*keys, "_span"])
    else:
        names = ("_early", "_late")
    counted = found.select(*df.columns, *[_combined(s, names).alias(n) for n, s in stats.items()])
    types = {f.name: f.dataType for f in counted.schema}
    untimed = timed.where(F.col("_t").isNull()).select(*df.columns, *[F.lit(None).cast(types[n]).alias(n) for n in stats])
    return counted.unionByName(untimed)


def _over_spans(between: WindowSpec) -> dict[str, Column]:
    """The summary of whole spans, of the summaries of each."""
    n, total = F.sum("_in_n").over(between), F.sum("_in_sum").over(between)
    # Sum over spans of n * (mean - common mean)^2, without a second pass: the spread of weighted means.
    mean = F.col("_in_sum") / F.nullif(F.col("_in_n"), F.lit(0))
    parts = F.collect_list(F.when(F.col("_in_n") > 0, F.struct(F.col("_in_n").alias("n"), mean.alias("m")))).over(between)
    common = total / F.nullif(n, F.lit(0))
    apart = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["n"] * F.pow(x["m"] - common, F.lit(2)))
    return {
        "_whole_rows": F.sum("_in_rows").over(between), "_whole_n": n, "_whole_sum": total,
        "_whole_min": F.min("_in_min").over(between), "_whole_max": F.max("_in_max").over(between),
        "_whole_off": F.sum("_in_off").over(between) + apart,
    }
