"""Feature building and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondeo.operators import features, neighbours, ordering, selection
from sondeo.operators.quantiles import fit_quantiles
from sondeo.plans.catalog import query, table, union_sql
from sondeo.plans.inputs import DIRTY_ORDERS_SQL, dirty_orders
from sondeo.plans.queries_explore import RELATED_COLUMNS, RELATED_SQL, corr_sql, related


@query(
    """WITH codes AS (SELECT c_name AS v, row_number() OVER (ORDER BY c_name) - 1 AS code FROM (SELECT DISTINCT c_name FROM customer))
    SELECT c_custkey, code AS c_name FROM customer JOIN codes ON v = c_name"""
)
def label_encode(spark, folder):
    return features.label_encode(table(spark, folder, "customer").select("c_custkey", "c_name"), "c_name")


@query(
    f"""WITH {DIRTY_ORDERS_SQL}, keyed AS (SELECT o_orderkey, coalesce(o_orderpriority, 'nan') AS v FROM dirty),
      codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT v FROM keyed))
    SELECT o_orderkey, code AS o_orderpriority FROM keyed JOIN codes USING (v)"""
)
def label_encode_with_missing(spark, folder):
    df = dirty_orders(spark, folder).select("o_orderkey", "o_orderpriority")
    return features.label_encode(df, "o_orderpriority")


@query(
    """SELECT l_orderkey, l_linenumber, CASE l_linestatus WHEN 'F' THEN CAST(0 AS BIGINT) ELSE 1 END AS l_linestatus FROM lineitem"""
)
def binary_encode(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    return features.label_encode(df, "l_linestatus")


_SEGMENTS = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "SELECT c_custkey, "
    + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS c_mktsegment_{s}" for s in _SEGMENTS)
    + " FROM customer"
)
def one_hot(spark, folder):
    return features.one_hot(table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query(
    """WITH s AS (SELECT *, value * value * value AS cubed FROM events)
    SELECT event_id, cubed,
      CASE WHEN (SELECT abs(skewness(cubed)) > 2 AND min(cubed) >= 0 FROM s) THEN round(ln(1 + cubed), 4) END AS log_cubed FROM s"""
)
def log_skewed(spark, folder):
    value = F.col("value")
    df = table(spark, folder, "events").select("event_id", (value * value * value).alias("cubed"))
    logged = features.log_skewed(df, ["cubed"])
    if "log_cubed" not in logged.columns:
        logged = logged.withColumn("log_cubed", F.lit(None).cast("double"))
    return logged.select("event_id", "cubed", F.round("log_cubed", 4).alias("log_cubed"))


@query(
    f"""WITH {RELATED_SQL}
    SELECT l_orderkey, l_linenumber, l_extendedprice * net AS l_extendedprice_x_net,
      l_extendedprice * gappy AS l_extendedprice_x_gappy FROM related"""
)
def interaction(spark, folder):
    df = related(spark, folder)
    crossed = features.add_interactions(df, [("l_extendedprice", "net"), ("l_extendedprice", "gappy")])
    return crossed.select("l_orderkey", "l_linenumber", "l_extendedprice_x_net", "l_extendedprice_x_gappy")


@query(
    f"""WITH {DIRTY_ORDERS_SQL},
      codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM dirty))
    SELECT o_orderkey, code AS customer, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS o_orderstatus_O,
      CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS o_orderstatus_P, coalesce(o_totalprice, 0) AS o_totalprice,
      round(coalesce(ln(1 + o_totalprice), 0), 4) AS log_o_totalprice,
      coalesce(o_totalprice * o_orderkey, 0) AS o_totalprice_x_o_orderkey, o_orderpriority
    FROM dirty JOIN codes ON v = CAST(o_custkey AS VARCHAR)"""
)
def transform_features(spark, folder):
    df = dirty_orders(spark, folder).withColumn("customer", F.col("o_custkey").cast("string")).drop("o_custkey")
    built = features.transform(df, "o_orderpriority", [("o_totalprice", "o_orderkey")])
    return built.withColumn("log_o_totalprice", F.round("log_o_totalprice", 4))


@query(
    """SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) AS l_quantity, round((l_tax - tm) / ts, 6) AS l_tax, 0.0::DOUBLE AS constant
    FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, avg(l_tax) AS tm, stddev_pop(l_tax) AS ts FROM lineitem)"""
)
def standard_scale(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", F.lit(7.0).alias("constant"))
    scaled = features.standard_scale(df, ["l_quantity", "l_tax", "constant"])
    return scaled.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_tax", "constant")})


@query(
    """SELECT l_orderkey, l_linenumber, round((l_extendedprice - lo) / (hi - lo), 6) AS l_extendedprice FROM lineitem,
    (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)"""
)
def minmax_scale(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return features.minmax_scale(df, ["l_extendedprice"]).withColumn("l_extendedprice", F.round("l_extendedprice", 6))


def _mi_sql(feature: str, source: str, target: str) -> str:
    edges = "[" + ", ".join(f"{i / 10}" for i in range(1, 10)) + "]"
    bin_of = " + ".join(f"(CASE WHEN coalesce({feature}, 0) > edges[{i}] THEN 1 ELSE 0 END)" for i in range(1, 10))
    return f"""
    SELECT '{feature}' AS feature, greatest(sum(n / total * ln(n * total / (nb * nl))), 0) AS mi FROM (
      SELECT n, sum(n) OVER () AS total, sum(n) OVER (PARTITION BY bin) AS nb, sum(n) OVER (PARTITION BY label) AS nl FROM (
        SELECT bin, label, CAST(count(*) AS DOUBLE) AS n FROM (
          SELECT {bin_of} AS bin,
            coalesce(CAST({target} AS VARCHAR), 'nan') AS label FROM {source},
            (SELECT quantile_cont(coalesce({feature}, 0), {edges}) AS edges FROM {source})) GROUP BY bin, label))"""


@query(
    f"""WITH joined AS (SELECT l.quality, d.n_chars, d.doc_id FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
    m AS ({_mi_sql("n_chars", "joined", "quality")} UNION ALL {_mi_sql("doc_id", "joined", "quality")})
    SELECT feature, round(mi, 6) AS mi FROM m"""
)
def mutual_info(spark, folder):
    lengths = table(spark, folder, "documents").select("doc_id", "n_chars")
    joined = table(spark, folder, "labels").join(lengths, "doc_id")
    scores = selection.mutual_information(joined, ["n_chars", "doc_id"], "quality")
    return scores.withColumn("mi", F.round("mi", 6))


_SELECT_FEATURES = RELATED_COLUMNS
_SELECTION_SQL = f"""
{RELATED_SQL},
filled AS (SELECT {", ".join(f"coalesce({c}, 0) AS {c}" for c in _SELECT_FEATURES)}, banded AS band FROM
  (SELECT *, CASE WHEN l_extendedprice > 50000 THEN 'high' WHEN l_quantity > 25 THEN 'mid' ELSE 'low' END AS banded FROM related)),
m AS ({" UNION ALL ".join(_mi_sql(c, "filled", "band") for c in _SELECT_FEATURES)}),
pairs AS ({" UNION ALL ".join(corr_sql(a, b, "filled") for i, a in enumerate(_SELECT_FEATURES) for b in _SELECT_FEATURES[i + 1:])}),
lost AS (SELECT DISTINCT CASE WHEN b.mi < a.mi THEN col_b ELSE col_a END AS feature
  FROM pairs JOIN m a ON a.feature = col_a JOIN m b ON b.feature = col_b WHERE abs(correlation) > 0.95)
"""


def _banded(spark, folder):
    band = (
        F.when(F.col("l_extendedprice") > 50000, "high").when(F.col("l_quantity") > 25, "mid").otherwise("low")
    )
    return related(spark, folder).withColumn("band", band)


@query(f"WITH {_SELECTION_SQL} SELECT feature FROM lost")
def redundant_features(spark, folder):
    df = _banded(spark, folder)
    scores = selection.mutual_information(df, _SELECT_FEATURES, "band")
    return selection.redundant_features(df, _SELECT_FEATURES, scores)


@query(
    f"""WITH {_SELECTION_SQL}, ranked AS (SELECT feature, mi, row_number() OVER (ORDER BY mi DESC, feature) AS rank
      FROM m WHERE feature NOT IN (SELECT feature FROM lost))
    SELECT feature, round(mi, 4) AS mi, rank FROM ranked
    WHERE rank <= 50 AND (mi > 0.001 OR (SELECT max(mi) FROM ranked) <= 0.001 AND rank <= 10)"""
)
def select_features(spark, folder):
    return selection.select_features(_banded(spark, folder), "band", _SELECT_FEATURES)


def _neighbour_sql(names: list[str], source: str, target: str) -> str:
    """Nearest-neighbour information as tables; the last one is ``nm`` (feature, mi)."""
    k, rows = neighbours.NEIGHBOURS, f"SELECT coalesce(CAST({target} AS VARCHAR), 'nan') AS label, * FROM {source}"
    beside = " UNION ALL ".join(
        f"SELECT feature, label, v, need, n, abs({side}(v, {i}) OVER o - v) AS d, {side}(n, {i}) OVER o AS more FROM w WINDOW o AS (PARTITION BY feature, label ORDER BY v)"
        for side in ("lag", "lead") for i in range(1, k + 1)
    )
    return f"""
labelled AS ({rows}),
sizes AS (SELECT label, count(*) AS size FROM labelled GROUP BY label HAVING count(*) > 1),
w AS (SELECT feature, label, v, count(*) AS n, least({k}, any_value(size) - 1) AS need FROM (
  {union_sql("SELECT '{c}' AS feature, label, CAST(coalesce({c}, 0) AS DOUBLE) AS v FROM labelled", names)}) JOIN sizes USING (label) GROUP BY feature, label, v),
beside AS (SELECT feature, label, v, need, n, d, sum(more) AS more FROM ({beside}) WHERE d IS NOT NULL GROUP BY ALL),
reached AS (SELECT a.feature, a.label, a.v, a.d FROM beside a JOIN beside b ON a.feature = b.feature AND a.label = b.label AND a.v = b.v AND b.d <= a.d
  GROUP BY a.feature, a.label, a.v, a.d, a.n, a.need HAVING sum(b.more) + a.n - 1 >= a.need),
nearest AS (SELECT w.*, CASE WHEN n - 1 >= need THEN 0 ELSE (SELECT min(d) FROM reached r WHERE r.feature = w.feature AND r.label = w.label AND r.v = w.v) END AS r FROM w),
upto AS (SELECT feature, v, sum(n) AS here, sum(sum(n)) OVER (PARTITION BY feature ORDER BY v) AS upto FROM w GROUP BY feature, v),
within AS (SELECT q.feature, q.n, CAST(CASE WHEN r = 0 THEN n ELSE need END AS BIGINT) AS same,
    CAST(CASE WHEN r = 0 THEN e.here ELSE h.upto - coalesce(l.upto, 0) END AS BIGINT) AS m
  FROM nearest q JOIN upto e ON q.feature = e.feature AND q.v = e.v
  ASOF LEFT JOIN upto h ON q.feature = h.feature AND q.v + q.r > h.v
  ASOF LEFT JOIN upto l ON q.feature = l.feature AND q.v - q.r >= l.v),
psi AS (SELECT i, coalesce(sum(1.0::DOUBLE / i) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - {neighbours.EULER} AS p
  FROM range(1, (SELECT CAST(sum(size) AS BIGINT) + 1 FROM sizes)) t(i)),
of_labels AS (SELECT sum(size) AS total, sum(size * p) AS labels FROM sizes JOIN psi ON i = size),
near AS (SELECT feature, sum(n * a.p) AS near FROM within JOIN psi a ON a.i = same GROUP BY feature),
around AS (SELECT feature, sum(n * b.p) AS around FROM within JOIN psi b ON b.i = m GROUP BY feature),
nm AS (SELECT feature, greatest((SELECT p FROM psi WHERE i = (SELECT total FROM of_labels))
    + (near - around - (SELECT labels FROM of_labels)) / (SELECT total FROM of_labels), 0) AS mi FROM near JOIN around USING (feature))"""


_PRICED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(f"WITH {_neighbour_sql(_PRICED, 'lineitem', 'l_returnflag')} SELECT feature, round(mi, 6) AS mi FROM nm")
def neighbour_info(spark, folder):
    scores = neighbours.neighbour_information(table(spark, folder, "lineitem"), _PRICED, "l_returnflag")
    return scores.withColumn("mi", F.round("mi", 6))


_LENGTHS = ["n_chars", "doc_id", "pages"]


@query(
    f"""WITH joined AS (SELECT l.quality, d.n_chars, d.doc_id, d.n_chars // 400 AS pages FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
    {_neighbour_sql(_LENGTHS, "joined", "quality")},
    pairs AS ({" UNION ALL ".join(corr_sql(x, y, "joined") for i, x in enumerate(_LENGTHS) for y in _LENGTHS[i + 1:])}),
    lost AS (SELECT CASE WHEN y.mi < x.mi THEN col_b ELSE col_a END AS feature
      FROM pairs JOIN nm x ON x.feature = col_a JOIN nm y ON y.feature = col_b WHERE abs(correlation) > 0.95),
    ranked AS (SELECT feature, mi, row_number() OVER (ORDER BY mi DESC, feature) AS rank FROM nm WHERE feature NOT IN (SELECT feature FROM lost))
    SELECT feature, round(mi, 4) AS mi, rank FROM ranked WHERE mi > 0.001 OR (SELECT max(mi) FROM ranked) <= 0.001"""
)
def select_by_neighbours(spark, folder):
    pages = F.floor(F.col("n_chars") / 400).alias("pages")
    lengths = table(spark, folder, "documents").select("doc_id", "n_chars", pages)
    joined = table(spark, folder, "labels").join(lengths, "doc_id").select("quality", *_LENGTHS)
    return selection.select_features(joined, "quality", _LENGTHS, by_neighbours=True)


@query(
    f"""WITH {RELATED_SQL}, pairs AS ({" UNION ALL ".join(corr_sql(c, "l_extendedprice") for c in ("l_quantity", "net", "gappy", "constant"))})
    SELECT col_a AS feature, round(correlation, 4) AS correlation FROM pairs WHERE abs(correlation) > 0.95"""
)
def leakage_flags(spark, folder):
    return selection.leakage_flags(
        related(spark, folder), "l_extendedprice", ["l_quantity", "net", "gappy", "constant"]
    )


@query(
    """SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality
      ORDER BY ((doc_id % 2147483648) * 2654435761) % 4294967296, doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels"""
)
def fold_assign(spark, folder):
    df = table(spark, folder, "labels").select("doc_id", "quality")
    return ordering.assign_folds(df, "doc_id", "quality", order_hash=ordering.mixed_hash(F.col("doc_id")))


@query(
    """SELECT o_orderkey, CAST((row_number() OVER (
      ORDER BY ((o_orderkey % 2147483648) * 2654435761) % 4294967296, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders"""
)
def fold_assign_regression(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey")
    # Small spans on purpose: the split that a large table gets is used here too.
    return ordering.assign_folds(
        df, "o_orderkey", order_hash=ordering.mixed_hash(F.col("o_orderkey")), span_rows=1000
    )


@query(
    """SELECT o_orderpriority, fold, o_orderkey, round((ts - s) / (tn - n), 4) AS encoded FROM
    (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_orderpriority, fold) AS s, count(*) OVER (PARTITION BY o_orderpriority, fold) AS n,
       sum(o_totalprice) OVER (PARTITION BY o_orderpriority) AS ts, count(*) OVER (PARTITION BY o_orderpriority) AS tn
     FROM (SELECT o_orderkey, o_orderpriority, o_totalprice, CAST(((o_orderkey % 2147483648) * 2654435761) % 4294967296 % 5 AS INTEGER) AS fold FROM orders))"""
)
def target_encode_oof(spark, folder):
    fold = (ordering.mixed_hash(F.col("o_orderkey")) % 5).cast("int")
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", fold.alias("fold"))
    encoded = features.target_means_out_of_fold(df, "o_orderpriority", "o_totalprice", "fold", "encoded")
    return encoded.select("o_orderpriority", "fold", "o_orderkey", F.round("encoded", 4).alias("encoded"))


@query(
    """SELECT event_id, CAST(hour(ts) AS INTEGER) AS ts_hour, CAST(dayofweek(ts) + 1 AS INTEGER) AS ts_weekday, CAST(day(ts) AS INTEGER) AS ts_day,
      CAST(month(ts) AS INTEGER) AS ts_month, CAST(quarter(ts) AS INTEGER) AS ts_quarter FROM events"""
)
def calendar_parts(spark, folder):
    return features.calendar_parts(table(spark, folder, "events").select("event_id", "ts"), "ts").drop("ts")


@query(
    """SELECT event_id, round(percent_rank() OVER (ORDER BY value), 6) AS value_rank FROM events"""
)
def percent_rank(spark, folder):
    df = table(spark, folder, "events").select("event_id", "value")
    ranked = features.percent_rank(df, "value", "value_rank")
    return ranked.select("event_id", F.round("value_rank", 6).alias("value_rank"))


@query(
    """SELECT event_id, CASE WHEN value > edges[3] THEN 3 WHEN value > edges[2] THEN 2 WHEN value > edges[1] THEN 1 ELSE 0 END AS bin,
      value * value AS squared, round(sqrt(abs(value)), 4) AS root
      FROM events, (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS edges FROM events)"""
)
def quantile_bins(spark, folder):
    df = table(spark, folder, "events")
    edges = fit_quantiles(df, ["value"], [0.25, 0.5, 0.75])["value"]
    powers = features.add_roots(features.add_squares(df, ["value"]), ["value"])
    return powers.select(
        "event_id",
        features.quantile_bin(F.col("value"), edges).alias("bin"),
        F.col("value_squared").alias("squared"),
        F.round("value_root", 4).alias("root"),
    )


_MANY_LABELS = ["o_orderpriority", "o_orderstatus", "o_day", "o_clerk"]


@query(
    """WITH o AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS o_day,
        'clerk ' || (o_custkey % 97) AS o_clerk FROM orders)
    SELECT o_orderkey, """
    + ", ".join(f"dense_rank() OVER (ORDER BY coalesce({c}, 'nan')) - 1 AS {c}" for c in _MANY_LABELS)
    + " FROM o"
)
def encode_many(spark, folder):
    df = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderpriority", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_day"),
        F.concat(F.lit("clerk "), F.col("o_custkey") % 97).alias("o_clerk"),
    )
    return features.label_encode_all(df, {c: c for c in _MANY_LABELS})


@query(
    """WITH m AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp,
        corr(l_quantity, l_extendedprice) AS r FROM lineitem)
    SELECT component, round(share, 6) AS share FROM m, LATERAL (SELECT 1 AS component, (1 + abs(r)) / 2 AS share UNION ALL SELECT 2, (1 - abs(r)) / 2) s"""
)
def principal_components(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    _, shares = features.principal_components(df, ["l_quantity", "l_extendedprice"], 2)
    rows = [(i + 1, round(v, 6)) for i, v in enumerate(shares)]
    return spark.createDataFrame(rows, "component int, share double")
