"""Metric and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondeo.operators import attribution, clean, gates, metrics, models
from sondeo.operators.ordering import mixed_hash
from sondeo.plans import analysis
from sondeo.plans.catalog import query, table
from sondeo.plans.inputs import SCORED_SQL, dirty_orders, scored_labels
from sondeo.plans.queries_clean import _LOG_SQL

_REPORT_SQL = f"""
{SCORED_SQL},
classes AS (SELECT DISTINCT quality AS class FROM scored UNION SELECT DISTINCT prediction FROM scored),
c AS (SELECT class, (SELECT count(*) FROM scored WHERE quality = class) AS support,
    (SELECT count(*) FROM scored WHERE prediction = class) AS predicted,
    (SELECT count(*) FROM scored WHERE quality = class AND prediction = class) AS hits FROM classes),
report AS (SELECT class, support, hits, CASE WHEN predicted = 0 THEN 0 ELSE hits::DOUBLE / predicted END AS precision,
    CASE WHEN support = 0 THEN 0 ELSE hits::DOUBLE / support END AS recall FROM c),
full_report AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM report)
"""


@query(
    f"""WITH {_REPORT_SQL} SELECT l.class AS label, p.class AS prediction,
      (SELECT count(*) FROM scored WHERE quality = l.class AND prediction = p.class) AS n FROM classes l, classes p"""
)
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(scored_labels(spark, folder), "quality", "prediction")


@query(
    f"""WITH {_REPORT_SQL} SELECT class, support, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM full_report"""
)
def class_report(spark, folder):
    report = metrics.class_report(scored_labels(spark, folder), "quality", "prediction")
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    f"""WITH {_REPORT_SQL} SELECT round(sum(hits)::DOUBLE / sum(support), 4) AS accuracy,
      round(sum(precision * support) / sum(support), 4) AS precision, round(sum(recall * support) / sum(support), 4) AS recall,
      round(sum(f1 * support) / sum(support), 4) AS f1 FROM full_report"""
)
def class_metrics(spark, folder):
    return metrics.classification_metrics(scored_labels(spark, folder), "quality", "prediction")


def _auc_sql(source: str, score: str, positive: str) -> str:
    return f"""(SELECT (sum(CASE WHEN y = 1 THEN r END) - p * (p + 1) / 2.0) / (p * n) FROM
      (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r,
        CAST(sum(y) OVER () AS DOUBLE) AS p, CAST(sum(1 - y) OVER () AS DOUBLE) AS n
       FROM (SELECT {score} AS s, CASE WHEN {positive} THEN 1 ELSE 0 END AS y FROM {source})) GROUP BY p, n)"""


@query(
    f"""WITH {SCORED_SQL} SELECT round({_auc_sql("scored", "score", "quality = 1")}, 6) AS roc_auc,
      count(*) FILTER (WHERE quality = 1) AS positives FROM scored"""
)
def roc_auc(spark, folder):
    area = metrics.roc_auc(scored_labels(spark, folder), "score", F.col("quality") == 1)
    return area.withColumn("roc_auc", F.round("roc_auc", 6))


_FLAG_SCORES = {"A": "l_discount", "N": "l_tax", "R": "l_quantity / 50"}


@query(
    "SELECT round(sum(w * a) / sum(w), 6) AS roc_auc FROM ("
    + " UNION ALL ".join(
        f"SELECT count(*) FILTER (WHERE l_returnflag = '{c}') AS w, {_auc_sql('lineitem', s, f'l_returnflag = {chr(39)}{c}{chr(39)}')} AS a FROM lineitem"
        for c, s in _FLAG_SCORES.items()
    )
    + ")"
)
def roc_auc_one_vs_rest(spark, folder):
    df = table(spark, folder, "lineitem").select(
        "l_returnflag", F.array("l_discount", "l_tax", F.col("l_quantity") / 50).alias("scores")
    )
    area = metrics.roc_auc_one_vs_rest(df, "l_returnflag", "scores", ["A", "N", "R"])
    return area.withColumn("roc_auc", F.round("roc_auc", 6))


@query(
    """WITH p AS (SELECT l_extendedprice AS y, l_quantity * 2000 + 1000 AS p FROM lineitem)
    SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 4) AS r2, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
      round(avg(abs(y - p)), 4) AS mae, round(avg(abs((y - p) / nullif(y, 0))), 4) AS mape FROM p"""
)
def regression_metrics(spark, folder):
    df = table(spark, folder, "lineitem").select(
        "l_extendedprice", (F.col("l_quantity") * 2000 + 1000).alias("predicted")
    )
    return metrics.regression_metrics(df, "l_extendedprice", "predicted")


@query(
    f"""WITH {SCORED_SQL}, folds AS (SELECT ((doc_id % 2147483648) * 2654435761) % 4294967296 % 5 AS fold,
        avg(CASE WHEN prediction = quality THEN 1.0 ELSE 0.0 END) AS length_rule,
        avg(CASE WHEN 1 - toxic = quality THEN 1.0 ELSE 0.0 END) AS toxic_rule FROM scored GROUP BY 1),
      s AS (SELECT 'length_rule' AS model, length_rule AS score FROM folds UNION ALL SELECT 'toxic_rule', toxic_rule FROM folds),
      m AS (SELECT model, round(avg(score), 4) AS cv_mean, round(stddev_pop(score), 4) AS cv_std FROM s GROUP BY model)
    SELECT model, cv_mean, cv_std, row_number() OVER (ORDER BY cv_mean DESC, model) AS rank FROM m"""
)
def model_ranking(spark, folder):
    scored = scored_labels(spark, folder).withColumn("fold", mixed_hash(F.col("doc_id")) % 5)
    folds = scored.groupBy("fold").agg(
        F.avg(F.when(F.col("prediction") == F.col("quality"), 1.0).otherwise(0.0)).alias("length_rule"),
        F.avg(F.when(1 - F.col("toxic") == F.col("quality"), 1.0).otherwise(0.0)).alias("toxic_rule"),
    )
    scores = folds.unpivot("fold", ["length_rule", "toxic_rule"], "model", "score")
    return metrics.ranked_models(metrics.fold_summary(scores))


@query(
    f"""WITH {_LOG_SQL}, scored AS (SELECT l.quality, CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS score
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id), area AS (SELECT {_auc_sql("scored", "score", "quality = 1")} AS a)
    SELECT 'deploy_with_monitoring' AS rule, 'high' AS priority, 0.8::DOUBLE AS confidence
    UNION ALL SELECT 'improve_accuracy', 'medium', 0.7 FROM area WHERE a < 0.85
    UNION ALL SELECT 'improve_data_integrity', 'medium', 0.75 FROM log HAVING sum(rows_affected) > 0"""
)
def recommendations(spark, folder):
    area = metrics.roc_auc(scored_labels(spark, folder), "score", F.col("quality") == 1)
    _, log = clean.clean(dirty_orders(spark, folder), exclude=["o_orderkey", "o_custkey"])
    return gates.recommendations(spark, metrics=area, log=log).drop("evidence")


@query(
    f"""WITH {SCORED_SQL}, area AS (SELECT {_auc_sql("scored", "score", "quality = 1")} AS a)
    SELECT 'modeling' AS stage, 'roc_auc' AS metric, round(a, 6) AS value, 0.55::DOUBLE AS threshold,
      CASE WHEN a >= 0.55 THEN 1 ELSE 0 END AS passed FROM area"""
)
def model_gate(spark, folder):
    area = metrics.roc_auc(scored_labels(spark, folder), "score", F.col("quality") == 1)
    return gates.model_gate(area).withColumn("value", F.round("value", 6))


def _document_data(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return models.prepare(labels.join(documents, "doc_id"), "quality", "doc_id", models.CLASSIFICATION)


def _evaluated(trained: models.TrainedModel):
    """The evaluation record with the rows and classes that were trained on."""
    return trained.evaluation().withColumns(
        {"n": F.lit(trained.data.n).cast("bigint"), "classes": F.lit(len(trained.data.classes)).cast("bigint")}
    )


# SQL cannot train: these queries return what the models give, and tests check what holds for any model.
@query()
def train_forest(spark, folder):
    return _evaluated(models.train(_document_data(spark, folder), "random_forest"))


@query()
def train_cv(spark, folder):
    data = _document_data(spark, folder)
    sizes = data.rows.groupBy("fold").agg(F.count("*").alias("n"))
    return sizes.join(models.train(data, "logistic_regression").folds, "fold").select("model", "fold", "n", "score", "train_score")


@query()
def feature_importance(spark, folder):
    return models.train(_document_data(spark, folder), "random_forest").importance()


@query()
def permutation_importance(spark, folder):
    return models.permutation_importance(models.train(_document_data(spark, folder), "random_forest"))


def _document_forest(spark, folder):
    """A forest with its defaults on all labelled documents, without folds."""
    data = _document_data(spark, folder)
    estimator = models.build_estimator("random_forest_clf", models.DEFAULTS["random_forest_clf"], data.n, len(data.classes))
    return models.fitted(estimator, data.rows), data


@query()
def tree_attributions(spark, folder):
    model, data = _document_forest(spark, folder)
    found = attribution.attributions(model, data.rows, data.key)
    each = [F.get("attribution", F.lit(i)).alias(f) for i, f in enumerate(data.features)]
    return found.select("doc_id", "output", "base", *each, "total")


@query()
def attribution_importance(spark, folder):
    return attribution.attribution_importance(*_document_forest(spark, folder))


# Whatever the trees are, base and attributions add up to the probability of class 1.
@query("SELECT l.doc_id, 0::DOUBLE AS gap FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def attribution_gap(spark, folder):
    model, data = _document_forest(spark, folder)
    scored = models.with_scores(model.transform(data.rows)).select("doc_id", F.get("scores", F.lit(1)).alias("score"))
    found = attribution.attributions(model, data.rows, data.key).join(scored, "doc_id")
    return found.select("doc_id", F.abs(F.round(F.col("total") - F.col("score"), 9)).alias("gap"))


# Boosting takes its rounds one after the other: 20 here, 100 by default. The forest has all its trees.
_ROUNDS = {name: {"n_estimators": 20} for name in ("boosted_clf", "boosted_deep_clf")}


@query()
def model_comparison(spark, folder):
    return models.compete(_document_data(spark, folder), params_of=_ROUNDS)[1]


@query()
def tuned_model(spark, folder):
    trained = models.tune(_document_data(spark, folder), "logistic_regression", trials=30)
    return _evaluated(trained).withColumn("C", F.lit(trained.params["C"]))


@query()
def train_multiclass(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    data = models.prepare(df, "o_orderstatus", "o_orderkey", models.CLASSIFICATION)
    return _evaluated(models.train(data, "logistic_regression"))


# One standardised feature: the ridge weight is sum(z y) / (n + alpha), alpha 1.
@query(
    """WITH s AS (SELECT (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS z, l_extendedprice AS y FROM lineitem),
    w AS (SELECT sum(z * y) / (count(*) + 1) AS w, avg(y) AS m FROM s),
    e AS (SELECT y, m + w * z AS p FROM s, w)
    SELECT count(*) AS n, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 4) AS r2, round(sqrt(avg((y - p) * (y - p))), 2) AS rmse,
      round(avg(abs(y - p)), 2) AS mae FROM e"""
)
def train_ridge(spark, folder):
    df = table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_extendedprice"
    )
    trained = models.train(models.prepare(df, "l_extendedprice", "id", models.REGRESSION), "ridge")
    return trained.evaluation().select(
        F.lit(trained.data.n).cast("bigint").alias("n"), "r2", F.round("rmse", 2).alias("rmse"), F.round("mae", 2).alias("mae")
    )


@query()
def analysis_gates(spark, folder):
    raw = dirty_orders(spark, folder)
    report = analysis.analyse(raw, "o_orderstatus", ["o_orderkey", "o_custkey"])
    return report.gates
