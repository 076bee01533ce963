"""What holds for any trained model, checked on the results of the model queries."""

from __future__ import annotations

import oracle
import pytest

from sondeo.operators import models
from sondeo.plans import catalog

QUERIES, ORACLES = catalog.load_all()
LABELLED = "labelled AS (SELECT l.quality, d.lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


@pytest.fixture(scope="module")
def duck(data):
    return oracle.connect(data)


@pytest.fixture(scope="module")
def features(duck):
    sql = f"""WITH {LABELLED} SELECT 'n_chars' UNION ALL SELECT 'source' UNION ALL
        SELECT DISTINCT 'lang_' || lang FROM labelled WHERE lang > (SELECT min(lang) FROM labelled)"""
    return {r[0] for r in duck.execute(sql).fetchall()}


@pytest.mark.parametrize("name,model,rows,label,least", [
    ("train_forest", "random_forest_clf", "labelled", "quality", 0.6),
    ("tuned_model", "logistic_regression", "labelled", "quality", 0.5),
    ("train_multiclass", "logistic_regression", "orders", "o_orderstatus", 0.5),
])
def test_evaluations(spark, data, duck, name, model, rows, label, least):
    n, classes = duck.execute(f"WITH {LABELLED} SELECT count(*), count(DISTINCT {label}) FROM {rows}").fetchone()
    found = QUERIES[name](spark, data).first()
    assert (found["model"], found["n"], found["classes"]) == (model, n, classes)
    assert least <= found["roc_auc"] <= 1 and 0 <= found["cv_mean"] <= 1 and found["cv_std"] >= 0
    assert all(0 <= found[m] <= 1 for m in ("accuracy", "precision", "recall", "f1"))


def test_folds(spark, data, duck):
    # Rows of a class are dealt out in turn, so fold f of n rows has (n - f + 4) div 5.
    sql = f"""WITH {LABELLED}, sizes AS (SELECT quality, count(*) AS n FROM labelled GROUP BY quality)
        SELECT f, CAST(sum((n - f + 4) // 5) AS BIGINT) FROM sizes, range(5) r(f) GROUP BY f ORDER BY f"""
    found = QUERIES["train_cv"](spark, data).orderBy("fold").collect()
    assert [(r["fold"], r["n"]) for r in found] == duck.execute(sql).fetchall()
    assert all(0 <= s <= 1 for r in found for s in (r["score"], r["train_score"]))


@pytest.mark.parametrize("name", ["feature_importance", "permutation_importance", "attribution_importance"])
def test_importances(spark, data, features, name):
    found = QUERIES[name](spark, data).collect()
    values = [r["importance"] for r in found]
    assert {r["feature"] for r in found} == features and values == sorted(values, reverse=True)
    if name == "feature_importance":
        assert sum(values) == pytest.approx(1)
    assert all(v >= (-1 if name == "permutation_importance" else 0) for v in values)


def test_ranking(spark, data):
    found = QUERIES["model_comparison"](spark, data).orderBy("rank").collect()
    assert {r["model"] for r in found} == set(models.candidates(models.CLASSIFICATION))
    means = [r["cv_mean"] for r in found]
    assert all(r["error"] is None and 0 <= r["cv_mean"] <= 1 for r in found) and means == sorted(means, reverse=True)
    assert not ORACLES.keys() & {"model_comparison", "train_forest", "tuned_model"}
