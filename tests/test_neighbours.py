"""Nearest-neighbour mutual information against a plain version over all pairs."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sondeo.operators import neighbours


def psi(n):
    return -neighbours.EULER + math.fsum(1 / i for i in range(1, n))


def plain(values, labels, k=3):
    size = Counter(labels)
    rows = [(0.0 if v is None else float(v), y) for v, y in zip(values, labels) if size[y] > 1]
    if not rows:
        return 0.0
    near = 0.0
    for i, (v, y) in enumerate(rows):
        need = min(k, size[y] - 1)
        r = sorted(abs(x - v) for j, (x, z) in enumerate(rows) if z == y and j != i)[need - 1]
        low, high = v - r, v + r
        m = sum(x == v if r == 0 else low < x < high for x, _ in rows)
        same = sum(x == v and z == y for x, z in rows) if r == 0 else need
        near += psi(same) - psi(m)
    n = len(rows)
    return max(0.0, psi(n) + near / n - sum(size[y] * psi(size[y]) for y in size if size[y] > 1) / n)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(500):
        y = rng.choice(["a", "a", "a", "b", "c"])
        shift = {"a": 0, "b": 2, "c": 5}[y]
        out.append((
            i, rng.gauss(shift, 1), rng.gauss(0, 1), float(rng.randint(0, 3) + (y == "b")),
            rng.choice([0.0, rng.random()]), None if i % 9 == 0 else rng.random() + shift / 20, y if i % 50 else None,
        ))
    return [*out, (500, 0.1, 0.2, 1.0, 0.3, 0.4, "single"), (501, 3.0, 0.2, 1.0, 0.3, 0.4, "pair"), (502, 9.0, 0.9, 7.0, 0.0, 0.4, "pair")]


FEATURES = ["gauss", "noise", "steps", "mixed", "gaps"]


@pytest.mark.parametrize("span_rows,block", [(1_000_000, 4096), (60, 7), (200, 3)])
def test_equals_all_pairs(spark, rows, span_rows, block):
    df = spark.createDataFrame(rows, "id long, gauss double, noise double, steps double, mixed double, gaps double, y string").repartition(4)
    found = {r.feature: r.mi for r in neighbours.neighbour_information(df, FEATURES, "y", span_rows=span_rows, block=block).collect()}
    labels = [r[6] for r in rows]
    expected = {f: plain([r[i + 1] for r in rows], labels) for i, f in enumerate(FEATURES)}
    assert found == pytest.approx(expected, abs=1e-9)
    assert found["gauss"] > 0.3 > 0.1 > found["noise"]


def test_digamma(spark):
    found = spark.range(1, 400).select("id", neighbours.digamma(F.col("id")).alias("p")).collect()
    assert all(r.p == pytest.approx(psi(r.id), abs=1e-10) for r in found)


def test_edges(spark):
    schema = "v double, w double, y string"
    assert [r.mi for r in neighbours.neighbour_information(spark.createDataFrame([], schema), ["v", "w"], "y").collect()] == [0.0, 0.0]
    single = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 3.0, "b")], schema)
    assert [r.mi for r in neighbours.neighbour_information(single, ["v"], "y").collect()] == [0.0]
    same = spark.createDataFrame([(1.0, float(i % 2), "ab"[i % 2]) for i in range(40)], schema)
    found = {r.feature: r.mi for r in neighbours.neighbour_information(same, ["v", "w"], "y").collect()}
    assert found["v"] == pytest.approx(0.0, abs=0.03) and found["w"] == pytest.approx(math.log(2), abs=0.03)


def test_counting_tasks_hold_a_bounded_number_of_values(spark, monkeypatch):
    df = spark.range(0, 3000, 1, 1).select("id", (F.col("id") / 7).alias("x"), F.lit(1.0).alias("one"), F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("y"))
    monkeypatch.setattr(neighbours._dealt_out, "__defaults__", (1000,))
    parts = neighbours._dealt_out(df, 6000).rdd.glom().map(len).collect()
    assert len(parts) == 7 and sum(parts) == 3000 and max(parts) < 600
    dealt = {r.feature: r.mi for r in neighbours.neighbour_information(df, ["x", "one"], "y").collect()}
    monkeypatch.undo()
    assert dealt == pytest.approx({r.feature: r.mi for r in neighbours.neighbour_information(df, ["x", "one"], "y").collect()}, abs=1e-9)
