"""Values mapped to the names of a table, against all pairs."""

from __future__ import annotations

import random

import pytest

from sondeo.operators import clean


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _closest(value: str | None, names: list[str | None], threshold: float) -> str | None:
    text = (value or "").strip(" ").lower()
    found = []
    for name in names:
        other = (name or "").strip(" ").lower()
        if text and other:
            ratio = 1 - _distance(text, other) / max(len(text), len(other))
            if ratio >= threshold:
                found.append((-ratio, name))
    return min(found)[1] if found else value


def _worn(rng: random.Random, text: str, edits: int) -> str:
    for _ in range(edits):
        at = rng.randrange(len(text) + 1)
        text = text[:at] + rng.choice(["", "a", "b", "é"]) + text[at + rng.choice([0, 1]) :]
    return text


@pytest.mark.parametrize("threshold", [0.55, 0.7, 0.85, 1.0])
def test_all_pairs_agree(spark, threshold):
    rng = random.Random(int(100 * threshold))
    names = ["".join(rng.choices("abcé", k=rng.randint(1, 24))) for _ in range(60)] + ["Aé b", "aÉ B", " ", "", None]
    values = [_worn(rng, n, rng.randint(0, 6)) for n in names if n for _ in range(4)] + ["", " ", None, "aé b  ", "AÉ C"]
    df = spark.createDataFrame(list(enumerate(values)), "id long, worn string")
    table = spark.createDataFrame([(n, 1) for n in names * 2], "name string, worn int")
    found = clean.canonical_from_table(df, "worn", table, "name", threshold)
    assert found.columns == ["id", "worn", "worn_canonical"]
    got = {r.id: r.worn_canonical for r in found.collect()}
    assert got == {i: _closest(v, names, threshold) for i, v in enumerate(values)}


def test_edges(spark):
    df = spark.createDataFrame([(1, "alpha"), (2, None)], "id long, worn string")
    nothing = spark.createDataFrame([], "name string")
    assert {tuple(r) for r in clean.canonical_from_table(df, "worn", nothing, "name").collect()} == {(1, "alpha", "alpha"), (2, None, None)}
    assert clean.canonical_from_table(df.limit(0), "worn", nothing, "name").count() == 0
    with pytest.raises(ValueError, match="threshold"):
        clean.canonical_from_table(df, "worn", nothing, "name", 0.5)
