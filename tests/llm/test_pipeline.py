"""The pipeline's stages against plain versions, each on its own input."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
import llm_cases as cases

from sondeo.llm import mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    items = [" ".join(cases.words(r.text)) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = {r.doc_id: r for r in docs.collect()}
        assert after and all(after[d].text == before[d].text for d in after)
        if name != "sharding":
            assert docs.columns == COLUMNS
        gone = set(before) - set(after)
        if name == "quality classifier":
            assert sum(labels.get(d) == 1 for d in gone) <= 0.03 * sum(labels.get(d) == 1 for d in before)
            assert sum(labels.get(d) == 0 for d in gone) >= 0.5 * sum(labels.get(d) == 0 for d in before)
        elif name == "n-gram Jaccard join":
            component = cases.components([(d, r.text) for d, r in before.items()])
            assert set(after) == {d for d, c in component.items() if c == d}
        elif name == "benchmark decontamination":
            held = {d for d, r in before.items() if any(i in " ".join(cases.words(r.text)) for i in items)}
            assert held <= gone and len(gone) <= len(held) + 2
        else:
            assert not gone
    sizes = Counter()
    for r in docs.collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 16


def test_mixed_order_is_in_the_files(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = [r.source for r in corpus_pipeline.mixed(spark, docs, data).select("source").collect()]
    rows = Counter(found)
    least = min(rows.values())
    head = Counter(found[: len(rows) * least // 2])
    assert max(head.values()) - min(head.values()) <= 2 * 16


def test_slots_follow_the_mixture(spark, data, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    mix, runs = mixing.mix, []
    sources = sorted({r.source for r in docs.select("source").collect()})
    for i, weights in enumerate(({s: 1.0 for s in sources}, {s: 1.0 + 8 * n for n, s in enumerate(sources)})):
        monkeypatch.setattr(mixing, "mix", lambda d, w=weights: mix(d, w, block_rows=1))
        corpus_pipeline.mixed(spark, docs, data).write.parquet(f"{tmp_path}/{i}")
        found = corpus_pipeline.sharded(spark, spark.read.parquet(f"{tmp_path}/{i}"), data).collect()
        assert len(found) == docs.count()
        order = {r.doc_id: r.mix_order for r in mixing.mix(docs).collect()}
        shards = defaultdict(list)
        for r in found:
            shards[r.shard].append((r.slot, order[r.doc_id]))
        for rows in shards.values():
            rows.sort()
            assert [n for n, _ in rows] == list(range(len(rows)))
            assert [at for _, at in rows] == sorted(at for _, at in rows)
        runs.append({r.doc_id: (r.shard, r.slot) for r in found})
    assert {d: s for d, (s, _) in runs[0].items()} == {d: s for d, (s, _) in runs[1].items()} and runs[0] != runs[1]
