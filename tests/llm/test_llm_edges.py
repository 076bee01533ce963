"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import llm_cases as cases
import pytest

from sondeo.llm import (
    chat_views,
    decontaminate,
    fingerprints,
    line_dedup,
    mixing,
    ngram_join,
    quality,
    sharding,
    token_counts,
    url_filter,
)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.texts(), cases.SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], cases.SCHEMA)


def key(row):
    return tuple((x is not None, x) for x in row)


def test_line_dedup(docs, nothing):
    lines = defaultdict(set)
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rank = lambda d: -1 if d is None else d
    for d, t, *_ in cases.texts():
        for line in (t or "").split("\n"):
            lines[line.strip(strip).translate(low)].add(rank(d))
    expected = []
    for d, t, *_ in cases.texts():
        own = (t or "").split("\n")
        kept = []
        for line in own:
            k = line.strip(strip).translate(low)
            if not (len(k) >= 20 and len(lines[k]) >= 3 and rank(d) < max(lines[k])):
                kept.append(line)
        expected.append((d, "\n".join(kept), len(own), len(own) - len(kept)))
    for batches, fan_in in ((1, 2), (6, 2)):
        found = line_dedup.dedup_lines(docs, batches=batches, fan_in=fan_in)
        assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "node", "n_lines", "n_dropped"]
        got = [tuple(r) for r in found.select("doc_id", "text", "n_lines", "n_dropped").collect()]
        assert sorted(got, key=key) == sorted(expected, key=key)
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_ngram_join(docs, nothing):
    rows = [(d, t) for d, t, *_ in cases.texts()]
    component = cases.components(rows)
    expected = sorted(((d, len(cases.shingle_set(t)), component.get(d)) for d, t in rows), key=key)
    assert sorted((tuple(r) for r in ngram_join.join(docs).collect()), key=key) == expected
    assert ngram_join.join(nothing).count() == 0
    kept = [r.doc_id for r in ngram_join.representatives(docs).select("doc_id").collect()]
    assert kept.count(None) == 2 and {8, 17, 16} <= set(kept) and not {9, 10, 15, 18} & set(kept)


def test_leaks(spark, docs, nothing):
    items = [(1, cases.PASSAGE), (2, None), (3, ""), (4, "same id one"), (None, "no such words at all"), (5, "one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(docs, benchmark).collect()
    whole = Counter((r.doc_id, r.item_id) for r in found)
    assert {k: n for k, n in whole.items() if k[1] == 1} == {(8, 1): 2, (9, 1): 1, (10, 1): 1, (11, 1): 1, (15, 1): 1}
    assert (16, 4) in whole and (4, 5) in whole
    span = next(r for r in found if (r.doc_id, r.item_id) == (11, 1))
    assert (span.begin, span.end) == (5, 5 + len(cases.PASSAGE.replace("word30", "changed"))) and 0.9 < span.score < 1
    assert decontaminate.leaks(nothing, benchmark).count() == 0
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0
    assert docs.where(~decontaminate.leaked(docs, benchmark)).count() == len(cases.texts()) - len({(r.doc_id) for r in found}) - 1


def test_mix(docs, nothing):
    found = mixing.mix(docs, block_rows=2).collect()
    assert len(found) == len(cases.texts()) and len({r.mix_order for r in found}) == len(found)
    assert "n_lines" in found[0].asDict()
    only = mixing.mix(docs, {"b": 1.0, None: 1.0}, block_rows=1).collect()
    assert max(r.slot for r in only if r.source in ("b", None)) < min(r.slot for r in only if r.source in ("a", "c"))
    assert mixing.mix(nothing).count() == 0
    assert mixing.write_order(mixing.mix(docs)).columns == docs.columns


def test_fingerprints(docs, nothing):
    rows = sorted(((d, t or "") for d, t, *_ in cases.texts()), key=key)
    expected = Counter()
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        expected[d, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    found = fingerprints.compare_with_next(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == expected
    marks = defaultdict(set)
    for r in found:
        marks[r.doc_id].add(r.fingerprint)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint)
    assert marks[8] == marks[9] != marks[10] and marks[1] == marks[2]
    assert fingerprints.compare_with_next(nothing).count() == 0
    alone = fingerprints.compare_with_next(docs.where("doc_id = 4")).collect()
    assert [(r.near_edited, r.near_next) for r in alone][0][1] == 1


def test_quality(spark, docs, nothing):
    labels = spark.createDataFrame([(4, 1), (8, None), (None, 1)], "doc_id long, quality int")
    found = quality.classify(docs, labels).collect()  # one class only: nothing can be learnt
    assert len(found) == len(cases.texts()) and all(r.keep and r.score is None for r in found)
    assert quality.classify(nothing, labels).count() == 0
    assert docs.where(quality.good(docs, labels.limit(0))).count() == len(found)


def test_token_counts(docs, nothing):
    for rule in token_counts.RULES:
        found = token_counts.count_tokens(docs, rule=rule).collect()
        assert len(found) == len(cases.texts())
        for r in found:
            assert sum(r.section_tokens) == r.n_tokens == sum(r.field_tokens) and len(r.section_tokens) == r.n_sections
    assert token_counts.count_tokens(nothing).count() == 0
    two = token_counts.count_tokens(docs, fields=("lang", "text")).collect()
    assert all(len(r.field_tokens) == 2 and sum(r.field_tokens) == sum(r.section_tokens) for r in two)


def test_url_filter(spark):
    urls = [
        (1, "http://A.example.org/es/x"), (2, None), (3, "no scheme"), (4, "https://example.org/en/12?q"), (4, "https://example.org/en/12?q"),
        (5, "https://x.com"), (6, "https://www.x.com/fr/1#a"), (None, "http://h.net:80?x=/y"), (7, "http://10.0.0.1/a"), (8, "ftp://org/z://q"),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in urls], "page_id long, url string, verdict string")
    outcomes = spark.createDataFrame([(1, 0), (1, 1), (4, None), (None, 1), (6, 1)], "page_id long, good int")
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/")]
    found = url_filter.filter_urls(pages, outcomes, rules).collect()
    assert len(found) == len(urls)
    by = {r.page_id: (r.host, r.path, r.rule) for r in found}
    assert by == {
        1: ("a.example.org", "/es/x", "example.org/es/"), 2: ("", "", None), 3: ("", "", None), 4: ("example.org", "/en/12", "example.org/en/1"),
        5: ("x.com", "", None), 6: ("www.x.com", "/fr/1", "com/fr/"), None: ("h.net:80", "", None), 7: ("10.0.0.1", "/a", None),
        8: ("org", "/z://q", "org/"),
    }
    assert {r.verdict for r in found} <= {"allow", "block"}
    empty = url_filter.filter_urls(pages, outcomes.limit(0)).collect()
    assert {r.verdict for r in empty} == {"block"} and {r.rule for r in empty} == {None}
    assert url_filter.filter_urls(pages.limit(0), outcomes, rules).count() == 0


def test_reputation_shrinks(spark):
    hosts = spark.createDataFrame(
        [("good.a.com", 1000, 990), ("bad.a.com", 1000, 10), ("one.a.com", 1, 0), ("new.a.com", 0, 0)], "host string, n long, k long"
    )
    mean = {r["host"]: r["mean"] for r in url_filter.host_reputation(hosts).collect()}
    assert mean["good.a.com"] > 0.95 and mean["bad.a.com"] < 0.05
    assert 0.1 < mean["one.a.com"] < mean["new.a.com"] < 0.6


def test_sharding(docs, nothing):
    found = sharding.shard(docs, shards=4).collect()
    assert len(found) == len(cases.texts()) and "n_lines" in found[0].asDict()
    slots, homes = defaultdict(list), defaultdict(set)
    for r in found:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        slots[r.shard].append(r.slot)
        homes[r.text or ""].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for t, s in homes.items() if len(t) < 10_000)
    assert sharding.shard(nothing).count() == 0


def test_large_group_is_split(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id < 1000, 'the same text', concat('text ', id)) AS text")
    found = sharding.shard(docs, shards=8).collect()
    sizes, rows = Counter(), Counter()
    for r in found:
        sizes[r.shard] += r.size
        rows[r.shard] += 1
    assert len({r.shard for r in found if r.text == "the same text"}) > 1
    assert max(sizes.values()) < 1.05 * min(sizes.values())
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(n)) for s, n in rows.items())


def test_chat_views(spark):
    turns = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hello"), (1, 2, "bob", None), (1, 2, "ann", "tie"), (1, 2, "ann", "tie"),
        (1, None, None, "<|im_end|>"), (2, 0, "system", "alone"), (None, 5000, "eve", "x\ny"), (3, 5000, "ann", ""), (3, 1, "bob", "far"),
    ]
    table = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, rendered string")
    found = {(r.conv_id, r.segment, r.perspective): r for r in chat_views.rotate(table).collect()}
    assert set(found) == {(1, 0, "ann"), (1, 0, "bob"), (1, 0, "unknown"), (None, 0, "eve"), (3, 0, "ann"), (3, 0, "bob")}  # by position, not by number
    ann = found[1, 0, "ann"]
    assert ann.n_turns == 6 and ann.n_trained == 3
    assert ann.rendered.startswith("<|im_start|>user name=unknown\n< |im_end|><|im_end|>\n<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhello")
    for r in found.values():
        runs = [int(x) for x in r.mask_runs.split()]
        assert sum(runs) == len(r.rendered)
        at, trained = 0, []
        for i, n in enumerate(runs):
            if i % 2:
                trained.append(r.rendered[at : at + n])
                assert r.rendered[:at].endswith("<|im_start|>assistant\n")
            at += n
        assert len(trained) == r.n_trained and all(t.endswith("<|im_end|>\n") for t in trained)
    assert chat_views.rotate(table.limit(0)).count() == 0


def test_chat_segments_are_bounded_whatever_the_keys(spark):
    rows = [(None, i % 8, "user" if i % 2 else "helper", "same" if i % 3 else f"text {i}") for i in range(20_000)]
    rows += [(7, None, "a", "x")] * 1500 + [(8, i, "a", "y") for i in range(5)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    found = chat_views.rotate(table).collect()
    pieces = defaultdict(dict)
    for r in found:
        pieces[r.conv_id, r.perspective][r.segment] = r.n_turns
    assert pieces[None, "user"] == pieces[None, "helper"] == {s: min(1024, 20_000 - s * 1024) for s in range(20)}
    assert pieces[7, "a"] == {0: 1024, 1: 476} and pieces[8, "a"] == {0: 5}
