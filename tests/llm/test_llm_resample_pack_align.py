"""Importance resampling, sequence packing and tokenizer alignment against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import llm_cases as cases
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sondeo.llm import packing, resampling, token_alignment, vocabularies
from sondeo.llm import queries as llm

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.texts(), cases.SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], cases.SCHEMA)


@pytest.fixture(scope="module")
def given(spark, data):
    return [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]


# --- resampling -------------------------------------------------------------------------------------------------


def feature_list(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resample(rows, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, t in rows for f in feature_list(t)[1])
    g = Counter(bucket(f) for t in target for f in feature_list(t)[1])
    all_s, all_t = sum(s.values()), sum(g.values())
    gain = lambda b: math.floor(1000 * math.log((g[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out, eligible = [], []
    for d, t in rows:
        words, features = feature_list(t)
        weight = sum(gain(bucket(f)) for f in features)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((d, len(features), weight, score))
        if len(words) >= 20:
            eligible.append((-score, -1 if d is None else d))
    return out, sorted(eligible)[: 5 * len(eligible) // 100], len(eligible)


def test_resampling_of_the_given_documents(spark, data, given):
    target = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    expected, drawn, _ = plain_resample(given, target)
    found = llm.QUERIES["op11_target_resample"](spark, data).collect()
    assert sorted((r.doc_id, r.n_features, r.weight, r.score) for r in found) == sorted(expected)
    ranked = sorted((r["rank"], -r.score, r.doc_id) for r in found if r["rank"] is not None)
    assert ranked == [(i + 1, *x) for i, x in enumerate(drawn)] and ranked


def test_resampling_of_awkward_documents(spark, docs, nothing):
    rows = [(r[0], r[1]) for r in cases.texts()]
    benchmark = spark.createDataFrame([(1, cases.PASSAGE), (2, None), (3, "")], "item_id long, text string")
    expected, _, size = plain_resample(rows, [cases.PASSAGE, None, ""])
    weighed = resampling.weigh(docs, benchmark)
    assert weighed.columns == [*docs.columns, "n_words", "n_features", "weight", "score"]
    key = lambda x: tuple((v is not None, v) for v in x)
    got = [tuple(r) for r in weighed.select("doc_id", "n_features", "weight", "score").collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)
    half = resampling.draw(weighed, percent=50).where("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in half] == list(range(1, size // 2 + 1))
    assert [r.score for r in half] == sorted((r.score for r in half), reverse=True)
    everything = resampling.draw(weighed, percent=100, min_words=0)
    assert everything.where("rank IS NULL").count() == 0 and everything.count() == len(rows)
    assert resampling.draw(weighed, percent=0).where("rank IS NOT NULL").count() == 0
    assert resampling.resample(nothing, benchmark).count() == 0
    assert resampling.weigh(docs, benchmark.limit(0)).count() == len(rows)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(d % 50, 30, 87, 0, d % 2) for d in range(200)]
    tied = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(7)
    found = resampling.draw(tied, percent=30).where("rank IS NOT NULL").orderBy("rank").collect()
    assert [(r.score, r.doc_id) for r in found] == sorted(((s, d) for d, _, _, _, s in rows), key=lambda x: (-x[0], x[1]))[:60]


def test_blocks_of_words_give_the_same_features(monkeypatch):
    text = "One, two three.four five_six é7 — ÄB " * 20 + "end"
    plain = Counter(zlib.crc32(f.encode()) % 10_000 for f in feature_list(text)[1])
    for block in (1, 7, 50, 1 << 20):
        monkeypatch.setattr(resampling.word_blocks, "__defaults__", (block,))
        assert resampling.hashed_features(text.encode()) == (len(feature_list(text)[0]), plain)


# --- packing ----------------------------------------------------------------------------------------------------


def fewest(lengths, capacity):
    """Fewest sequences for a short list, by trying all ways to place the longest first."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= lengths[i]:
                rest = list(rooms)
                rest[rest.index(room)] -= lengths[i]
                go(i + 1, rest)
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best


def test_reduction_costs_no_sequence():
    rng = random.Random(4)
    for round_ in range(300):
        capacity = rng.choice([10, 17, 30])
        lengths = [rng.randint(1 + capacity // rng.choice([3, 5, 9]), capacity) for _ in range(rng.randint(1, 9))]
        left = packing._Instance(Counter(lengths))
        fixed = packing.reduced(left, capacity)
        rest = list(left.counts.elements())
        assert sorted(x for ws, n in fixed for x in ws * n) + sorted(rest) and all(sum(ws) <= capacity for ws, _ in fixed)
        assert sorted([x for ws, n in fixed for x in ws * n] + rest) == sorted(lengths)
        assert sum(n for _, n in fixed) + fewest(rest, capacity) == fewest(lengths, capacity), (lengths, capacity, fixed)


def test_plan_uses_every_piece_and_few_sequences():
    rng = random.Random(6)
    lengths = [min(1024, int(rng.expovariate(1 / 300)) + 1) for _ in range(20_000)]
    patterns = packing.plan(Counter(lengths))
    assert Counter(x for ws, n in patterns for x in ws * n) == Counter(lengths)
    assert all(sum(ws) <= 1024 for ws, _ in patterns)
    assert sum(n for _, n in patterns) <= math.ceil(sum(lengths) / 1024) + 1


def check_packing(rows, found, encoder, capacity=1024):
    """``rows``: (doc_id, text), ids may repeat; ``found``: pieces with ids."""
    documents = Counter()
    for d, t in rows:
        ids = [*encoder.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        documents.update((d, n, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == documents
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        upto = 0
        for offset, length in sorted(parts):
            assert offset == upto
            upto += length
        assert upto <= capacity
    return len(sequences)


def test_packing_of_the_given_documents(spark, data, given):
    found = llm.QUERIES["op12_best_fit_packing"](spark, data).collect()
    n = check_packing(given, found, Tokenizer.from_file(vocabularies.BYTE_BPE))
    assert n <= math.ceil(sum(r.length for r in found) / 1024) + 1


def test_packing_of_awkward_documents(spark, docs, nothing):
    from pyspark.sql import functions as F

    rows = [(r[0], r[1]) for r in cases.texts()] + [(90, "a <|endoftext|> b"), (91, " " * 60_000 + "x"), (92, " \n　 " * 3)]
    more = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    packed = packing.pack(more, capacity=64)
    found = packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids").collect()
    check_packing(rows, found, Tokenizer.from_file(vocabularies.BYTE_BPE), 64)
    assert packing.pack(nothing).count() == 0
    assert packing.pack(docs).columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]


# --- vocabularies and alignment ---------------------------------------------------------------------------------


def test_ids_are_those_of_the_library():
    rng = random.Random(2)
    letters = "abc'sdtreENDOF 12 \n\t  é漢字😀́_-.,!<|>endoftext\x00\x1c\x85​"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(30)) for _ in range(1000)]
    texts += ["x<|endoftext|>y", "<|endoftext|>" * 3, " " * 40_000, "a" * 40_000]
    for marks in (True, False):
        library = Tokenizer.from_file(vocabularies.BYTE_BPE)
        library.encode_special_tokens = not marks
        own = vocabularies.byte_vocabulary(vocabularies.BYTE_BPE, marks).encode(texts)
        assert [x.tolist() for x in own] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def plain_alignment(rows):
    library = Tokenizer.from_file(vocabularies.BYTE_BPE)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=vocabularies.PIECE_BPE)
    entry = vocabularies.byte_vocabulary(vocabularies.BYTE_BPE).token_bytes
    aligned, count = [], Counter()
    for d, text in rows:
        a = library.encode(" " + (text or ""), add_special_tokens=False).ids
        b = pieces.encode(text or "")
        raw = (" " + (text or "")).encode()
        sides = []
        for ids, spell in ((a, lambda i: entry[i]), (b, lambda i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode())):
            upto, ends = b"", []
            for i in ids:
                upto += spell(i)
                ends.append(len(upto))
            sides.append((upto, ends))
        groups = []
        if text and sides[0][0] == raw == sides[1][0]:
            start = 0
            for cut in sorted(set(sides[0][1]) & set(sides[1][1])):
                groups.append(tuple([i for i, e in zip(ids, ends) if start < e <= cut] for ids, (_, ends) in zip((a, b), sides)))
                start = cut
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        count.update(set(links))
        aligned.append((d, groups, links))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    for d, groups, links in aligned:
        spelled = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        yield (
            d, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
            sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(spelled.encode()).hexdigest() if spelled else "",
        )


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_of_the_given_documents(spark, data, given):
    short = [(d, t) for d, t in given if len(t) < 6000]
    found = token_alignment.align(spark.createDataFrame(short, "doc_id long, text string").repartition(5))
    assert found.columns == ALIGNED
    assert sorted(map(tuple, found.collect())) == sorted(plain_alignment(short))
    whole = llm.QUERIES["op13_token_alignment"](spark, data)
    assert whole.columns == ALIGNED and whole.count() == len(given)


def test_alignment_of_awkward_documents(spark, nothing, monkeypatch):
    rows = [(r[0], r[1]) for r in cases.texts() if r[0] not in (12, 13)]
    rows += [(80, "▁x"), (81, "x\x00y"), (82, " "), (83, "\n"), (84, "漢字 かな 😀 <|endoftext|> </s> <unk>"), (85, "ﬁ é é"), (86, "é" * 400)]
    rows += [(100 + i, "one text of a hot group") for i in range(30)]
    key = lambda x: tuple((v is not None, v) for v in x)
    expected = sorted(plain_alignment(rows), key=key)
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, copies string").repartition(4)
    assert sorted(map(tuple, token_alignment.align(frame).collect()), key=key) == expected
    # the same in many small parts
    for name, value in {"PAIRS_IN_BLOCK": 40, "HOT_SHARE": 0.2}.items():
        monkeypatch.setattr(token_alignment, name, value)
    parts = token_alignment.align(frame.where("doc_id < 90 OR doc_id >= 100"))
    assert sorted(map(tuple, parts.collect()), key=key) == sorted(plain_alignment([r for r in rows if r[0] is not None]), key=key)
    assert token_alignment.align(nothing).count() == 0


def test_links_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    sides, lengths, _, _ = token_alignment._tokens(vocabularies.BYTE_BPE, vocabularies.PIECE_BPE)
    texts = ["".join(rng.choice(list("ab cé漢 \n"), 200)) for _ in range(10)] + ["", "é" * 500]
    groups = token_alignment.Aligned(*token_alignment._encoded(texts, sides), lengths)
    whole = Counter()
    for part in groups.links():
        for *link, n in zip(*(x.tolist() for x in part)):
            whole[tuple(link)] += n
    for limit in (1, 10, 1000):
        monkeypatch.setattr(token_alignment, "LINKS_AT_ONCE", limit)
        parts, owner = Counter(), {}
        for p, part in enumerate(groups.links()):
            for text, a, b, n in zip(*(x.tolist() for x in part)):
                parts[text, a, b] += n
                assert owner.setdefault((text, a), p) == p
        assert parts == whole
    assert sum(whole.values()) == int(groups.by_text(groups.size_a * groups.size_b).sum())


def test_every_new_query_is_registered():
    assert {"op11_target_resample", "op12_best_fit_packing", "op13_token_alignment"} <= set(llm.QUERIES)
