"""The methods themselves against brute force, round trips and held-out rows."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import llm_cases as cases
import numpy as np
import pytest

from sondeo.llm import decontaminate, fingerprints, hashing, mixing, ngram_join, quality, sharding, token_counts
from sondeo.llm import components as llm_components
from sondeo.llm import queries as llm
from sondeo.llm.components import components


def test_words_and_blocks(monkeypatch):
    text = "One  two\tTHREE\n" + "x" * 50 + " été fin"
    whole = hashing.words(text.encode())
    monkeypatch.setattr(hashing, "BLOCK", 7)
    parts = hashing.words(text.encode())
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))
    assert [text.encode()[s:e].decode() for s, e in zip(*whole[1:])] == text.split()
    assert hashing.words(b"three")[0][0] == whole[0][2]


def test_prefix_hashes_answer_spans():
    rng = random.Random(3)
    text = "".join(rng.choice("abé\U0001f600") for _ in range(5000))
    table = fingerprints.PrefixHashes(text)
    for w, (prime, base) in enumerate(fingerprints.MODULI):
        value, power = 0, 1
        for i in range(200):
            assert int(table.prefix[w][i]) == value
            value, power = (value + (ord(text[i]) + 1) * power) % prime, power * base % prime
    other = fingerprints.PrefixHashes("zz" + text[1000:1300] + "#")
    assert other.common_extension(2, table, 1000) == 300
    assert other.span(2, 302) == table.span(1000, 1300) != table.span(1001, 1301)
    long = "".join(rng.choice("ab") for _ in range(fingerprints._ROW * fingerprints._ROWS_AT_ONCE + 777))
    changed = long[:-1] + "c"
    a, b = (fingerprints.fingerprint(fingerprints.code_points(t)) for t in (long, changed))
    assert a != b and fingerprints.likeness(a, b) > 0.8


def test_likeness_of_edits(spark, data):
    found = llm.QUERIES["op5_fingerprints"](spark, data).toPandas()
    long = found[found.n_chars > 20]
    assert (long.near_edited >= 0.4).all() and long.near_next.median() < 0.05


def test_smith_waterman_by_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(100):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 14))
        h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                same = 2 if a[i - 1] == b[j - 1] else -1
                h[i, j] = max(0, h[i - 1, j - 1] + same, h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.smith_waterman(a, b)[0] == h.max()


def test_leaks_by_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{data}/benchmark.parquet").collect()
    expected = set()
    for d in docs:
        text = " ".join(cases.words(d.text))
        expected |= {(d.doc_id, i.item_id) for i in items if " ".join(cases.words(i.text)) in text}
    found = {(r.doc_id, r.item_id) for r in llm.QUERIES["op1_benchmark_leaks"](spark, data).collect()}
    assert expected and expected <= found and len(found) <= 1.2 * len(expected) + 2


def test_leaks_find_edited_copies(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=40))) for i in range(20)]
    docs = []
    for i, text in items:
        w = text.split()
        for j in rng.sample(range(40), 8):
            w[j] = rng.choice(["", "new", w[j] + " extra"])
        docs.append((i, " ".join([*rng.choices(vocabulary, k=200), *w, *rng.choices(vocabulary, k=200)])))
    docs += [(100 + i, " ".join(rng.choices(vocabulary, k=400))) for i in range(50)]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i) for i in range(20)}


def test_leaks_find_edited_copies_beside_exact_ones(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(f"i{i}x{j}" for j in range(40))) for i in range(3)]
    items += [(10 + i, " ".join(rng.choices(vocabulary, k=30))) for i in range(5)]
    docs = []
    for i, text in items:
        for every in (0, 4, 5, 8):
            w = ["new" if every and j % every == every - 1 else x for j, x in enumerate(text.split())]
            around = [rng.choices(vocabulary, k=20) for _ in range(2)]
            docs.append((100 * i + every, " ".join([*around[0], *w, *around[1]])))
    expected = {}
    for d, text in docs:
        passage = np.array([hash(w) for w in text.split()])
        for i, item in items:
            words = np.array([hash(w) for w in item.split()])
            score = decontaminate.smith_waterman(words, passage)[0] / (2 * len(words))
            assert decontaminate.best_possible(words, passage) >= score
            if score >= decontaminate.MIN_SCORE:
                expected[d, i] = score
    assert {(100 * i + every, i) for i, _ in items for every in (0, 4, 5, 8)} <= set(expected)
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.score for r in found.collect()} == expected


def _likeness_by_brute_force(a, b):
    """As :func:`fingerprints.likeness`, on the texts themselves."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    grid = [0, *(int(g) for g in fingerprints.GRID if g <= min(n, m))]
    front = max(g for g in grid if a[:g] == b[:g])
    back = min(max(g for g in grid if a[n - g :] == b[m - g :]), min(n, m) - front)
    chosen = [fingerprints.cuts_of(fingerprints.code_points(t)) for t in (a, b)]
    level = max(c[0] for c in chosen)
    spans = []
    for t, (_, places, zeros) in zip((a, b), chosen):
        at = [0, *places[zeros >= level].tolist(), len(t)]
        spans.append(list(zip(at, at[1:])))
    between = []
    for t, own, u, other in ((a, spans[0], b, spans[1]), (b, spans[1], a, spans[0])):
        left = Counter(u[x:y] for x, y in other)
        found = []
        for x, y in own:
            if left[t[x:y]] > 0:
                left[t[x:y]] -= 1
                found.append(max(0, min(y, len(t) - back) - max(x, front)))
        between.append(sum(found))
    return min(front + back + min(between), max(n, m) - 1) / max(n, m)


def test_likeness_by_brute_force():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdeé\U0001f600", k=rng.randint(2, 9))) for _ in range(300)]
    texts = ["", "a", "ab", "x" * 5000, "xy" * 3000, "x" * 5001]
    for size in (3, 30, 400, 3000):
        w = rng.choices(vocabulary, k=size)
        texts += [" ".join(w), " ".join(w[size // 2 :] + w[: size // 2])]
        for _ in range(3):
            v = list(w)
            for j in rng.sample(range(size), min(size, 3)):
                v[j] = rng.choice(["new", "", v[j] + " more"])
            texts.append(" ".join(v))
    marks = [fingerprints.fingerprint(fingerprints.code_points(t)) for t in texts]
    for a, x in zip(texts, marks):
        assert len(x.split(".")[4]) <= 2 + 18 * fingerprints.MOST_CUTS
        for b, y in zip(texts, marks):
            found = fingerprints.likeness(x, y)
            assert found == _likeness_by_brute_force(a, b) == fingerprints.likeness(y, x)
            assert (found == 1) == (a == b) and 0 <= found <= 1


@pytest.mark.parametrize("places", [(0.05, 0.95), (0.3, 0.7), (0.2, 0.5, 0.8)])
def test_copies_with_edits_far_apart_are_alike(places):
    rng = random.Random(13)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(900)]
    found = []
    for size in (400, 900, 4000) * 5:
        w = rng.choices(vocabulary, k=size)
        v = ["changed" if j in {int(p * size) for p in places} else x for j, x in enumerate(w)]
        marks = [fingerprints.fingerprint(fingerprints.code_points(" ".join(t))) for t in (w, v, rng.choices(vocabulary, k=size))]
        found.append(fingerprints.likeness(marks[0], marks[1]))
        assert fingerprints.likeness(marks[0], marks[2]) < 0.1
    assert min(found) > 0.82 and sum(found) / len(found) > 0.9


def test_cuts_do_not_depend_on_blocks(monkeypatch):
    codes = np.random.default_rng(6).integers(97, 110, 30_000).astype(np.uint32)
    whole = fingerprints.cuts_of(codes)
    monkeypatch.setattr(fingerprints, "_SCAN", 1000)
    assert all(np.array_equal(a, b) for a, b in zip(whole, fingerprints.cuts_of(codes)))
    assert 40 < len(whole[1]) <= fingerprints.MOST_CUTS


def _changed(rng, item, kind):
    """Copies of an item near the least score: every third word changed, words added between all, or edits at random."""
    if kind == 0:
        return ["new" if j % 3 == 2 else w for j, w in enumerate(item)]
    if kind == 1:
        return [x for w in item for x in ((w, "new") if rng.random() < 0.8 else (w,))]
    if kind == 2:
        return [w for j, w in enumerate(item) if j % 4 != 3]
    w, share = list(item), rng.choice([0.15, 0.25, 0.33])
    for j in rng.sample(range(len(w)), int(share * len(w))):
        w[j] = rng.choice(["", "new", w[j] + " extra"])
    return " ".join(w).split()


@pytest.mark.parametrize("least", [0.5, 0.65])
def test_every_copy_that_scores_enough_is_found(least):
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(90)]
    items = [(i, rng.choices(vocabulary, k=rng.choice([4, 5, 9, 24, 41]))) for i in range(30)]
    exact = rng.choices(vocabulary, k=41)
    items += [(30, exact), (31, exact)]
    rows = [(i, " ".join(w)) for i, w in items]
    ids = {w: n for n, w in enumerate([*vocabulary, "new", "extra"])}
    seeds, near, beside = decontaminate.Seeds.of(rows, least), 0, 0
    for i, item in items:
        for kind in range(8):
            copy = exact * (kind == 5) + _changed(rng, item, kind)
            text = [*rng.choices(vocabulary, k=30), *copy, *rng.choices(vocabulary, k=30)]
            passage = np.array([ids[w] for w in text])
            expected = {}
            for k, other in items:
                score = decontaminate.smith_waterman(np.array([ids[w] for w in other]), passage)[0] / (2 * len(other))
                if score >= least:
                    expected[k] = score
            assert {k: s for k, s, _, _ in decontaminate.search(" ".join(text), seeds)} == expected
            near += i in expected and 0.5 <= expected[i] <= 0.75
            beside += i in expected and 30 in expected and i < 30
    assert near > 20 and beside > 5


def test_a_shared_phrase_starts_no_alignment(monkeypatch):
    phrase = "which of the following is".split()
    rows = [(i, " ".join([*phrase, *(f"i{i}x{j}" for j in range(35))])) for i in range(3000)]
    tried = []
    whole = decontaminate.best_possible
    monkeypatch.setattr(decontaminate, "best_possible", lambda item, passage: tried.append(1) or whole(item, passage))
    seeds = decontaminate.Seeds.of(rows)
    assert decontaminate.search(" ".join(phrase * 240), seeds) == [] and not tried
    assert [k for k, *_ in decontaminate.search(" ".join(phrase * 20) + " " + rows[7][1], seeds)] == [7]


def test_common_pairs_are_spared():
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(500)], k=40))) for i in range(10)]
    items = decontaminate.Items.of(rows)
    distinct = np.unique(items.pairs()[0])
    counts = np.array([rng.choice([0, 1, 1000]) for _ in distinct])
    by_hash = dict(zip(distinct.tolist(), counts.tolist()))
    kept = {(i, p) for _, i, p in zip(*(c.tolist() for c in decontaminate.Seeds(items, 0.5, counts).tables[0]))}
    for i, w in enumerate(items.words):
        own = [by_hash[h] for h in decontaminate._pairs(w[:-1], w[1:]).tolist()]
        seeds = [own[p] for p in range(39) if (i, p) in kept]
        assert len(seeds) == 33 and sorted(seeds) == sorted(own)[:33]


def test_rtree_keeps_every_similar_pair():
    rng = np.random.default_rng(11)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(20, 200)).astype(np.uint64)) for _ in range(150)]
    for i in range(150, 400):
        base = sets[rng.integers(0, len(sets))]
        kept = base[rng.random(len(base)) > rng.random() * 0.2]
        sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**63, rng.integers(0, 10)).astype(np.uint64)])))
    points = np.stack([ngram_join.folded(ngram_join.count_vector(s), 32) for s in sets])
    tree = ngram_join.RTree(points, np.array([len(s) for s in sets]), np.arange(len(sets)))
    left = {tuple(sorted((int(x), int(y)))) for a, b in tree.pairs() for x, y in zip(a, b)}
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if ngram_join.similar(sets[i], sets[j])}
    assert alike and alike <= left and len(left) < len(sets) ** 2 / 8


def test_merged_cells_hold_every_pair():
    rng = np.random.default_rng(4)
    cells = [rng.choice(60, rng.integers(3, 12), replace=False).astype(np.int64) for _ in range(80)]
    made = [set(m.tolist()) for m in ngram_join.merged_cells(cells)]
    assert len(made) < len(cells) and all(any(set(c.tolist()) <= m for m in made) for c in cells)


def _copies(seed: int) -> list[tuple]:
    """Groups of near copies around few texts with a passage in common, and texts at the border of similarity."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([8, 40, 90])) + passage * rng.choice([0, 1])
        for _ in range(rng.choice([1, 2, 15])):
            w = list(base)
            for j in rng.sample(range(len(w)), rng.randint(0, max(1, len(w) // 25))):
                w[j] = rng.choice(vocabulary)
            rows.append(" ".join(w))
    for k in (3, 5, 20, 21, 30):
        rows += [" ".join(passage + rng.choices(vocabulary, k=k)) for _ in range(6)]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_by_brute_force(spark, seed):
    rows = _copies(seed)
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.component_id for r in found} == cases.components(rows)


def test_ngram_join_in_tiles_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rows = _copies(2)
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.component_id for r in found} == cases.components(rows)


def test_tiles_hold_every_pair_across_components(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 50)
    label = {i: 1 if i <= 3000 else i // 10 for i in range(1, 3201)}
    members = [(7, i) for i in label] + [(8, i) for i in (1, 2, 3)] + [(9, i) for i in (1, 3001, 3002)]
    members = spark.createDataFrame(members, "cell_id long, node long")
    labels = spark.createDataFrame([(i, x) for i, x in label.items() if x != i], "node long, label long")
    for near in (None, 4):
        tiles = {}
        for r in ngram_join._tiles(members, labels, near).collect():
            assert r.label == label[r.node]
            tiles.setdefault((r.cell_id, r.i, r.j), set()).add(r.node)
        assert {c for c, _, _ in tiles} == {7, 9} and tiles[9, 0, 0] == {1, 3001, 3002}
        assert max(map(len, tiles.values())) < 4 * 50 and len(tiles) > 50
        homes = {i: set() for i in label}
        for t, nodes in tiles.items():
            for i in nodes:
                homes[i].add(t)
        if near is None:
            assert all(homes[i] & homes[k] for i in range(3001, 3201) for k in label if label[i] != label[k])
            assert max(len(homes[i] - {(9, 0, 0)}) for i in range(1, 3001)) == 4  # blocks of the 200 outside
        else:
            assert max(map(len, homes.values())) <= 3


def test_copies_spread_over_parts(spark):
    docs = spark.createDataFrame([(i, "the same text of a few words") for i in range(800)], "doc_id long, text string").coalesce(1)
    dealt = ngram_join._dealt(docs, 8, 5, 75).where("tokens IS NULL").groupBy("part").count().collect()
    assert {r["count"] for r in dealt} == {100}


@pytest.mark.parametrize("in_a_task", [20, 10_000])
def test_components(spark, monkeypatch, in_a_task):
    monkeypatch.setattr(llm_components, "LINKS_PER_TASK", in_a_task)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000 + i, 1000) for i in range(1, 50)] + [(7, 7), (5000, 4000), (4000, 4500)]
    random.Random(1).shuffle(links)
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    assert found == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(50)}, 4000: 4000, 4500: 4000, 5000: 4000}


def _slots_by_brute_force(weights, blocks):
    """Slot by slot: of the blocks that are released and next in their source, the one with the earliest deadline."""
    exact = {s: Fraction(repr(float(w))) for s, w in weights.items()}
    total, taken, found, t = sum(exact.values()), Counter(), {}, 0
    while len(found) < sum(blocks.values()):
        due = [(math.ceil((taken[s] + 1) * total / w), s) for s, w in exact.items() if taken[s] < blocks[s] and math.floor(taken[s] * total / w) <= t]
        if due:
            s = min(due)[1]
            found[s, taken[s]] = t
            taken[s] += 1
        t += 1
    return found


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 0.7, "b": 0.2, "c": 0.1}, {str(i): i + 1 for i in range(20)}])
@pytest.mark.parametrize("shortest", [1, 40])
def test_blocks_keep_their_windows(weights, shortest):
    blocks = {s: shortest + 7 * i for i, s in enumerate(weights)}
    laid = {(s, i): t for s, i, t in mixing.laid_out(weights, blocks)}
    assert laid == _slots_by_brute_force(weights, blocks)
    total = sum(Fraction(repr(float(w))) for w in weights.values())
    for (s, i), t in laid.items():
        w = Fraction(repr(float(weights[s]))) / total
        assert i // w <= t < -(-(i + 1) // w)


def test_schedule_jumps_over_empty_slots():
    laid = list(mixing.laid_out({"a": 1.0, "b": 1e-6}, {"a": 10, "b": 20_000, "c": 3, "d": 2}))
    assert len(laid) == 20_015 and len({t for _, _, t in laid}) == 20_015
    assert [s for s, _, _ in laid[-5:]] == ["c", "c", "c", "d", "d"]
    with pytest.raises(ValueError):
        list(mixing.laid_out({"a": 1.0, "b": 1e-30}, {"a": 1, "b": 5}))


def test_sources_without_weight_have_places_of_their_own(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3], "") for i in range(90)], "doc_id long, source string, text string")
    found = mixing.mix(docs, {"a": 1.0}, block_rows=4).collect()
    assert len({r.mix_order for r in found}) == 90


@pytest.mark.parametrize(
    "weights",
    [{"a": 0.7, "b": 0.2, "c": 0.1}, {"hot": 0.6, **{f"s{i:02}": 0.4 / 39 for i in range(39)}}, {"hot": 3.0, **{f"s{i:02}": 1.1**0.5 for i in range(19)}}],
)
def test_mix_keeps_the_given_weights_over_many_periods(spark, weights):
    total, slots = sum(weights.values()), 5000
    needed = {s: int(slots * w / total) + 2 for s, w in weights.items()}
    rows = [(i, s, "") for s, n in needed.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    owner = {r.slot: r.source for r in mixing.mix(docs, weights, block_rows=1).select("slot", "source").collect()}
    assert len(owner) == len(rows)
    seen = Counter()
    for t in range(slots):
        seen[owner[t]] += 1
        assert all(abs(seen[s] - (t + 1) * w / total) < 1 + 1e-9 for s, w in weights.items())


def test_mix_by_brute_force(spark, data):
    found = llm.QUERIES["op4_source_mix"](spark, data).collect()
    rows = Counter(r.source for r in found)
    blocks = defaultdict(Counter)
    for r in found:
        blocks[r.source][r.block] += 1
    owner, expected = _slots_by_brute_force({s: n**0.5 for s, n in rows.items()}, {s: len(b) for s, b in blocks.items()}), {}
    for s, own in blocks.items():
        assert sorted(own) == list(range(-(-rows[s] // mixing.BLOCK_ROWS)))
        assert all(own[b] == mixing.BLOCK_ROWS for b in list(own) if b < max(own))
        expected |= {(s, b): owner[s, b] for b in own}
    assert {(r.source, r.block): r.slot for r in found} == expected
    assert len({r.mix_order for r in found}) == len(found)


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    taught = labels.where("doc_id % 5 <> 0")
    scores = {r.doc_id: r.keep for r in quality.classify(docs, taught).collect()}
    held = labels.where("doc_id % 5 = 0").collect()
    good = [scores[r.doc_id] for r in held if r.quality == 1]
    bad = [scores[r.doc_id] for r in held if r.quality == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.4
    stays = {r.doc_id for r in docs.where(quality.good(docs, taught)).select("doc_id").collect()}
    assert stays == {d for d, keep in scores.items() if keep}


def test_token_spans_round_trip():
    text = "Hello wörld\nzweite Zeile 🙂🙂\n\nend"
    ends = token_counts.token_ends(text)
    assert ends[-1] == len(text.encode()) and (np.diff(ends) > 0).all()
    encoder, lengths = token_counts.tokenizer(token_counts.VOCABULARY)
    ids = encoder.encode_ordinary(text)
    assert encoder.decode(ids) == text and len(ids) == len(ends)
    section_starts = np.array([0, 4, 9])
    spans = np.array([2, 6, 9, 12])  # the second token has two bytes on each side, the third three in one
    assert token_counts.attribute(spans, section_starts, "first")[0].tolist() == [2, 1, 1]
    assert token_counts.attribute(spans, section_starts, "last")[0].tolist() == [1, 2, 1]
    assert token_counts.attribute(spans, section_starts, "most") [0].tolist() == [2, 1, 1]
    assert token_counts.attribute(spans, section_starts)[1] == 1


def test_token_counts_by_brute_force(spark, data):
    encoder, _ = token_counts.tokenizer(token_counts.VOCABULARY)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in llm.QUERIES["op7_token_counts"](spark, data).collect():
        sections, at, tokens = Counter(), 0, [encoder.decode_single_token_bytes(t) for t in encoder.encode_ordinary(texts[r.doc_id])]
        raw = texts[r.doc_id].encode()
        for token in tokens:
            sections[raw[:at].count(b"\n")] += 1
            at += len(token)
        assert (r.n_tokens, r.n_sections) == (len(tokens), raw.count(b"\n") + 1)
        assert r.section_tokens == [sections[i] for i in range(r.n_sections)]


def test_packing_is_balanced():
    rng = np.random.default_rng(2)
    items = rng.lognormal(0, 1, (4000, 3))
    items /= items.sum(axis=0)
    sums = np.stack([np.bincount(sharding.place(items, 16), items[:, k], 16) for k in range(3)])
    assert (sums.max(axis=1) < 1.02 / 16).all() and (sums.min(axis=1) > 0.98 / 16).all()


def test_shards_of_the_documents(spark, data):
    found = llm.QUERIES["op9_sharding"](spark, data).toPandas()
    sizes = found.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() < 1.1 * sizes.min()
    assert found.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all()
