"""Benchmark decontamination: rare n-gram seeds find candidate passages, Smith-Waterman alignment scores them.

The seeds are pairs of neighbouring words of an item, met in a document side by side or with one word between. An
alignment of an item of L words that scores s loses at most b = 4 (1 - s) L / 3 of its L - 1 pairs: with e changed or
missing words, u words left out at the ends and i added words, 3 e + 2 u + i <= 2 (1 - s) L, and it loses at most
2 e + u + i / 2 pairs. So of any b + t pairs t are met within 2 (1 - s) L diagonals, and an item needs only its rarest
pairs as seeds: half of those above b are spared, the ones that would make the most hits in the corpus and the
benchmark. Passages with t hits are aligned with the item, word by word. Nothing that scores enough is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondeo.llm.hashing import PUNCTUATION, grams, words

#: Items of fewer words are looked up whole.
LEAST_WORDS = 4
MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items are looked up in blocks of about this many bytes of text, each broadcast by itself.
BLOCK_BYTES = 8 * 1024 * 1024
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first * _STEP + second


class Lookup:
    """Sorted hashes; a bitmap of their leading bits spares most searches for others."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        bits = max(10, int(16 * len(hashes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = np.zeros(1 << bits, dtype=bool)
        self.mask[hashes >> self.shift] = True

    def find(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of ``own`` that are among the hashes, and the first row of each."""
        at = np.flatnonzero(self.mask[own >> self.shift])
        low = np.searchsorted(self.hashes, own[at], side="left")
        same = self.hashes[np.minimum(low, len(self.hashes) - 1)] == own[at] if len(at) else np.zeros(0, dtype=bool)
        return at[same], low[same]


@dataclass
class Items:
    """The items of a block that have words, and the pairs of those long enough."""

    ids: list = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def of(rows: list[tuple]) -> Items:
        """From (item_id, text)."""
        made = Items()
        for item_id, text in rows:
            found = words((text or "").encode(), PUNCTUATION)[0]
            if len(found):
                made.ids.append(item_id)
                made.words.append(found)
        return made

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, item and place of each pair of neighbouring words."""
        long = [(i, w) for i, w in enumerate(self.words) if len(w) >= LEAST_WORDS]
        if not long:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return (
            np.concatenate([_pairs(w[:-1], w[1:]) for _, w in long]),
            np.concatenate([np.full(len(w) - 1, i) for i, w in long]),
            np.concatenate([np.arange(len(w) - 1) for _, w in long]),
        )


class Seeds:
    """What to look up for a block of items: tables of (hash, item, place), and how many hits each item needs."""

    def __init__(self, items: Items, min_score: float = MIN_SCORE, counts: np.ndarray | None = None):
        """``counts`` are the occurrences in the corpus of the distinct pairs of ``items``, in their order by hash."""
        self.item_ids, self.item_words, self.min_score = items.ids, items.words, min_score
        lengths = np.array([len(w) for w in items.words], dtype=np.int64)
        #: The diagonals over which an alignment that scores enough spreads, and the pairs that it may lose.
        self.drift = np.floor(2 * (1 - min_score) * lengths + 1e-9).astype(np.int64)
        lost = np.floor(4 * (1 - min_score) * lengths / 3 + 1e-9).astype(np.int64)
        over = lengths - 1 - lost
        self.need = np.where(lengths >= LEAST_WORDS, np.maximum(1, (over + 1) // 2), 1)
        spared = np.where(lengths >= LEAST_WORDS, np.maximum(0, over - self.need), 0)

        hashes, owners, places = items.pairs()
        distinct, of, held = np.unique(hashes, return_inverse=True, return_counts=True)
        cost = (held if counts is None else held * counts)[of]
        dearest = np.lexsort((places, -cost, owners))
        begins = np.cumsum(np.bincount(owners, minlength=len(lengths))) - np.bincount(owners, minlength=len(lengths))
        rank = np.arange(len(owners)) - begins[owners[dearest]]
        kept = dearest[rank >= spared[owners[dearest]]]
        #: For each way to look up (0 for pairs, else the words of a whole short item) its table.
        self.tables = {0: (hashes[kept], owners[kept], places[kept])}
        for size in range(1, LEAST_WORDS):
            own = np.flatnonzero(lengths == size)
            if len(own):
                whole = np.concatenate([grams(items.words[i], size) for i in own])
                self.tables[size] = whole, own, np.zeros(len(own), dtype=np.int64)
        for size, table in list(self.tables.items()):
            order = np.argsort(table[0], kind="stable")
            self.tables[size] = tuple(column[order] for column in table)
        self.lookups = {size: Lookup(table[0]) for size, table in self.tables.items()}

    @staticmethod
    def of(rows: list[tuple], min_score: float = MIN_SCORE) -> Seeds:
        """From (item_id, text), by the counts of the items alone."""
        return Seeds(Items.of(rows), min_score)

    def hits(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the words of a document the item and the diagonal of each hit, by item and diagonal.

        Hits that too few others of their item are near are left out.
        """
        owners, begins = [], []
        for size, (hashes, items, places) in self.tables.items():
            for own in _looked_up(found, size):
                at, low = self.lookups[size].find(own)
                many = np.searchsorted(hashes, own[at], side="right") - low
                rows = np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
                owners.append(items[rows])
                begins.append(np.repeat(at, many) - places[rows])
        owners, begins = np.concatenate(owners), np.concatenate(begins)
        order = np.lexsort((begins, owners))
        owners, begins = owners[order], begins[order]
        last = np.arange(len(owners)) + self.need[owners] - 1
        end = np.minimum(last, max(0, len(owners) - 1))
        enough = (last < len(owners)) & (owners[end] == owners) & (begins[end] - begins <= self.drift[owners])
        covered = np.zeros(len(owners) + 1, dtype=np.int64)
        np.add.at(covered, np.flatnonzero(enough), 1)
        np.add.at(covered, end[enough] + 1, -1)
        near = np.cumsum(covered[:-1]) > 0
        return owners[near], begins[near]


def _looked_up(found: np.ndarray, size: int) -> list[np.ndarray]:
    """By place in a document, what is looked up there: runs of ``size`` words, or for 0 pairs, near and one apart."""
    if size:
        return [grams(found, size)] if len(found) >= size else []
    return [_pairs(found[:-1], found[1:]), _pairs(found[:-2], found[2:])]


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Score of the best local alignment and where it ends in the item and in the passage (one past)."""
    step = np.arange(len(passage)) * -GAP
    row, best = np.zeros(len(passage) + 1, dtype=np.int64), (0, 0, 0)
    for i, word in enumerate(item):
        cell = np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + GAP)
        # A gap in the item carries a score to the right: a running maximum with the gap's cost taken off.
        row[1:] = np.maximum(np.maximum.accumulate(np.maximum(cell, 0) + step) - step, 0)
        at = int(np.argmax(row))
        if row[at] > best[0]:
            best = int(row[at]), i + 1, at
    return best


def aligned(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Score from 0 to 1 (the whole item word by word) and the span of words in the passage."""
    score, item_end, end = smith_waterman(item, passage)
    _, _, back = smith_waterman(item[:item_end][::-1], passage[:end][::-1])
    return score / (MATCH * len(item)), end - back, end


def best_possible(item: np.ndarray, passage: np.ndarray) -> float:
    """A bound of the score of :func:`aligned`: words that the passage has match, each other one costs a step."""
    steps = np.cumsum(np.where(np.isin(item, passage), MATCH, max(MISMATCH, GAP)))
    before = np.minimum.accumulate(np.concatenate([[0], steps[:-1]]))
    return max(0, int((steps - before).max())) / (MATCH * len(item))


def search(text: str | None, seeds: Seeds) -> list[tuple]:
    """(item_id, score, begin, end) of each item found in a text, in code points, one span for an item."""
    raw = (text or "").encode()
    found, starts, ends = words(raw, PUNCTUATION)
    best: dict[int, tuple[float, int, int]] = {}
    owners, begins = seeds.hits(found)
    if not len(owners):
        return []
    lengths = np.array([len(seeds.item_words[i]) for i in owners], dtype=np.int64)
    # Hits of an item whose passages would overlap are one passage.
    fresh = np.ones(len(owners), dtype=bool)
    fresh[1:] = (owners[1:] != owners[:-1]) | (begins[1:] - begins[:-1] > np.maximum(lengths, seeds.drift[owners])[1:])
    edges = [*np.flatnonzero(fresh), len(owners)]
    for a, b in zip(edges, edges[1:]):
        item, drift = seeds.item_words[owners[a]], int(seeds.drift[owners[a]])
        low = max(0, int(begins[a]) - drift)
        high = min(len(found), int(begins[b - 1]) + len(item) + drift)
        if best_possible(item, found[low:high]) < seeds.min_score:
            continue
        score, first, last = aligned(item, found[low:high])
        if score >= seeds.min_score and score > best.get(owners[a], (0.0,))[0]:
            best[owners[a]] = score, low + first, low + last
    result = []
    for i, (score, first, last) in sorted(best.items()):
        begin = len(raw[: starts[first]].decode())
        result.append((seeds.item_ids[i], score, begin, begin + len(raw[starts[first] : ends[last - 1]].decode())))
    return result


def _occurrences(docs: DataFrame, distinct: np.ndarray) -> np.ndarray:
    """How often each of some sorted pairs of words is met in all texts: one pass, a count per pair and task."""
    total = np.zeros(len(distinct), dtype=np.int64)
    if not len(distinct):
        return total
    shared = docs.sparkSession.sparkContext.broadcast(Lookup(distinct))  # bounded: see BLOCK_BYTES

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = shared.value
        seen = np.zeros(len(lookup.hashes), dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                found = words((text.as_py() or "").encode(), PUNCTUATION)[0]
                for own in _looked_up(found, 0):
                    np.add.at(seen, lookup.find(own)[1], 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["pair", "n"])

    found = docs.select("text").mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    total[found["pair"].to_numpy()] = found["n"].to_numpy()
    return total


def _seed_blocks(docs: DataFrame, benchmark: DataFrame, min_score: float) -> Iterator[Seeds]:
    for rows in _item_blocks(benchmark):
        items = Items.of(rows)
        yield Seeds(items, min_score, _occurrences(docs, np.unique(items.pairs()[0])))


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """Blocks of (item_id, text) of bounded size: items are dealt by hash into as many blocks as their bytes need."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = 1 + total // BLOCK_BYTES
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield sorted((tuple(r) for r in part.collect()), key=lambda r: (r[0] is not None, r))


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, item_id, score, begin, end) for every document and item that it holds a copy of.

    ``score`` is the local alignment score over words (2 a match, -1 a mismatch or gap) divided by that of the
    whole item; pairs of at least ``min_score`` are returned with the best span, in code points. Words are runs
    without white space and ASCII punctuation, A-Z as a-z. From a ``min_score`` of 0.5 on, every such pair of an item
    of four words or more is found (below, those with two neighbouring words of the item near each other); shorter
    items are found where they stand whole. The benchmark passes through the driver in blocks of ``BLOCK_BYTES``; for
    each block the texts are read twice, for the counts of its pairs and for the search.

    Null and empty texts and items match nothing. Repeated rows are searched each for itself, equal items too; null
    ids are returned as such. Extra columns are left out. Empty tables give an empty result.
    """
    found = None
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, begin long, end long"
    names = ["doc_id", "item_id", "score", "begin", "end"]
    for seeds in _seed_blocks(docs, benchmark, min_score):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)  # bounded: see BLOCK_BYTES

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = [
                    (doc_id.as_py(), *hit)
                    for doc_id, text in zip(batch.column(0), batch.column(1))
                    for hit in search(text.as_py(), shared.value)
                ]
                if hits:
                    columns = list(zip(*hits))
                    kinds = [batch.schema.types[0], None, pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        part = docs.select("doc_id", "text").mapInArrow(searched, schema)
        found = part if found is None else found.unionByName(part)
    return found


def leaked(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> Column:
    """A column for ``docs`` that is true for rows with a copy of an item; rules as for :func:`leaks`."""
    found = F.lit(False)
    for seeds in _seed_blocks(docs, benchmark, min_score):
        found = found | _holds(docs.sparkSession.sparkContext.broadcast(seeds))(F.col("text"))
    return found


def _holds(shared: Broadcast):
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(search(t, shared.value)) for t in texts], dtype=bool)

    return holds
