"""Best-fit packing of documents into sequences of bounded length, after reduction by dominance.

A piece matters to the packing only through its length, so the instance is the count of pieces by length: at most as
many numbers as a sequence has places, whatever the size of the corpus. On it the reduction of Martello and Toth fixes
small sets that provably dominate every other way to fill their sequence, all equal sets at once, and best fit
decreasing packs the remainder. The pieces then look up their places by their number among those of equal length.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sondeo.llm.common import quoted, stored, without
from sondeo.llm.vocabularies import BYTE_BPE, byte_vocabulary

CAPACITY = 1024
END_ID = 2
#: Pieces leave a task in batches of about this many ids.
BATCH_IDS = 1 << 20

#: Lengths in one sequence, longest first, and how many sequences are filled like this.
Pattern = tuple[tuple[int, ...], int]


class _Instance:
    """Counts by length, with the lengths that are left in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = Counter({w: n for w, n in counts.items() if n > 0})
        self.lengths = sorted(self.counts)

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for w, n in Counter(lengths).items():
            self.counts[w] -= n * times
            if not self.counts[w]:
                del self.counts[w]
                del self.lengths[bisect_left(self.lengths, w)]

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often the set can be taken."""
        return min(self.counts[w] // n for w, n in Counter(lengths).items())

    def largest_within(self, room: int, used: tuple[int, ...]) -> int:
        """The largest length up to ``room`` of which more than those in ``used`` are left, else 0."""
        at = bisect_right(self.lengths, room)
        while at and self.counts[self.lengths[at - 1]] <= used.count(self.lengths[at - 1]):
            at -= 1
        return self.lengths[at - 1] if at else 0

    def smallest(self, n: int, used: tuple[int, ...]) -> list[int]:
        """The ``n`` smallest pieces besides ``used``, or fewer if there are no more."""
        found = []
        for w in self.lengths:
            found += [w] * min(n - len(found), self.counts[w] - used.count(w))
            if len(found) == n:
                break
        return found


def _dominating(left: _Instance, w: int, capacity: int) -> tuple[int, ...] | None:
    """A set with ``w`` that dominates all sets with it: any of them can be swapped for it without more sequences."""
    room = capacity - w
    small = left.smallest(3, (w,))
    best = left.largest_within(room, (w,))
    if not best:
        return (w,)  # nothing fits besides
    if best == room or len(small) < 2 or small[0] + small[1] > room:
        return (w, best)  # full, or no two fit: the largest single one replaces whatever is there
    if len(small) > 2 and sum(small) <= room:
        return None  # three may fit: beyond this rule
    # One or two others fit. Every single one is replaced by the largest; so is every pair that is not longer.
    second = left.largest_within(room - best, (w, best))
    for longer in left.lengths[bisect_right(left.lengths, second) :]:  # the shorter one of a pair
        if 2 * longer > room:
            break
        partner = left.largest_within(room - longer, (w, longer))
        if partner >= longer and partner + longer > best:
            return None  # this pair is neither within the largest one nor within (largest, second)
    return (w, best, second) if second else (w, best)


def reduced(left: _Instance, capacity: int) -> list[Pattern]:
    """Take dominating sets out of the instance, longest lengths first, until none is found."""
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for w in sorted(left.lengths, reverse=True):
            while left.counts[w] and (chosen := _dominating(left, w, capacity)):
                # What makes the set dominate (its own lengths are left, others only get fewer) holds this often.
                times = left.times(chosen)
                left.take(chosen, times)
                fixed.append((tuple(sorted(chosen, reverse=True)), times))
                changed = True
    return fixed


def best_fit(left: _Instance, capacity: int) -> list[Pattern]:
    """Best fit decreasing over what is left: each piece goes where the least room stays."""
    open_sets: dict[int, list[Pattern]] = defaultdict(list)  # by the room that is left
    rooms: list[int] = []

    def keep(room: int, lengths: tuple[int, ...], times: int) -> None:
        if not open_sets[room]:
            insort(rooms, room)
        open_sets[room].append((lengths, times))

    for w in sorted(left.lengths, reverse=True):
        n = left.counts[w]
        while n:
            at = bisect_left(rooms, w)
            if at == len(rooms):
                per_set = capacity // w
                if full := n // per_set:
                    keep(capacity - per_set * w, (w,) * per_set, full)
                if n % per_set:
                    keep(capacity - (n % per_set) * w, (w,) * (n % per_set), 1)
                break
            room = rooms[at]
            lengths, times = open_sets[room].pop()
            if not open_sets[room]:
                del rooms[at]
            used = min(n, times)
            if used < times:
                keep(room, lengths, times - used)
            keep(room - w, (*lengths, w), used)
            n -= used
    return [s for sets in open_sets.values() for s in sets]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """How all pieces are put together: sets of lengths and how often each is used."""
    left = _Instance(counts)
    return reduced(left, capacity) + best_fit(left, capacity)


def pieces(
    docs: DataFrame, vocabulary: str = BYTE_BPE, end_id: int = END_ID, capacity: int = CAPACITY, key: str = "doc_id"
) -> DataFrame:
    """The pieces of all documents: key, ``piece`` (from 0), ``start``, ``length`` and ``ids``.

    A document is the ids of its whole text, marks of special tokens in it included, and ``end_id``; a null or empty
    text is ``end_id`` alone. Only a longer document than ``capacity`` is cut, from its end, so that the first piece
    may be shorter. ``ids`` are unsigned little-endian 32-bit numbers. ``_task`` and ``_nth`` number the pieces of
    equal length in the task that read them. Repeated rows and null keys are documents of their own. Other columns
    are left out. An empty table gives an empty one.
    """
    if capacity < 1:
        raise ValueError("a sequence has room for one token at least")
    taken = docs.select(quoted(key).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    fields = [
        T.StructField("key", taken.schema["key"].dataType), T.StructField("piece", T.IntegerType()),
        *[T.StructField(n, T.LongType()) for n in ("start", "length")], T.StructField("ids", T.BinaryType()),
        T.StructField("_task", T.IntegerType()), T.StructField("_nth", T.LongType()),
    ]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_vocabulary(vocabulary, marks=True)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)

        def batch_of(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            at, *columns = zip(*rows)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *arrays], names=[f.name for f in fields])

        for batch in batches:
            rows, size = [], 0
            for i, text in enumerate(batch.column(1)):
                ids = np.append(*encoder.encode([text.as_py()]), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for n, (start, end) in enumerate(zip(edges, edges[1:])):
                    rows.append((i, n, start, end - start, ids[start:end].tobytes(), task, int(seen[end - start])))
                    seen[end - start] += 1
                size += len(ids)
                if size > BATCH_IDS:
                    yield batch_of(batch.column(0), rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(batch.column(0), rows)

    return taken.mapInArrow(cut, T.StructType(fields)).withColumnRenamed("key", key)


def _spans(counts: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """For each task and length, runs of its pieces with consecutive sequences and one offset."""
    slots = defaultdict(list)  # by length: (first number among all of the length, first sequence, offset)
    used, sequence = Counter(), 0
    for lengths, times in patterns:
        offset = 0
        for w in lengths:
            slots[w].append((used[w], sequence, offset))
            used[w] += times
            offset += w
        sequence += times
    tables = {w: np.array(s, dtype=np.int64) for w, s in slots.items()}
    names = ["_task", "length", "_from", "_to", "_sequence", "offset"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for task, w, start, n in zip(*(c.to_pylist() for c in batch.columns)):
                table = tables[w]
                first = int(np.searchsorted(table[:, 0], start, side="right")) - 1
                last = int(np.searchsorted(table[:, 0], start + n - 1, side="right"))
                edges = [start, *table[first + 1 : last, 0].tolist(), start + n]
                for (begin, sequence, offset), low, high in zip(table[first:last].tolist(), edges, edges[1:]):
                    rows.append((task, w, low - start, high - start, sequence + low - begin, offset))
            if rows:
                kinds = [pa.int32()] + [pa.int64()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return counts.mapInArrow(split, "_task int, length long, _from long, _to long, _sequence long, offset long")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of :func:`pieces`, with whatever columns were added, and their ``sequence_id`` and ``offset``.

    The pieces of a sequence fill it from place 0 without gaps. Sequences are numbered from 0. The pieces are
    written once; then only their counts, at most ``capacity`` numbers a task, are shuffled before the plan, which
    has as many rows as there are different ways to fill a sequence, and is made of ``capacity`` numbers at most.
    """
    kept = stored(without(pieces, "sequence_id", "offset"), "pieces")
    in_task = stored(kept.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in in_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    started = in_task.select("_task", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), "_n")
    spans = _spans(started, plan(counts, capacity))
    place_of = (F.col("_nth") >= F.col("_from")) & (F.col("_nth") < F.col("_to"))
    found = kept.join(spans, ["_task", "length"]).where(place_of)
    columns = [quoted(c) for c in kept.columns if c not in ("_task", "_nth")]
    return found.select(*columns, (F.col("_sequence") + F.col("_nth") - F.col("_from")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, vocabulary: str = BYTE_BPE, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its ``ids`` and its place: see :func:`pieces` and :func:`place`."""
    return place(pieces(docs, vocabulary, end_id, capacity), capacity)
