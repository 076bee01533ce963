"""Document fingerprints from prefix polynomial hashes.

The hash of a prefix is the sum of its code points times powers of a base, modulo a prime; differences of two prefix
hashes answer any span. A fingerprint keeps the hashes of prefixes and suffixes at lengths that grow geometrically, so
two fingerprints locate the longest common extensions from both ends by binary search. It also keeps the prefix hashes
at cuts that the text itself chooses: their differences answer the spans between cuts wherever these stand, so that the
texts meet again after each difference.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.llm.hashing import mixed

#: Two primes with a base each: a hash is a pair.
MODULI = ((2**31 - 1, 1_103_515_245), (2**31 - 19, 1_566_083_941))
#: Code points (21 bits) times powers (31 bits) of a row this long can be summed in 64 bits.
_ROW = 1 << 11
_ROWS_AT_ONCE = 1 << 9
GROWTH = 1.19
#: A cut stands before a window of this many code points whose hash ends in as many zero bits as leave at most MOST_CUTS.
WINDOW = 8
LEAST_ZEROS = 3
MOST_CUTS = 128
_SCAN = 1 << 20
_WINDOW_BASE = 0x9E3779B97F4A7C15


def _grid(limit: int = 2**40) -> np.ndarray:
    lengths = [1]
    while lengths[-1] < limit:
        lengths.append(max(lengths[-1] + 1, int(lengths[-1] * GROWTH)))
    return np.array(lengths, dtype=np.int64)


GRID = _grid()


class Powers:
    """Powers of a base modulo a prime at any exponents: one table for the low bits and one for the rows."""

    def __init__(self, base: int, prime: int):
        self.prime = prime
        self.low = np.array([1], dtype=np.uint64)
        while len(self.low) < _ROW:
            self.low = np.concatenate([self.low, self.low * np.uint64(pow(base, len(self.low), prime)) % np.uint64(prime)])
        self.step = pow(base, _ROW, prime)
        self.rows = np.array([1], dtype=np.uint64)

    def row(self, n: int) -> np.ndarray:
        """The powers at the starts of the first ``n`` rows or more."""
        while len(self.rows) < n:
            more = np.uint64(pow(self.step, len(self.rows), self.prime))
            self.rows = np.concatenate([self.rows, self.rows * more % np.uint64(self.prime)])
        return self.rows

    def at(self, exponents: np.ndarray) -> np.ndarray:
        if not len(exponents):
            return np.zeros(0, dtype=np.uint64)
        rows = self.row(int(exponents.max()) // _ROW + 1)
        return rows[exponents // _ROW] * self.low[exponents % _ROW] % np.uint64(self.prime)


_FORWARD = [Powers(b, p) for p, b in MODULI]
_INVERSE = [Powers(pow(b, -1, p), p) for p, b in MODULI]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def prefix_hashes(codes: np.ndarray, points: np.ndarray, which: int) -> np.ndarray:
    """The hashes of the prefixes of the lengths ``points`` (ascending); memory does not grow with the text."""
    power = _FORWARD[which]
    prime = np.uint64(power.prime)
    found, before = np.zeros(len(points), dtype=np.uint64), np.uint64(0)
    width = _ROW * _ROWS_AT_ONCE
    for start in range(0, max(len(codes), 1), width):
        part = codes[start : start + width].astype(np.uint64) + np.uint64(1)
        n_rows = -(-len(part) // _ROW)
        if len(part) % _ROW and n_rows > 1:
            part = np.concatenate([part, np.zeros(n_rows * _ROW - len(part), dtype=np.uint64)])
        table = part.reshape(n_rows, -1) if n_rows else part.reshape(0, 1)
        sums = np.cumsum(table * power.low[: table.shape[1]], axis=1)
        scale = power.row(start // _ROW + n_rows)[start // _ROW : start // _ROW + n_rows]
        totals = sums[:, -1] % prime * scale % prime if n_rows else np.zeros(0, dtype=np.uint64)
        ahead = np.concatenate([[before], before + np.cumsum(totals)]).astype(np.uint64) % prime
        here = (points > start) & (points <= start + width)
        if start == 0:
            here |= points == 0
        at = points[here] - start
        row, rest = (at - 1) // _ROW, (at - 1) % _ROW
        inside = np.where(at > 0, sums[np.maximum(row, 0), rest * (at > 0)] if n_rows else 0, 0).astype(np.uint64) % prime
        scales = scale[np.maximum(row, 0)] if n_rows else np.zeros(len(at), dtype=np.uint64)
        found[here] = np.where(at > 0, (ahead[np.maximum(row, 0)] + inside * scales) % prime, 0)
        before = ahead[-1]
    return found


class PrefixHashes:
    """All prefix hashes of a text in memory: span equality and longest common extensions."""

    def __init__(self, text: str):
        codes = code_points(text)
        self.length = len(codes)
        self.prefix = [prefix_hashes(codes, np.arange(self.length + 1), w) for w in range(len(MODULI))]

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """The same for equal spans wherever they stand, and different for others but for a chance of 2^-60."""
        return tuple(
            int((int(h[end]) - int(h[start])) * int(_INVERSE[w].at(np.array([start]))[0]) % MODULI[w][0])
            for w, h in enumerate(self.prefix)
        )

    def same(self, start: int, end: int, other: PrefixHashes, other_start: int) -> bool:
        return self.span(start, end) == other.span(other_start, other_start + end - start)

    def common_extension(self, start: int, other: PrefixHashes, other_start: int) -> int:
        """How far the texts agree from the two positions on, by binary search."""
        low, high = 0, min(self.length - start, other.length - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(start, start + middle, other, other_start):
                low = middle
            else:
                high = middle - 1
        return low


def cuts_of(codes: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The zero bits asked for, the cuts, and the zero bits of each; memory does not grow with the text."""
    level, places, zeros = LEAST_ZEROS, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for start in range(1, len(codes) - WINDOW + 1, _SCAN):
        part = codes[start : start + _SCAN + WINDOW - 1].astype(np.uint64)
        n = len(part) - WINDOW + 1
        total = np.zeros(n, dtype=np.uint64)
        for j in range(WINDOW):
            total = total * np.uint64(_WINDOW_BASE) + part[j : j + n]
        total = mixed(total)
        at = np.flatnonzero((total & np.uint64((1 << level) - 1)) == 0)
        low = total[at] & (~total[at] + np.uint64(1))
        bits = np.where(low > 0, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)), 64).astype(np.int64)
        places, zeros = np.concatenate([places, at + start]), np.concatenate([zeros, bits])
        if len(places) > MOST_CUTS:
            level = int(np.sort(zeros)[-MOST_CUTS - 1]) + 1
            places, zeros = places[zeros >= level], zeros[zeros >= level]
    return level, places, zeros


def fingerprint(codes: np.ndarray) -> str:
    """Length, hash of the whole, the hashes of prefixes and of suffixes at the grid's lengths, then the cuts, in hex."""
    n = len(codes)
    grid = GRID[: np.searchsorted(GRID, n, side="right")]
    level, cuts, zeros = cuts_of(codes)
    points = np.concatenate([grid, n - grid, [n], cuts])
    order = np.unique(points)
    where = np.searchsorted(order, points)
    ends = 2 * len(grid)
    whole, at_cuts, folded = [], None, np.zeros(ends, dtype=np.uint64)
    for w, (prime, _) in enumerate(MODULI):
        h = prefix_hashes(codes, order, w)[where]
        prefix, before, full = h[: len(grid)], h[len(grid) : ends], h[ends]
        p = np.uint64(prime)
        suffix = (full + p - before) % p * _INVERSE[w].at(n - grid) % p
        whole.append(int(full))
        both = np.concatenate([prefix, suffix])
        folded ^= both if w == 0 else both * np.uint64(0x9E3779B1)
        at_cuts = h[ends + 1 :] if w == 0 else at_cuts
    parts = folded.astype(np.uint32).astype(">u4")
    marks = cuts.astype(">u4").tobytes() + at_cuts.astype(">u4").tobytes() + zeros.astype(np.uint8).tobytes()
    return (
        f"{n:x}.{whole[0]:08x}{whole[1]:08x}.{parts[: len(grid)].tobytes().hex()}.{parts[len(grid) :].tobytes().hex()}"
        f".{level:02x}{marks.hex()}"
    )


def _agreement(a: str, b: str) -> int:
    """The largest length of the grid at which two lists of hashes agree, by binary search."""
    low, high = 0, min(len(a), len(b)) // 8
    while low < high:
        middle = (low + high + 1) // 2
        if a[8 * middle - 8 : 8 * middle] == b[8 * middle - 8 : 8 * middle]:
            low = middle
        else:
            high = middle - 1
    return int(GRID[low - 1]) if low else 0


def _spans(n: int, whole: str, cuts: str, level: int) -> list[tuple[int, int, int]]:
    """(begin, end, hash) of the spans between the cuts of at least ``level`` zero bits and the ends of the text."""
    raw = bytes.fromhex(cuts[2:])
    k = len(raw) // 9
    kept = np.frombuffer(raw, np.uint8, k, 8 * k) >= level
    at = np.concatenate([[0], np.frombuffer(raw, ">u4", k).astype(np.int64)[kept], [n]]).astype(np.int64)
    h = np.concatenate([[0], np.frombuffer(raw, ">u4", k, 4 * k).astype(np.int64)[kept], [int(whole[:8], 16)]])
    p = np.uint64(MODULI[0][0])
    spans = (h[1:].astype(np.uint64) + p - h[:-1].astype(np.uint64)) % p * _INVERSE[0].at(at[:-1]) % p
    return list(zip(at[:-1].tolist(), at[1:].tolist(), spans.tolist()))


def _shared(own: list[tuple[int, int, int]], other: list[tuple[int, int, int]], low: int, high: int) -> int:
    """Code points from ``low`` to ``high`` in spans that the other text has too, each of its spans taken once."""
    left, total = Counter((end - begin, h) for begin, end, h in other), 0
    for begin, end, h in own:
        if left[end - begin, h] > 0:
            left[end - begin, h] -= 1
            total += max(0, min(end, high) - max(begin, low))
    return total


def likeness(a: str, b: str) -> float:
    """The part of the longer text that is covered, from below; 1 for equal texts only.

    Covered are the common prefix, the common suffix, and between them the spans between cuts that both texts have,
    also in another order. A difference costs about the two spans beside it, a thirtieth of the text or less on
    average where the text has the 64 to 128 cuts of a long one.
    """
    if a == b:
        return 1.0
    (n, whole, prefix, suffix, cuts), (m, other_whole, other_prefix, other_suffix, other_cuts) = a.split("."), b.split(".")
    n, m = int(n, 16), int(m, 16)
    front = _agreement(prefix, other_prefix)
    back = min(_agreement(suffix, other_suffix), min(n, m) - front)
    level = max(int(cuts[:2], 16), int(other_cuts[:2], 16))
    own, other = _spans(n, whole, cuts, level), _spans(m, other_whole, other_cuts, level)
    between = min(_shared(own, other, front, n - back), _shared(other, own, front, m - back))
    return min(front + back + between, max(n, m) - 1) / max(n, m)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ]
)
_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order (doc_id, text, borrowed): each with the next; borrowed ones end the piece."""
    last, rows = None, []

    def row(held: tuple[int | None, str, str], text: str, mark: str) -> tuple:
        changed = edited(held[1], text)
        changed_mark = fingerprint(code_points(changed))
        return (
            held[0], len(held[1]), hashlib.sha256(changed.encode()).hexdigest(), held[2], changed_mark,
            likeness(held[2], changed_mark), likeness(held[2], mark),
        )

    for batch in batches:
        for doc_id, text, borrowed in zip(*(c.to_pylist() for c in batch.columns)):
            if last is None and borrowed:
                continue
            mark = fingerprint(code_points(text))
            if last is not None:
                rows.append(row(last, text, mark))
            last = None if borrowed else (doc_id, text, mark)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RESULT.types)], schema=_RESULT)
            rows = []


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint each text and its edited version, in which the next document's text replaces the last half.

    Documents follow each other by ascending ``doc_id``, the first again after the last. They are dealt into
    ranges of ids; the first document of each range is lent to the range before, so neighbours meet without a
    single task over all rows.

    A null text is empty. Ties of ``doc_id`` follow each other by text, null ids come first; repeated rows are
    repeated in the result. A single row is its own next. Extra columns are left out. An empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.agg(
        F.min("doc_id").alias("least"),
        F.percentile_approx("doc_id", [i / pieces for i in range(1, pieces)] or [0.5], 100 * pieces).alias("cuts"),
        F.count_if(F.col("doc_id").isNull()).alias("nulls"),
    ).first()
    cuts = np.array(sorted({found["least"], *(found["cuts"] or [])} - {None}), dtype=np.int64)
    n, nulls = max(1, len(cuts)), found["nulls"] > 0

    @F.pandas_udf("int")
    def piece(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        at = np.searchsorted(cuts, ids[known].astype("int64"), side="right") - 1
        out = np.zeros(len(ids), dtype=np.int32)
        out[known.to_numpy()] = at
        return pd.Series(out)

    @F.pandas_udf("boolean")
    def leads(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        first = np.full(len(ids), nulls)
        first[known.to_numpy()] = np.isin(ids[known].astype("int64"), cuts[1:] if nulls else cuts)
        return pd.Series(first)

    own = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), piece("doc_id").alias("_piece"), leads("doc_id").alias("_leads"))
    lent = F.when(F.col("_leads"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = own.select("doc_id", "text", "_piece", F.explode(lent).alias("_lent")).select(
        "doc_id", "text", F.col("_lent"), F.pmod(F.col("_piece") - F.col("_lent"), F.lit(n)).alias("_to")
    )
    return (
        dealt.repartitionById(n, "_to")
        .sortWithinPartitions("_lent", F.asc_nulls_first("doc_id"), "text")
        .select("doc_id", "text", (F.col("_lent") == 1).alias("borrowed"))
        .mapInArrow(_compared, _SCHEMA)
    )
