"""Alignment of two tokenizers over a corpus: which ids of one stand where ids of the other do.

Texts are shuffled whole, so that each distinct one is encoded and aligned once, with the number of its copies. The
byte offsets where tokens of both sides end cut a text into groups; every token of a group is linked with every token
of the other side in it. The count of an id pair is the number of documents that hold it linked: distinct texts
weighted by their copies. The measures of a text are joined back to the documents that have it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeo.llm.common import quoted, stored
from sondeo.llm.vocabularies import BYTE_BPE, PIECE_BPE, byte_vocabulary, piece_vocabulary

#: Texts are encoded and aligned in batches of about this many bytes, links listed by this many.
BATCH_BYTES = 1 << 20
LINKS_AT_ONCE = 1 << 21
#: In groups of more links than this, equal ids are taken together.
WIDE = 256
#: A task sends the counts of its id pairs when it has gathered this many.
PAIRS_AT_ONCE = 1 << 20
#: At most this many id pairs with their counts are broadcast at once, 24 bytes each; more go in ranges of A ids.
PAIRS_IN_BLOCK = 1 << 21
#: A text with more than this share of all rows is hot; its measures are broadcast, at most 1 / HOT_SHARE rows.
HOT_SHARE = 0.001
_MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@cache
def _tokens(byte_bpe: str, piece_bpe: str) -> tuple:
    """Both vocabularies, the lengths in bytes of their tokens, and their ids as text with each separator."""
    sides = byte_vocabulary(byte_bpe), piece_vocabulary(piece_bpe)
    lengths = [np.array([len(b) for b in s.token_bytes], dtype=np.int64) for s in sides]
    largest = max(len(n) for n in lengths)
    spelled = np.array([f"{i}{mark}" for mark in ",|;" for i in range(largest)] + [str(i) for i in range(largest)], dtype=object)
    return sides, lengths, spelled, largest


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


class Aligned:
    """Tokens of several texts, one after the other, cut into groups that no text border crosses.

    ``a``, ``b``: ids; ``group_a``, ``group_b``: the group of each token; ``text_of``: the text of each group.
    """

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], lengths: list[np.ndarray]):
        self.n_texts = len(a)
        self.n_a, self.n_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (a, b))
        self.a, self.b = (np.concatenate([*side, np.zeros(0, np.uint32)]).astype(np.int64) for side in (a, b))
        ends_a, ends_b = np.cumsum(lengths[0][self.a]), np.cumsum(lengths[1][self.b])
        # Both sides have the same bytes, so the end of a text is an end on both.
        self.group_a, last_a = _groups(ends_a, ends_b)
        self.group_b, _ = _groups(ends_b, ends_a)
        self.n_groups_all = last_a
        self.size_a = np.bincount(self.group_a, minlength=self.n_groups_all)
        self.size_b = np.bincount(self.group_b, minlength=self.n_groups_all)
        last = np.cumsum(self.n_a)[self.n_a > 0] - 1  # the last token of each text that has any
        upto = self.group_a[last]
        with_tokens = np.flatnonzero(self.n_a > 0)
        self.text_of = np.repeat(with_tokens, np.diff(upto, prepend=-1))

    def by_text(self, of_group: np.ndarray) -> np.ndarray:
        return np.bincount(self.text_of, weights=of_group, minlength=self.n_texts).astype(np.int64)

    def spelled(self, table: np.ndarray, largest: int) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        # A's ids of a group stand before B's: shift each by what the other side has before it.
        at_a = np.arange(len(self.a)) + _starts(self.size_b)[self.group_a]
        at_b = np.arange(len(self.b)) + np.cumsum(self.size_a)[self.group_b]
        codes = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        last_a, last_b = np.append(np.diff(self.group_a) > 0, True), np.append(np.diff(self.group_b) > 0, True)
        codes[at_a] = self.a + np.where(last_a[: len(self.a)], 1, 0) * largest
        codes[at_b] = self.b + np.where(last_b[: len(self.b)], 2, 0) * largest
        ends = np.cumsum(self.n_a + self.n_b)
        final = ends[self.n_a > 0] - 1
        codes[final] += largest  # the last of a text: from ; to nothing
        words = table[codes].tolist()
        return ["".join(words[e - n : e]) for e, n in zip(ends.tolist(), (self.n_a + self.n_b).tolist())]

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, A id, B id, links) in parts; all links of one (text, A id) are in one part, some pairs repeat there.

        Equal ids of a wide group are taken together first, so a part has about ``LINKS_AT_ONCE`` entries, or, if
        that is more, as many as the tokens of one text that equal one A id have in their groups.
        """
        wide = self.size_a * self.size_b > WIDE
        group_a, id_a, n_a = _runs(self.group_a, self.a, wide)
        group_b, id_b, n_b = _runs(self.group_b, self.b, wide)
        per_group = np.bincount(group_b, minlength=self.n_groups_all)
        first_b = _starts(per_group)
        text, width = self.text_of[group_a], per_group[group_a]
        upto = np.cumsum(width)
        if len(upto) and upto[-1] > LINKS_AT_ONCE:  # several parts: bring the tokens of a (text, A id) together
            order = np.argsort((text << 32) | id_a, kind="stable")
            group_a, id_a, n_a, text, width = (x[order] for x in (group_a, id_a, n_a, text, width))
            upto = np.cumsum(width)
            cuts = np.append(np.flatnonzero((np.diff(text) != 0) | (np.diff(id_a) != 0)) + 1, len(text))
        else:
            cuts = np.array([len(text)])
        start = 0
        while start < len(group_a):
            before = upto[start - 1] if start else 0
            fits = int(np.searchsorted(upto, before + LINKS_AT_ONCE, side="right"))
            at = np.searchsorted(cuts, fits, side="right") - 1
            end = int(cuts[at]) if at >= 0 else 0
            if end <= start:  # one (text, A id) alone is longer
                end = int(cuts[np.searchsorted(cuts, start, side="right")])
            w = width[start:end]
            mine = np.repeat(np.arange(start, end), w)
            theirs = np.arange(len(mine)) - np.repeat(_starts(w) - first_b[group_a[start:end]], w)
            yield text[mine], id_a[mine], id_b[theirs], n_a[mine] * n_b[theirs]
            start = end


def _groups(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, int]:
    """The group of each token by the ends of both sides, and the number of groups; a shared end closes a group."""
    size = int(own[-1]) + 1 if len(own) else 0
    marked = np.zeros(size, dtype=bool)
    marked[other] = True
    shared = marked[own]
    # Of several tokens that end at one place (tokens without bytes) the last closes the group.
    shared &= np.append(np.diff(own) > 0, True)[: len(own)]
    closed = np.cumsum(shared)
    return closed - shared, int(closed[-1]) if len(closed) else 0


def _runs(group: np.ndarray, ids: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, how often), by group; equal ids are taken together in ``wide`` groups."""
    if not wide.any():
        return group, ids, np.ones(len(ids), dtype=np.int64)
    large = wide[group]
    code, n = np.unique((group[large] << 32) | ids[large], return_counts=True)
    groups = np.concatenate([group[~large], code >> 32])
    order = np.argsort(groups, kind="stable")
    found = np.concatenate([ids[~large], code & 0xFFFFFFFF]), np.concatenate([np.ones((~large).sum(), dtype=np.int64), n])
    return groups[order], *(x[order] for x in found)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << 32) | b


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(codes, return_inverse=True)
    return found, np.bincount(at, weights=n, minlength=len(found)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], sized: str) -> Iterator[pa.RecordBatch]:
    """The batches cut where the lengths of column ``sized`` add up to ``BATCH_BYTES``; a longer row stays whole."""
    import pyarrow.compute as pc

    for batch in batches:
        upto = np.cumsum(np.asarray(pc.binary_length(batch.column(sized)), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, before + BATCH_BYTES, side="right")))
            yield batch.slice(start, end - start)
            start = end


def _encoded(texts: list[str], sides: tuple) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids of both sides; none on either for an empty text or one whose tokens do not give its bytes."""
    spaced = [" " + t for t in texts]
    raw = [t.encode() for t in spaced]
    found = [sides[0].encode(spaced), sides[1].encode(texts)]
    whole = np.array([len(r) > 1 for r in raw])
    for side, ids in zip(sides, found):
        whole &= _spelled_out(ids, side.token_bytes, raw)
    none = np.zeros(0, dtype=np.uint32)
    return tuple([x if keep else none for x, keep in zip(ids, whole)] for ids in found)


def _spelled_out(ids: list[np.ndarray], token_bytes: list[bytes], raw: list[bytes]) -> np.ndarray:
    """Whether the bytes of the ids of a text are the bytes of the text."""
    return np.array([b"".join(map(token_bytes.__getitem__, x.tolist())) == r for x, r in zip(ids, raw)])


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype="<u4") for x in column]


def aligned_texts(texts: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """Per row of ``texts`` (text_key, text, copies): ids of both sides, and what its groups are alone."""
    names = ["text_key", "copies", "a_ids", "b_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, lengths, spelled, largest = _tokens(byte_bpe, piece_bpe)
        for batch in _chunks(batches, "text"):
            a, b = _encoded(batch.column("text").to_pylist(), sides)
            groups = Aligned(a, b, lengths)
            digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in groups.spelled(spelled, largest)]
            found = [groups.n_a, groups.n_b, groups.by_text(np.ones(groups.n_groups_all)), groups.by_text(groups.size_a * groups.size_b)]
            ids = [pa.array([x.astype("<u4").tobytes() for x in side], pa.binary()) for side in (a, b)]
            columns = [batch.column("text_key"), batch.column("copies"), *ids, *map(pa.array, found), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = ["binary", "long", "binary", "binary", "long", "long", "long", "long", "string"]
    return texts.mapInArrow(aligned, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def pair_counts(aligned: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """(a, b, n): in how many documents the ids are linked. Tasks add up their own pairs before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _tokens(byte_bpe, piece_bpe)[1]
        codes, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def added() -> tuple[np.ndarray, np.ndarray]:
            both = [(codes, n), *waiting]
            waiting.clear()
            return _summed(np.concatenate([c for c, _ in both]), np.concatenate([m for _, m in both]))

        def rows() -> pa.RecordBatch:
            columns = [pa.array(x) for x in (*np.divmod(codes, len(lengths[1])), n)]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "n"])

        for batch in _chunks(batches, "a_ids"):
            copies = np.asarray(batch.column("copies"), dtype=np.int64)
            for text, a, b, _ in Aligned(_ids(batch.column("a_ids")), _ids(batch.column("b_ids")), lengths).links():
                code = np.unique((text * len(lengths[0]) + a) * len(lengths[1]) + b)  # once for each text
                text, pair = np.divmod(code, len(lengths[0]) * len(lengths[1]))
                waiting.append(_summed(pair, copies[text]))
                if sum(len(c) for c, _ in waiting) > PAIRS_AT_ONCE:
                    codes, n = added()
                    if len(codes) > PAIRS_AT_ONCE:
                        yield rows()
                        codes, n = codes[:0], n[:0]
        codes, n = added()
        if len(codes):
            yield rows()

    found = aligned.select("copies", "a_ids", "b_ids").mapInArrow(counted, "a long, b long, n long")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _blocks(spark: SparkSession, counts: DataFrame) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges of A ids with their pairs, counts and whether the count is the highest of the A id, one at a time.

    A range has ``PAIRS_IN_BLOCK`` pairs at most, or the pairs of one A id, which the other vocabulary bounds.
    """
    sizes = counts.groupBy("a").agg(F.count(F.lit(1)).alias("pairs"), F.max("n").alias("most"))
    sizes = stored(sizes, "most-linked")
    ranges, low, held = [], 0, 0
    for a, pairs in sorted(tuple(r) for r in sizes.select("a", "pairs").collect()):  # one row per A id: bounded
        if held and held + pairs > PAIRS_IN_BLOCK:
            ranges.append((low, a))
            low, held = a, 0
        held += pairs
    ranges.append((low, 1 << 31))
    best = counts.join(sizes.select("a", "most"), "a")
    for low, high in ranges:
        part = best.where((F.col("a") >= low) & (F.col("a") < high)).select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
        found = part.toArrow()
        code = _pairs(*(np.asarray(found.column(c), dtype=np.int64) for c in ("a", "b")))
        order = np.argsort(code)
        yield low, high, code[order], np.asarray(found.column("n"), dtype=np.int64)[order], np.asarray(found.column("best"))[order]


def _judged(aligned: DataFrame, block: tuple, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """(text_key, n_best, count_sum) of the links whose A id is in the range of the block."""
    low, high, *table = block
    shared = aligned.sparkSession.sparkContext.broadcast(table)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _tokens(byte_bpe, piece_bpe)[1]
        code, counts, is_best = shared.value
        for batch in _chunks(batches, "a_ids"):
            groups = Aligned(_ids(batch.column("a_ids")), _ids(batch.column("b_ids")), lengths)
            n_best, count_sum = (np.zeros(groups.n_texts, dtype=np.int64) for _ in range(2))
            for text, a, b, n in groups.links():
                inside = (a >= low) & (a < high)
                text, n = text[inside], n[inside]
                at = np.searchsorted(code, _pairs(a[inside], b[inside]))
                np.add.at(n_best, text, n * is_best[at])
                np.add.at(count_sum, text, n * counts[at])
            columns = [batch.column("text_key"), pa.array(n_best), pa.array(count_sum)]
            yield pa.RecordBatch.from_arrays(columns, names=["text_key", "n_best", "count_sum"])

    return aligned.select("text_key", "a_ids", "b_ids").mapInArrow(judged, "text_key binary, n_best long, count_sum long")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256)).alias("text_key")


def align(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: the key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and
    ``groups_sha256``.

    Texts are encoded whole, with a space before them, marks of special tokens as plain text. A text that is null or
    empty, or whose tokens on either side do not give its bytes, has no tokens: zeros and an empty digest.
    ``n_best`` counts the links whose pair has the highest count of its A id, ties included, ``count_sum`` adds up
    the counts over the links. Repeated rows and null keys are documents of their own. Other columns are left out.
    An empty table gives an empty one.

    Copies of a text count once in the shuffle and the encoding. The measures of a text with many copies reach its
    documents by a broadcast of at most 1 / ``HOT_SHARE`` rows, the others by a join on the digest of the text.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    with_key = docs.select(quoted(key).alias(key), _digest(text), text.alias("text"))
    texts = with_key.groupBy("text").agg(F.count(F.lit(1)).alias("copies")).select(_digest(F.col("text")), "copies", "text")
    aligned = stored(aligned_texts(texts, byte_bpe, piece_bpe), "aligned")
    counts = stored(pair_counts(aligned, byte_bpe, piece_bpe), "pair-counts")
    parts = [stored(_judged(aligned, block, byte_bpe, piece_bpe), "judged") for block in _blocks(spark, counts)]
    judged = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            judged = judged.unionByName(part)
        judged = judged.groupBy("text_key").agg(*[F.sum(c).alias(c) for c in ("n_best", "count_sum")])
    measures = aligned.drop("a_ids", "b_ids").join(judged, "text_key")
    rows = aligned.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    is_hot = F.col("copies") > max(1, HOT_SHARE * rows)
    columns = [quoted(key), *_MEASURES, "groups_sha256"]
    slim = with_key.select(quoted(key), "text_key")
    hot = F.broadcast(measures.where(is_hot).drop("copies"))
    marked = slim.join(hot, "text_key", "left")
    common = marked.where(F.col("n_a").isNull()).select(quoted(key), "text_key").join(measures.where(~is_hot), "text_key")
    return marked.where(F.col("n_a").isNotNull()).select(*columns).unionByName(common.select(*columns))
