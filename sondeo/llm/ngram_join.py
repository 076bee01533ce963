"""Exact Jaccard self-join of documents on word shingles, with an R-tree over count vectors.

Shingles are hashed into groups; a document is the point of its group counts, and the sum of the coordinate minima of
two points bounds the overlap of the documents. Points meet in cells, one for each shingle among the quarter of a
document's shingles that are rarest in the corpus: sets similar enough share one of those. Links are verified on
the whole sets. A first round verifies neighbours of each cell; a second searches the cells that still hold several
components with the R-tree, whose bound drops whole subtrees, and verifies what survives. A large cell is searched in
tiles of two blocks of its members, a task each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondeo.llm.common import forget, scratch, stored
from sondeo.llm.components import components
from sondeo.llm.hashing import grams, mixed, words
from sondeo.workspace import broadcast_if_small

WORDS = 5
#: Similarity as a fraction: 100 * overlap >= 75 * union.
PERCENT = 75
#: A set of n shingles is counted in more than n groups, a power of two within these bounds; the tree uses fewer.
LEAST_GROUPS, MOST_GROUPS, TREE_GROUPS = 32, 1 << 16, 1 << 12
#: Counters of the corpus' shingles; they order shingles by frequency and affect speed, not results.
COUNTERS = 1 << 18
LEAF = 16
#: Members of a cell in one block; a task holds the vectors of two blocks.
BLOCK = 1024
#: Rounds in which every point of a cell tries only its nearest neighbours in other components, and how many of them.
NEAREST_ROUNDS, NEAREST = 1, 4
_D1, _D2 = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The distinct ``n``-word shingles of a text as sorted hashes; the whole sequence if it has fewer words."""
    return np.unique(grams(words((text or "").encode())[0], n))


def digest(found: np.ndarray) -> int:
    """One long for a set of shingles, the same for equal sets."""
    if not len(found):
        return 0
    parts = np.array([np.sum(mixed(found ^ _D1)), np.bitwise_xor.reduce(mixed(found + _D2)), len(found)], dtype=np.uint64)
    return int(np.sum(mixed(parts ^ np.array([1, 2, 3], dtype=np.uint64) * _D1)).astype(np.int64))


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least ``percent`` / 100; empty sets never do."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def needed(a, b, percent: int = PERCENT):
    """The least overlap with which sets of the sizes ``a`` and ``b`` are similar."""
    return -(-percent * (a + b) // (100 + percent))


def count_vector(found: np.ndarray) -> np.ndarray:
    """How many shingles of a set fall into each group; the more shingles, the more groups."""
    groups = min(max(1 << len(found).bit_length(), LEAST_GROUPS), MOST_GROUPS)
    while True:
        counts = np.bincount(((found >> np.uint64(32)) % np.uint64(groups)).astype(np.int64), minlength=groups)
        if counts.max() < 256:
            return counts.astype(np.uint8)
        groups *= 2


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """A count vector over fewer groups: groups that are alike modulo ``groups`` are one."""
    return counts.reshape(-1, groups).sum(axis=0, dtype=np.int32)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    """The sum of the coordinate minima of two count vectors: their sets share no more."""
    groups = min(len(a), len(b))
    return int(np.minimum(folded(a, groups), folded(b, groups)).sum())


class RTree:
    """Count vectors packed into leaves by size, then by their widest coordinate; nodes keep coordinate maxima."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        order = np.lexsort((points[:, int(np.argmax(points.var(axis=0)))], sizes))
        slab = np.arange(len(order)) // (LEAF * LEAF)  # within a slab of like sizes, by the coordinate
        widest = points[order][:, int(np.argmax(points.var(axis=0)))]
        order = order[np.lexsort((widest, slab))]
        self.order = order
        # Level 0 is the points; each node has its maxima, its least and largest size, and its label or -1.
        one = np.unique(labels, return_inverse=True)[1]
        self.levels = [(points[order], sizes[order], sizes[order], one[order])]
        while len(self.levels[-1][0]) > 1:
            top, low, high, label = self.levels[-1]
            starts = np.arange(0, len(top), LEAF)
            first, last = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
            mixed_below = np.minimum.reduceat(label, starts) < 0
            self.levels.append(
                (
                    np.maximum.reduceat(top, starts, axis=0), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts),
                    np.where((first == last) & ~mixed_below, first, -1),
                )
            )

    def pairs(self, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points of different labels whose bound allows them to be similar, as arrays of positions."""
        open_nodes = [(len(self.levels) - 1, 0, 0)]
        while open_nodes:
            level, i, j = open_nodes.pop()
            if level == 0:
                continue
            top, low, high, label = (x for x in self.levels[level - 1])
            a = np.arange(i * LEAF, min((i + 1) * LEAF, len(top)))
            b = np.arange(j * LEAF, min((j + 1) * LEAF, len(top)))
            bound = np.minimum(top[a][:, None, :], top[b][None, :, :]).sum(axis=2, dtype=np.int32)
            open_to = bound >= needed(low[a][:, None], low[b][None, :], percent)
            open_to &= 100 * np.minimum(high[a][:, None], high[b][None, :]) >= percent * np.maximum(low[a][:, None], low[b][None, :])
            open_to &= (label[a][:, None] != label[b][None, :]) | (label[a][:, None] < 0)
            if i == j:
                open_to &= a[:, None] <= b[None, :]
            x, y = np.nonzero(open_to)
            if level == 1:
                apart = a[x] != b[y]
                yield self.order[a[x][apart]], self.order[b[y][apart]]
            else:
                open_nodes += [(level - 1, int(p), int(q)) for p, q in zip(a[x], b[y])]


def _frequencies(docs: DataFrame, n: int) -> np.ndarray:
    """How often the corpus' shingles hit each counter: a table of fixed size, whatever the corpus."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, n_held = np.zeros(COUNTERS, dtype=np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append((shingles(text.as_py(), n) & np.uint64(COUNTERS - 1)).astype(np.int64))
                n_held += len(held[-1])
                if n_held > 4 * COUNTERS:
                    counts += np.bincount(np.concatenate(held), minlength=COUNTERS)
                    held, n_held = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=COUNTERS)
        seen = np.flatnonzero(counts)
        for start in range(0, len(seen), 1 << 16):
            part = seen[start : start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])], names=["counter", "n"])

    rows = docs.select("text").mapInArrow(counted, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(COUNTERS, dtype=np.int64)
    total[rows.counter.to_numpy()] = rows.n.to_numpy()
    return total


_DEALT = "part int, doc_id long, size long, node long, counts binary, tokens binary, nodes binary, sizes binary, times binary"
_FOUND = "kind int, doc_id long, size long, node long, counts binary, a long, b long, cell binary"


def _dealt(docs: DataFrame, parts: int, n: int, percent: int) -> DataFrame:
    """A row for each document (size and node, the digest of its set) and, by part, the rarest shingles of the sets.

    The rows of documents are dealt in turn, so that a group of copies spreads over all parts.
    """
    order = docs.sparkSession.sparkContext.broadcast(_frequencies(docs, n))  # COUNTERS longs

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, known = order.value, set()
        turn = TaskContext.get().partitionId()
        for batch in batches:
            sizes, nodes, counts, tokens, owners, own_sizes = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                found = shingles(text.as_py(), n)
                node = digest(found)
                sizes.append(len(found))
                nodes.append(node)
                counts.append(count_vector(found).tobytes() if node not in known else None)
                if len(found) and doc_id.is_valid and node not in known:  # a task sends each set once
                    known.add(node)
                    rarest = np.argsort(frequency[(found & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")
                    least = -(-percent * len(found) // 100)
                    tokens.append(found[rarest[: len(found) - least + 1]])
                    owners.append(node)
                    own_sizes.append(len(found))
            rows = len(nodes)
            none = pa.nulls(rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((np.arange(turn, turn + rows) % parts).astype(np.int32)), batch.column(0), pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()), pa.array(counts, pa.binary()), none, none, none, none,
                ],
                names=[c.split()[0] for c in _DEALT.split(", ")],
            )
            turn += rows
            if not tokens:
                continue
            token = np.concatenate(tokens)
            owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
            part = ((token >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
            by_part = np.argsort(part, kind="stable")
            token, owner, part = token[by_part], owner[by_part], part[by_part]
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            columns = {"part": [], "tokens": [], "nodes": [], "sizes": [], "times": []}
            owners, own_sizes = np.array(owners, dtype=np.int64), np.array(own_sizes, dtype=np.uint32)
            for start, end in zip(edges, [*edges[1:], len(part)]):
                who, times = np.unique(owner[start:end], return_counts=True)
                columns["part"].append(int(part[start]))
                columns["tokens"].append(token[start:end].astype(np.uint32).tobytes())
                columns["nodes"].append(owners[who].tobytes())
                columns["sizes"].append(own_sizes[who].tobytes())
                columns["times"].append(times.astype(np.uint32).tobytes())
            rows = len(edges)
            empty = pa.nulls(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns["part"], pa.int32()), empty, empty, empty, pa.nulls(rows, pa.binary()),
                    *(pa.array(columns[c], pa.binary()) for c in ("tokens", "nodes", "sizes", "times")),
                ],
                names=[c.split()[0] for c in _DEALT.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, _DEALT)


def merged_cells(cells: list[np.ndarray]) -> list[np.ndarray]:
    """Cells as fewer ones that hold every pair of nodes of the given ones.

    A cell of which at least half the nodes are in one cell already joins it; so the many shingles that a group
    of near copies shares give about one cell. The R-tree's bound deals with the pairs that come in besides.
    """
    made: list[set[int]] = []
    home: dict[int, int] = {}
    for nodes in sorted({np.sort(c).tobytes() for c in cells}, key=lambda c: (-len(c), c)):
        nodes = np.frombuffer(nodes, np.int64).tolist()
        homes = [home[x] for x in nodes if x in home]
        best = max(set(homes), key=lambda h: (homes.count(h), -h)) if homes else -1
        if 2 * homes.count(best) < len(nodes):
            best = len(made)
            made.append(set())
        made[best].update(nodes)
        for x in nodes:
            home.setdefault(x, best)
    return [np.array(sorted(m), dtype=np.int64) for m in made]


def _cells(percent: int):
    """A part's cells: neighbouring pairs of every cell (kind 1), and the cells of three and more nodes (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _FOUND.split(", ")]

        def out(kind: int, rows: int, **columns) -> pa.RecordBatch:
            empty = {c: pa.nulls(rows, pa.int64()) for c in names[1:]} | {c: pa.nulls(rows, pa.binary()) for c in ("counts", "cell")}
            return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(rows, kind, dtype=np.int32))} | empty | columns)

        parts = []
        for batch in batches:
            whole = batch.filter(batch.column("tokens").is_null())
            if whole.num_rows:
                yield out(0, whole.num_rows, doc_id=whole.column("doc_id"), size=whole.column("size"), node=whole.column("node"), counts=whole.column("counts"))
            some = batch.filter(batch.column("tokens").is_valid())
            for tokens, nodes, sizes, times in zip(*(some.column(c) for c in ("tokens", "nodes", "sizes", "times"))):
                times = np.frombuffer(times.as_py(), np.uint32)
                parts.append(
                    (
                        np.frombuffer(tokens.as_py(), np.uint32),
                        np.repeat(np.frombuffer(nodes.as_py(), np.int64), times),
                        np.repeat(np.frombuffer(sizes.as_py(), np.uint32), times),
                    )
                )
        if not parts:
            return
        token, node, size = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        order = np.argsort(token, kind="stable")
        same = token[order][1:] == token[order][:-1]
        live = np.zeros(len(order), dtype=bool)
        live[1:] |= same
        live[:-1] |= same
        order = order[live]
        order = order[np.lexsort((node[order], size[order], token[order]))]
        token, node, size = token[order], node[order].astype(np.int64), size[order].astype(np.int64)
        fresh = np.ones(len(token), dtype=bool)
        fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, size = token[fresh], node[fresh], size[fresh]
        # A cell ends where the token changes or the next size is too large for all before it.
        near = (token[1:] == token[:-1]) & (100 * size[:-1] >= percent * size[1:])
        pairs = np.unique(np.column_stack([np.minimum(node[:-1], node[1:])[near], np.maximum(node[:-1], node[1:])[near]]), axis=0)
        for start in range(0, len(pairs), 1 << 16):
            part = pairs[start : start + (1 << 16)]
            yield out(1, len(part), a=pa.array(part[:, 0]), b=pa.array(part[:, 1]))
        starts = np.flatnonzero(np.concatenate([[True], ~near])) if len(token) else np.zeros(0, dtype=np.int64)
        ends = np.append(starts[1:], len(token))
        wide = np.flatnonzero(ends - starts > 2)
        cells = [c.tobytes() for c in merged_cells([node[starts[i] : ends[i]] for i in wide])]
        for start in range(0, len(cells), 256):
            yield out(2, len(cells[start : start + 256]), cell=pa.array(cells[start : start + 256], pa.binary()))

    return run


def _sets(docs: DataFrame, nodes: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """(node, found) for the given nodes: the sets again, from the text of one document each.

    Rows that share an id or are repeated bring a set twice, or one not asked for; links found twice do no harm.
    """
    one = rows.where(F.col("doc_id").isNotNull()).join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = broadcast_if_small(one.select("doc_id").distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), n) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())],
                names=["node", "found"],
            )

    return texts.select("text").mapInArrow(made, "node long, found binary")


def _in_place(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` written in buckets of a key: what joins it by the key moves, and it stays where it is."""
    name = f"points_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    writer = writer.option("path", scratch(df.sparkSession, "points")).option("compression", "zstd")
    writer.format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def _both(pairs: DataFrame, side: DataFrame, column: str) -> DataFrame:
    """The pairs (a, b) with a column of both nodes."""
    a = side.select(F.col("node").alias("a"), F.col(column).alias("of_a"))
    b = side.select(F.col("node").alias("b"), F.col(column).alias("of_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "of_a", "of_b")


def _tested(pairs: DataFrame, test: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The pairs of :func:`_both` that pass a test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([test(x.as_py(), y.as_py()) for x, y in zip(batch.column("of_a"), batch.column("of_b"))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs whose count vectors allow them to be similar, stored."""

    def may_be(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
        return overlap_bound(x, y) >= needed(int(x.sum(dtype=np.int64)), int(y.sum(dtype=np.int64)), percent)

    return stored(_tested(_both(pairs, points, "counts"), may_be), "pairs")


def _verified(docs: DataFrame, pairs: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs that are links by their whole sets, stored."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets, path = _sets(docs, nodes, rows, n), scratch(docs.sparkSession, "sets")
    sets.write.parquet(path)
    sets = docs.sparkSession.read.schema(sets.schema).parquet(path)

    def alike(x: bytes, y: bytes) -> bool:
        return similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)

    links = stored(_tested(_both(pairs, sets, "found"), alike), "links")
    forget(docs.sparkSession, path)  # the sets are the largest table, and the links are written
    return links


def nearest(pairs: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """Of (n, 2) pairs those that are among the ``k`` of the highest relative bound of one of their points."""
    both = np.concatenate([pairs, pairs[:, ::-1]])
    order = np.lexsort((both[:, 1], -np.concatenate([bounds, bounds]), both[:, 0]))
    first = np.flatnonzero(np.concatenate([[True], both[order][1:, 0] != both[order][:-1, 0]]))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return pairs[np.unique(order[rank < k] % len(pairs))]


def _members(cells: DataFrame) -> DataFrame:
    """(cell_id, node) of the cells of all parts, stored.

    Cells of different parts that begin with the same node are mostly of the same group. Small ones, no more than a
    document has shingles, are merged again where they meet; those beyond a block are united by their first node,
    row by row, so that no task holds a large group.
    """

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell_id, cell in zip(batch.column("cell_id").to_pylist(), batch.column("cell")):
                nodes = np.frombuffer(cell.as_py(), np.int64)
                for start in range(0, len(nodes), 1 << 16):
                    part = nodes[start : start + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), cell_id)), pa.array(part)], names=["cell_id", "node"])

    met = cells.select("cell", F.substring("cell", 1, 8).alias("first"))
    large = F.length("cell") > 8 * BLOCK
    merged = met.where(~large).distinct().groupBy("first").applyInArrow(_merged_again, "cell binary").select(F.xxhash64("cell").alias("cell_id"), "cell")
    united = met.where(large).select(F.xxhash64("first").alias("cell_id"), "cell")
    rows = merged.mapInArrow(opened, "cell_id long, node long").unionByName(united.mapInArrow(opened, "cell_id long, node long").distinct())
    return stored(rows, "members")


def _tiles(members: DataFrame, labels: DataFrame, near: int | None) -> DataFrame:
    """(cell_id, i, j, node, label) for the cells with several components: the members of each tile.

    Up to ``BLOCK`` members are one tile. Of a larger cell, nodes are dealt into blocks by hash. With ``near`` a
    tile is two neighbouring blocks. Else it is a block of the nodes outside the cell's largest component with one
    of those inside, or with another one outside: every pair across components meets, and a member of the
    largest component is repeated only as often as there are blocks outside it.
    """
    labelled = members.join(labels, "node", "left").select("cell_id", "node", F.coalesce("label", "node").alias("label"))
    counts = labelled.groupBy("cell_id", "label").agg(F.count("*").alias("n"))
    several = counts.groupBy("cell_id").agg(
        F.sum("n").alias("all"), F.max("n").alias("inside"), F.max_by("label", F.struct("n", "label")).alias("largest")
    )
    several = several.where(F.col("all") > F.col("inside"))
    mark = F.xxhash64("node")

    def blocks(n: Column) -> Column:
        return F.ceil(n / F.lit(BLOCK)).cast("long")

    def tile(i: Column, j: Column) -> Column:
        return F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))

    def up_to(n: Column) -> Column:
        return F.sequence(F.lit(0).cast("long"), n - 1)

    zero = F.lit(0)
    if near:
        n = blocks(F.col("all"))
        larger = F.array(tile(F.pmod(mark, n), zero), tile(F.pmod(F.pmod(mark, n) - 1, n), zero))
    else:
        inside, outside = blocks(F.col("inside")), blocks(F.col("all") - F.col("inside"))
        own = F.pmod(mark, outside)
        larger = F.when(
            F.col("label") == F.col("largest"), F.transform(up_to(outside), lambda i: tile(i, F.pmod(mark, inside)))
        ).otherwise(
            F.concat(
                F.transform(up_to(inside), lambda j: tile(own, j)),
                F.transform(up_to(outside), lambda k: tile(F.least(own, k), -1 - F.greatest(own, k))),
            )
        )
    tiles = F.when(F.col("all") <= BLOCK, F.array(tile(zero, zero))).otherwise(larger)
    return labelled.join(several, "cell_id").select("cell_id", "node", "label", F.explode(tiles).alias("t")).select(
        "cell_id", "t.i", "t.j", "node", "label"
    )


def _searched(members: DataFrame, points: DataFrame, labels: DataFrame, percent: int, near: int | None = None) -> DataFrame:
    """Pairs over component borders that the R-tree of a tile leaves.

    With ``near`` only the pairs with one of the so many nearest neighbours of a point, by the bound.
    """

    def searched(table: pa.Table) -> pa.Table:
        node, label = (table.column(c).to_numpy() for c in ("node", "label"))
        counts = [np.frombuffer(c.as_py(), np.uint8) for c in table.column("counts")]
        groups = min(TREE_GROUPS, *map(len, counts))
        counts = np.stack([folded(c, groups) for c in counts])
        sizes = counts.sum(axis=1, dtype=np.int64)
        counts = counts.astype(np.uint8) if counts.max() < 256 else counts  # narrow numbers are compared faster
        found, kept = [np.zeros((0, 2), dtype=np.int64)], 0
        for x, y in RTree(counts, sizes, label).pairs(percent):
            found.append(np.column_stack([x, y]))
            kept += len(x)
            if near and kept > 1 << 16:  # the nearest so far
                found, kept = [_nearest_of(np.concatenate(found), counts, sizes, near)], 0
        found = np.concatenate(found)
        if near and len(found):
            found = _nearest_of(found, counts, sizes, near)
        a, b = node[found[:, 0]], node[found[:, 1]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    held = _tiles(members, labels, near).join(points, "node")
    return held.groupBy("cell_id", "i", "j").applyInArrow(searched, "a long, b long").distinct()


def _nearest_of(pairs: np.ndarray, counts: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    x, y = pairs[:, 0], pairs[:, 1]
    return nearest(pairs, np.minimum(counts[x], counts[y]).sum(axis=1, dtype=np.int64) / (sizes[x] + sizes[y]), k)


def join(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the least ``doc_id`` reachable by links) for every row.

    Two documents link when the Jaccard similarity of their sets of ``n``-word shingles is at least ``percent`` in
    a hundred. Words are runs without white space, A-Z as a-z; a text with fewer words is one shingle.

    Texts without words, null ones included, link with nothing and are their own component. Rows of equal sets are
    linked. Rows that share a ``doc_id`` are one document in the links of all its texts. Rows with a null
    ``doc_id`` link with nothing and have a null component. Extra columns are left out. An empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "ngram_cells")  # count vectors are mostly zeros: zstd halves them
    found = _dealt(docs, parts, n, percent).repartitionById(parts, "part").mapInArrow(_cells(percent), _FOUND)
    found.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    rows = found.where("kind = 0").select("doc_id", "size", "node")
    near = stored(found.where("kind = 1").select("a", "b").distinct(), "pairs")
    # Every node of a cell has a neighbour in it. Equal sets of different tasks bring equal vectors; one is taken.
    met = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    vectors = found.where("kind = 0 AND counts IS NOT NULL AND size > 0").select("node", "counts")
    points = _in_place(vectors.join(met, "node").dropDuplicates(["node"]), "node", parts)
    links = _verified(docs, _bounded(near, points, percent), rows, n, percent)
    members = _members(found.where("kind = 2"))
    # Nearest neighbours first join what belongs together, so that few pairs cross components at the end.
    tried = near
    for limit in [NEAREST] * NEAREST_ROUNDS + [None]:
        labels = stored(components(links), "labels")
        rest = stored(_searched(members, points, labels, percent, limit).join(tried, ["a", "b"], "left_anti"), "pairs")
        if not rest.isEmpty():
            tried = tried.unionByName(rest)
            rest = _bounded(rest, points, percent)
            links = links.unionByName(_verified(docs, rest, rows, n, percent))
    # Nodes of one document hang together too.
    owned = rows.where("doc_id IS NOT NULL AND size > 0").select("doc_id", "node")
    first = owned.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc_id", "a")
    owned = owned.join(first, "doc_id").select("a", F.col("node").alias("b"))
    links = links.unionByName(owned.where("a <> b"))
    labels = components(links)
    least = rows.where("doc_id IS NOT NULL AND size > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    grown = least.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "least")
    by_label = grown.groupBy("label").agg(F.min("least").alias("component_id"))
    known = stored(grown.join(by_label, "label").select(F.col("node").alias("_node"), "component_id"), "components")
    alone = F.col("size") == 0
    return (
        rows.join(known, (rows["node"] == known["_node"]) & ~alone & F.col("doc_id").isNotNull(), "left")
        .select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def _merged_again(table: pa.Table) -> pa.Table:
    members = merged_cells([np.frombuffer(c.as_py(), np.int64) for c in table.column("cell")])
    return pa.table({"cell": pa.array([m.tobytes() for m in members], pa.binary())})


def representatives(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps its least document; rows without an id stay."""
    gone = join(docs, n, percent).where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(stored(gone, "copies"), "doc_id", "left_anti").select(*docs.columns)
