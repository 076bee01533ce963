"""Mixing of sources to target weights by Pfair scheduling.

Time is counted in slots of one block. A source of weight w releases its i-th block (from 0) at floor(i / w) and wants
it by ceil((i + 1) / w); among the released blocks the earliest deadline goes first. Weights are exact fractions and the
schedule is laid out as far as the sources' blocks go, so no rounding of a weight adds up over the slots. Where no block
is released the slots stay empty, and the schedule goes on at the next release: its steps are the blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice
from math import lcm

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.llm.common import numbered, quoted, stored, without

#: Documents of a block. The one task that lays out the schedule has a step for each block and keeps a block per source.
BLOCK_ROWS = 16
CELLS = 256
#: Rows of the schedule that are handed on at a time.
LAID_ROWS = 50_000
LAST_SLOT = 2**48
_NULL = "\0null"


def _whole(weights: Mapping[str, float]) -> dict[str, int]:
    """Positive weights as whole numbers in the same proportions, as written in decimals."""
    exact = {s: Fraction(repr(float(w))) for s, w in sorted(weights.items()) if w > 0}
    unit = lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * unit) for s, w in exact.items()}


def laid_out(weights: Mapping[str, float], blocks: Mapping[str, int]) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) of as many blocks as each source has, by slot.

    Sources without a positive weight follow, one after the other. Slots that do not fit a long, as a weight of 1e-30
    makes them, are refused.
    """
    whole = _whole(weights)
    total = sum(whole.values())
    waiting = [(0, s, 0) for s in whole if blocks.get(s)]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    now = 0
    while waiting or ready:
        if not ready:
            now = max(now, waiting[0][0])
        while waiting and waiting[0][0] <= now:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // whole[s]), s, i))
        _, s, i = heapq.heappop(ready)
        if now >= LAST_SLOT:
            raise ValueError(f"the weight of source {s!r} is too small beside the others'")
        yield s, i, now
        now += 1
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, ((i + 1) * total // whole[s], s, i + 1))
    rest = ((s, i) for s in sorted(blocks.keys() - whole.keys()) for i in range(blocks[s]))
    yield from ((s, i, now + n) for n, (s, i) in enumerate(rest))


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    block_rows: int = BLOCK_ROWS,
    cells: int = CELLS,
) -> DataFrame:
    """``docs`` with ``block`` (number in its source), ``slot`` and ``mix_order``, the order of the mixture.

    Blocks are ``block_rows`` documents of a source, in an order by hash of ``doc_id``. While every source has
    blocks left, each source's blocks in the first t slots differ from t times its exact weight by less than one,
    however many slots there are; when a source ends, its slots are free to blocks of others that are released, and
    the others' deviations stay below one. No document is dropped. The schedule is laid out in one task from a table
    of one row per source, and stored; it has a row for each block, so ``block_rows`` bounds it.

    ``weights`` are by source (None for a null source), by default the square roots of the sources' rows; sources
    without a positive weight come after the rest of the mixture, one source after the other. Repeated rows and equal
    ids each take a place; ties of ``doc_id`` are ordered by a hash of the text. Null ids come first within their
    piece. Input columns called block, slot or mix_order are replaced. An empty table gives an empty one.
    """
    docs = without(docs, "block", "slot", "mix_order")
    names = [quoted(c) for c in docs.columns]
    source = F.coalesce(F.col("source"), F.lit(_NULL)).alias("_source")
    given = weights and {_NULL if s is None else s: w for s, w in weights.items()}

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = {s: n for batch in batches for s, n in zip(batch["_source"], batch["count"].tolist())}
        targets = {s: n**0.5 for s, n in rows.items()} if given is None else given
        laid = laid_out(targets, {s: -(-n // block_rows) for s, n in rows.items()})
        while some := list(islice(laid, LAID_ROWS)):
            yield pd.DataFrame(some, columns=["_source", "block", "slot"])

    sources = stored(docs.groupBy(source).count(), "sources")  # one row per source
    plan = sources.coalesce(1).mapInPandas(lay, "_source string, block long, slot long")
    key = F.xxhash64("doc_id")
    marked = docs.select(
        *names,
        source,
        F.pmod(key, F.lit(cells)).alias("_cell"),
        key.alias("_key"),
    )
    placed = numbered(marked, ["_source"], "_cell", [F.col("_key"), F.col("doc_id"), F.xxhash64("text")], "_n")
    block = F.floor(F.col("_n") / block_rows).cast("long")
    placed = placed.withColumn("block", block).join(stored(plan, "schedule"), ["_source", "block"])
    return placed.select(
        *names, "block", "slot",
        (F.col("slot") * block_rows + F.pmod("_n", F.lit(block_rows))).cast("long").alias("mix_order"),
    )


def write_order(mixed: DataFrame) -> DataFrame:
    """The rows of :func:`mix` in files by ``mix_order``, without the columns it added."""
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(n, "mix_order").sortWithinPartitions("mix_order").drop("block", "slot", "mix_order")
