"""Importance resampling towards a target: documents that look like the target's texts are drawn more often.

Every text is a bag of hashed n-grams. A 256-byte table lower-cases A-Z and blanks the separators, so that
``bytes.split`` gives the words; the checksum of an n-gram is that of the shorter one, continued; ``Counter`` reduces
the buckets. The gain of a bucket is the logarithm of how much more frequent it is in the target than in the corpus,
a document's weight is the sum of gains over its features, and Gumbel noise turns the highest scores into a draw
without replacement.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import accumulate
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondeo.llm.common import quoted, stored, without

BUCKETS = 10_000
LONGEST = 3
SCALE = 1000
#: A text is split in blocks of about this many bytes.
BLOCK = 1 << 20
#: Approximate quantiles are off by at most this share of the rows.
QUANTILE_ERROR = 0.0005
#: The drawn rows are numbered in this many ranges of score.
RANGES = 512


def _word_table() -> bytes:
    """A-Z become a-z; all other ASCII but digits and a-z become a blank; bytes of other letters stay."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for kept in (b"0123456789", b"abcdefghijklmnopqrstuvwxyz"):
        for b in kept:
            table[b] = b
    for b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[b] = b + 32
    return bytes(table)


WORD_TABLE = _word_table()


def word_blocks(text: bytes, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``block`` bytes each."""
    blank = text.translate(WORD_TABLE)
    start = 0
    while start < len(blank):
        end = blank.find(b" ", start + block)
        end = len(blank) if end < 0 else end
        yield blank[start:end].split()
        start = end


def hashed_features(text: bytes, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[int, Counter]:
    """How many words a text has, and how often its runs of 1 to ``longest`` words fall in each bucket."""
    found, n_words, tail = Counter(), 0, []
    for block in word_blocks(text):
        n_words += len(block)
        words = tail + block
        after = [b" " + w for w in words]
        sums = list(map(crc32, words))
        found.update([c % buckets for c in sums[len(tail) :]])
        for n in range(2, longest + 1):
            sums = list(map(crc32, after[n - 1 :], sums))  # each run, continued by the word that follows it
            known = max(0, len(tail) - n + 1)  # runs that end in the block before
            found.update([c % buckets for c in sums[known:]])
        tail = words[len(words) - min(len(words), longest - 1) :]
    return n_words, found


def feature_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> list[int]:
    """How many features of all of ``text`` fall in each bucket; every task sends one row per bucket at most."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update(hashed_features(text.as_py() or b"", buckets, longest)[1])
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], schema=schema)

    rows = texts.select(F.col("text").cast("binary")).mapInArrow(reduced, "bucket long, n long")
    counts = [0] * buckets
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket: bounded
        counts[r["bucket"]] = r["n"]
    return counts


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Per bucket, ``SCALE`` times the logarithm of its smoothed share in the target over that in the corpus, floored."""
    n_corpus, n_target = float(sum(corpus) + len(corpus)), float(sum(target) + len(target))
    return [math.floor(SCALE * math.log((t + 1.0) * n_corpus / ((s + 1.0) * n_target))) for s, t in zip(corpus, target)]


def noise(key: str, seed: int) -> Column:
    """Gumbel noise in units of 1 / ``SCALE``, floored; a function of the seed and the key, null like an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(quoted(key).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 2.0**32)))


def weigh(
    docs: DataFrame,
    target: DataFrame,
    seed: int = 42,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    key: str = "doc_id",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features``, ``weight`` and ``score`` against the texts of ``target``.

    The counts of both sides cover all their rows. Texts are read whole, in blocks of bounded size; a null or empty
    text has no features, weight 0 and the noise as its score. Repeated rows count and are scored each for itself.
    Of the input, the columns in ``keep`` stay, all by default; those with the names of the result are replaced. An
    empty table gives an empty one; an empty target is uniform over the buckets.
    """
    docs = without(docs, "n_words", "n_features", "weight", "score")
    gain = gains(feature_counts(docs, buckets, longest), feature_counts(target, buckets, longest))
    names = list(docs.columns if keep is None else keep)
    sent = [*names, *(() if "text" in names else ("text",))]
    at = sent.index("text")

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(at).cast(pa.large_binary()):
                n_words, found = hashed_features(text.as_py() or b"", buckets, longest)
                rows.append((n_words, found.total(), sum(gain[b] * n for b, n in found.items())))
            added = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3
            columns = [*batch.columns[: len(names)], *added]
            yield pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])

    fields = [T.StructField(str(i), docs.schema[n].dataType) for i, n in enumerate(names)]
    fields += [T.StructField(str(len(names) + i), T.LongType()) for i in range(3)]
    numbered = docs.select(*[quoted(c) for c in sent]).toDF(*[str(i) for i in range(len(sent))])
    out = numbered.mapInArrow(weighed, T.StructType(fields)).toDF(*names, "n_words", "n_features", "weight")
    return out.withColumn("score", F.col("weight") + noise(key, seed))


def draw(weighed: DataFrame, percent: int = 5, min_words: int = 20, key: str = "doc_id") -> DataFrame:
    """All rows of :func:`weigh` with ``rank``: 1, 2, 3, ... for the drawn ones, null for the others.

    Of the N rows with at least ``min_words`` words, the floor(percent * N / 100) highest scores are drawn; equal
    scores go to the smaller key (null first), rows that are equal in both in no stated order. Only rows near or
    above the last drawn score are sorted, in ranges of score, key and row; a range has no fixed bound, but no key
    or score can fill one, since rows are told apart by their place.
    """
    spark = weighed.sparkSession
    rows = stored(without(weighed, "rank").withColumn("_row", F.monotonically_increasing_id()), "weighed")
    eligible = F.col("n_words") >= min_words
    size = rows.where(eligible).count()
    drawn = percent * size // 100
    none = F.lit(None).cast("long")
    if drawn == 0:
        return rows.withColumn("rank", none).drop("_row")
    share = max(0.0, 1 - drawn / size - 2 * QUANTILE_ERROR - 2 / size)
    least = rows.where(eligible).approxQuantile("score", [share], QUANTILE_ERROR)[0]
    near = eligible & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_first(key), F.asc("_row")]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    # The order of the ranges and in them is written, so that numbers do not change if a task runs again.
    sorted_rows = stored(
        rows.where(near).repartitionByRange(min(RANGES, max(1, ranges)), *order).sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_place")),
        "drawn",
    )
    counts = sorted(sorted_rows.groupBy("_range").agg(F.count(F.lit(1)), F.min("_place")).collect())  # one row per range
    upto = accumulate((n for _, n, _ in counts), initial=0)
    starts = [(r, before - first) for (r, _, first), before in zip(counts, upto)]
    numbered = sorted_rows.join(F.broadcast(spark.createDataFrame(starts, "_range int, _shift long")), "_range")
    rank = F.col("_place") + F.col("_shift") + 1
    columns = [quoted(c) for c in rows.columns if c != "_row"]
    ranked = numbered.select(*columns, F.when(rank <= drawn, rank).alias("rank"))
    return rows.where(~F.coalesce(near, F.lit(False))).select(*columns, none.alias("rank")).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """The drawn documents, whole, with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``."""
    return draw(weigh(docs, target, seed), percent, min_words).where(F.col("rank").isNotNull())
