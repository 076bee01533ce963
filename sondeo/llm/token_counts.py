"""Token counts by field and section: whole documents are encoded once and tokens are attributed by their offsets.

The byte spans of the tokens are the running sum of their lengths; a merge of the two ordered lists of spans finds the
section of each token's first and last byte. A token over a boundary goes to one section by a stated rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.llm.common import quoted

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts text into pieces before the merges of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "last", "most")


@cache
def tokenizer(vocabulary: str, pattern: str = PATTERN) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder and the length in bytes of each token, once per worker."""
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def token_ends(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Where each token of ``text`` ends, in bytes of UTF-8."""
    encoder, lengths = tokenizer(vocabulary)
    return np.cumsum(lengths[np.asarray(encoder.encode_to_numpy(text, disallowed_special=()), dtype=np.int64)])


def attribute(ends: np.ndarray, section_starts: np.ndarray, rule: str = "first") -> tuple[np.ndarray, int]:
    """Tokens by section, and how many tokens cross a boundary.

    ``first`` gives a crossing token to the section of its first byte, ``last`` to that of its last, ``most`` to
    the one with most of its bytes, the earlier of equals.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    first = np.searchsorted(section_starts, starts, side="right") - 1
    last = np.searchsorted(section_starts, ends - 1, side="right") - 1
    crossing = np.flatnonzero(first != last)
    chosen = last.copy() if rule == "last" else first.copy()
    if rule == "most":
        for i in crossing:
            cuts = [starts[i], *section_starts[first[i] + 1 : last[i] + 1], ends[i]]
            chosen[i] = first[i] + int(np.argmax(np.diff(cuts)))
    return np.bincount(chosen, minlength=len(section_starts)), len(crossing)


def count_tokens(
    docs: DataFrame,
    fields: Sequence[str] = ("text",),
    rule: str = "first",
    vocabulary: str = VOCABULARY,
    key: str = "doc_id",
) -> DataFrame:
    """Per row of ``docs``: ``n_tokens``, ``n_sections``, ``n_crossing``, ``field_tokens`` and ``section_tokens``.

    The fields of a row are joined by line feeds and encoded as one text. Every line is a section, with the line
    feed that ends it; a field is its sections. Crossing tokens follow ``rule`` (see :func:`attribute`).

    Null fields are empty, and an empty field is one empty section without tokens of its own. Repeated rows and
    null keys stay as they are. Only the key and the counts are returned. An empty table gives an empty one. Texts
    are encoded whole; marks of special tokens in them are ordinary text.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = [f"f{i}" for i in range(len(fields))]
    taken = docs.select(quoted(key).alias("key"), *[F.coalesce(quoted(f), F.lit("")).alias(n) for f, n in zip(fields, names)])
    kind = taken.schema["key"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for parts in zip(*(batch.column(n) for n in names)):
                parts = [p.as_py() for p in parts]
                text = "\n".join(parts)
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                section_starts = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
                tokens, crossing = attribute(token_ends(text, vocabulary), section_starts, rule)
                upto = np.cumsum([p.count("\n") + 1 for p in parts])
                by_field = np.add.reduceat(tokens, np.concatenate([[0], upto[:-1]]).astype(np.int64))
                rows.append((int(tokens.sum()), len(section_starts), crossing, by_field.tolist(), tokens.tolist()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], names=["key", *"abcde"])

    out = f"key {kind}, a long, b long, c long, d array<long>, e array<long>"
    return taken.mapInArrow(counted, out).toDF(key, "n_tokens", "n_sections", "n_crossing", "field_tokens", "section_tokens")
