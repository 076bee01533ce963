"""Public tokenizers in Python workers: ids of whole texts and the bytes of every id.

A vocabulary file in the format of ``tokenizers`` is encoded by ``tiktoken`` with that file's own vocabulary, which
gives the same ids about four times as fast; what it refuses (very long runs of white space) goes through
``tokenizers`` itself. Files are loaded once per worker.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import cache

import numpy as np

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: the pattern that cuts text into pieces before the merges of a byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level entry stands for: itself if it prints, else the next from 256 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printing]
    return {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteVocabulary:
    """Byte-level BPE from a file of ``tokenizers``. ``marks`` says if special tokens in texts get their own ids."""

    def __init__(self, path: str, marks: bool):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = _byte_letters()
        self.path, self.marks = path, marks
        entries = {bytes(letters[c] for c in entry): i for entry, i in content["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in content["added_tokens"] if t["special"]}
        self._encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=entries, special_tokens=special)
        self._allowed = "all" if marks else set()
        self.token_bytes = _by_id({i: b for b, i in entries.items()} | {i: t.encode() for t, i in special.items()})

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [self._encode(t) for t in texts]

    def _encode(self, text: str) -> np.ndarray:
        try:
            return self._encoder.encode_to_numpy(text, allowed_special=self._allowed, disallowed_special=())
        except ValueError:  # white space beyond the stack of its pattern matcher
            encoder = _reference_encoder(self.path, self.marks)
            return np.array(encoder.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


class PieceVocabulary:
    """A ``sentencepiece`` model, which adds the leading space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.token_bytes = []
        for i in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(i)
            self.token_bytes.append(
                bytes([int(piece[3:5], 16)]) if self._model.is_byte(i) else piece.replace("▁", " ").encode()
            )

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.array(ids, dtype=np.uint32) for ids in self._model.encode(list(texts), num_threads=1)]


def _by_id(entries: dict[int, bytes]) -> list[bytes]:
    return [entries.get(i, b"") for i in range(max(entries) + 1)]


@cache
def byte_vocabulary(path: str, marks: bool = False) -> ByteVocabulary:
    return ByteVocabulary(path, marks)


@cache
def piece_vocabulary(path: str) -> PieceVocabulary:
    return PieceVocabulary(path)


@cache
def _reference_encoder(path: str, marks: bool):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(path)
    encoder.encode_special_tokens = not marks
    return encoder
