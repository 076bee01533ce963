"""Documents with every awkward case, and plain versions of what the operators should find."""

from __future__ import annotations

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, shard string, node string"

LINE = "This line is found in many of the documents."
PASSAGE = " ".join(f"word{i}" for i in range(60))


def texts() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, and columns whose names clash with results)."""
    near = PASSAGE.replace("word30", "changed")
    found = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, "\n\n", None, None), (4, "one", "en", "a"),
        (5, f"{LINE}\nfirst\n{LINE.upper()} ", "en", "a"), (6, f"{LINE}\nsecond", "en", "b"), (7, f"x\n {LINE}\ty", "en", "b"),
        (8, PASSAGE, "en", "a"), (9, PASSAGE, "en", "c"), (10, near, "en", "c"), (11, "tail " + near, None, "a"),
        (12, "long " * 30_000, "en", "a"), (13, "é" * 50_000, "fr", "a"), (14, f"\t{LINE}", "en", "a"),
        (15, PASSAGE.upper(), "de", "b"), (8, PASSAGE, "en", "a"), (16, "same id one", "en", "a"), (16, "same id other text", "en", "a"),
        (None, f"{LINE}\nno id", "en", "a"), (None, None, None, None), (17, "a b c d", "en", "b"), (18, "A  b\tc d", "en", "b"),
    ]
    return [(*r, len(r[1] or ""), "clash", "clash", "clash") for r in found]


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text: str | None, n: int = 5) -> set[tuple]:
    w = words(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(rows: list[tuple]) -> dict[int, int]:
    """Least doc_id reachable, over (doc_id, text) by all pairs; rows without an id are left out."""
    rows = [(d, shingle_set(t)) for d, t in rows if d is not None]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in root}
