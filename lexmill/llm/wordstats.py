"""Statistics of single texts, over Arrow batches; plain Python and numpy, no Spark."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

#: Names of what :func:`text_stats` returns, in order.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct")
SYMBOLS = b"#*$%&|<>"


def number(words: list[bytes]) -> tuple[np.ndarray, int]:
    """Words as numbers from 0, equal ones alike, and how many differ."""
    seen: defaultdict[bytes, int] = defaultdict()
    seen.default_factory = seen.__len__
    ids = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
    return ids, len(seen)


def repeated(ids: np.ndarray, window: int = 8) -> int:
    """Positions in windows that occur twice or more; exact: windows are compared by numbers of halves, not by hashes."""
    if len(ids) <= window:
        return 0
    width = 1
    while width < window:
        pairs = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        ids, width = np.unique(pairs, return_inverse=True)[1], width * 2
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(ids) + window, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: exactly space and U+0009 to U+000D
    if not words:
        return (0,) * len(STATS)
    spaces = len(raw) - sum(map(len, words))
    ids, distinct = number(words)
    again = repeated(ids) if distinct + 8 <= len(words) else 0  # a repeated window repeats eight words
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (
        len(words), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), again, len(lines), distinct,
    )
