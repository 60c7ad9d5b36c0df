"""BPE with word ends of whole texts, with the ids of the tokenizers library at several times its speed.

In texts of plain Latin letters the pre-tokenizer's rule only needs the class of each character (letter, number, space,
other), so numpy finds the words, each different word is encoded once in a task, and texts are put together from the ids of
words. Every other text (other letters, control characters, which differ between Unicode versions and libraries) goes
to the tokenizers library itself.
"""

from __future__ import annotations

import json
from collections import defaultdict
from functools import cache
from itertools import islice

import numpy as np

from .byte_bpe import byte_of, tokenizer

END = "\x01"  # stands for a word's end; texts with control characters never come here
#: Code points from here on go to the library.
PLAIN = 0x250
#: Characters worked on at once; bounds memory, not texts: one longer text makes a chunk of its own.
CHUNK = 1_000_000
#: Different words kept in a worker before it starts over.
KEPT_WORDS = 400_000


@cache
def _rules():
    import regex

    kinds = np.full(PLAIN, 3, np.uint8)  # 0 space, 1 letter, 2 number, 3 other, 4 not for here
    for n in range(PLAIN):
        c = chr(n)
        if c in "\t\n\x0b\x0c\r \xa0":
            kinds[n] = 0
        elif n < 32 or 127 <= n < 160:
            kinds[n] = 4
        elif regex.match(r"\p{L}", c):
            kinds[n] = 1
        elif regex.match(r"\p{N}", c):
            kinds[n] = 2
    return kinds, regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class Words:
    """Ids of words; encodes each new one once."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        suffix, of = stored["model"]["end_of_word_suffix"], byte_of()
        special = {t["content"] for t in stored["added_tokens"]}
        ranks = {}
        for t, n in stored["model"]["vocab"].items():
            if t not in special:
                body = t.removesuffix(suffix)
                ranks[bytes(of[c] for c in body) + END.encode() * (body != t)] = n
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        self.ends[[n for t, n in ranks.items() if len(t) > 1 and t.endswith(END.encode())]] = True
        self.bpe = tiktoken.Encoding("lexmill", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={})
        self._clear()

    def _clear(self) -> None:
        self.seen: defaultdict[str, int] = defaultdict()
        self.seen.default_factory = self.seen.__len__
        self.ids, self.first, self.count = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words on end, and how many each has."""
        if len(self.seen) > KEPT_WORDS:
            self._clear()
        known = len(self.seen)
        at = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
        if len(self.seen) > known:
            new = np.asarray(self.bpe.encode_to_numpy(END.join(islice(self.seen, known, None)) + END, disallowed_special=()), "<u4")
            last = np.flatnonzero(self.ends[new]) + 1
            if len(last) != len(self.seen) - known:
                raise AssertionError("a word's end was lost")
            first = np.concatenate(([0], last[:-1]))
            self.first = np.concatenate((self.first, first + len(self.ids)))
            self.count = np.concatenate((self.count, last - first))
            self.ids = np.concatenate((self.ids, new))
        count = self.count[at]
        before = np.cumsum(count) - count
        return self.ids[np.repeat(self.first[at] - before, count) + np.arange(count.sum())], count


@cache
def _words(path: str) -> Words:
    return Words(path)


def encode(path: str, texts: list[str | None]) -> list[np.ndarray]:
    """The ids of each whole text, as unsigned 32-bit integers."""
    out: list[np.ndarray] = [np.empty(0, "<u4")] * len(texts)
    chunk: list[int] = []
    held = 0
    for k, text in enumerate(texts):
        if text:
            chunk.append(k)
            held += len(text)
            if held >= CHUNK:
                _encode(path, texts, chunk, out)
                chunk, held = [], 0
    _encode(path, texts, chunk, out)
    return out


def _encode(path: str, texts: list[str | None], which: list[int], out: list[np.ndarray]) -> None:
    kinds, rule = _rules()
    plain, lowered = [], []
    for k in which:
        low = texts[k].lower()
        if low.isascii() or ord(max(low)) < PLAIN:
            plain.append(k)
            lowered.append(low)
        else:
            out[k] = np.array(tokenizer(path).encode(texts[k], add_special_tokens=False).ids, "<u4")
    if not plain:
        return
    chars = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = kinds[chars]
    stops = np.cumsum([len(x) + 1 for x in lowered])
    ends = kind != 0
    ends[:-1] &= (kind[:-1] == 2) | (kind[1:] != kind[:-1])
    # each kept character, and a mark after the last one of a word
    kept = np.flatnonzero(kind != 0)
    after = ends[kept]
    to = np.arange(len(kept)) + np.cumsum(after) - after
    marked = np.full(len(kept) + int(after.sum()), ord(END), "<u4")
    marked[to] = chars[kept]
    words = marked.tobytes().decode("utf-32-le", "surrogatepass").split(END)[:-1]
    number = np.searchsorted(kept[after], stops)  # words before each text's end
    odd = set(np.searchsorted(stops, np.flatnonzero(kind == 4), "right").tolist())
    start = 0
    lists, owners = [], []
    for j, (k, stop) in enumerate(zip(plain, number.tolist())):
        if j in odd:
            out[k] = np.array(tokenizer(path).encode(texts[k], add_special_tokens=False).ids, "<u4")
        else:
            lists.append(rule.findall(lowered[j]) if "'" in lowered[j] else words[start:stop])
            owners.append(k)
        start = stop
    flat = [w for x in lists for w in x]
    ids, count = _words(path).of(flat)
    upto = np.concatenate(([0], np.cumsum(count)))[np.cumsum([len(x) for x in lists], dtype=np.int64)] if lists else np.empty(0, np.int64)
    start = 0
    for k, stop in zip(owners, upto.tolist()):
        out[k] = ids[start:stop]
        start = stop
