"""How many tokens a unigram tokenizer makes of a text, without making them: Viterbi with best score and piece count only.

A vocabulary of pieces and scores becomes an Aho-Corasick automaton over bytes with all its transitions laid out, so many
words advance a byte at a time together in numpy. At each byte the automaton's matches, longest first, offer a
best path: the score before the match plus the piece's, and its count plus one; a later offer must be strictly better,
which is the rule of the tokenizers library (it offers by rising start, so the longest piece first). A character without a
single-character piece may also stand alone as unknown, at the least score less ten, and counts as its UTF-8 bytes
where the vocabulary has bytes to fall back on, else runs of them count one.

A text is cut before each run of spaces (written as the vocabulary's mark, which stands before the first word too) where no piece has a mark after
another character, so that no piece spans a cut; with another vocabulary it isn't cut. Each different part of a batch is worked out once. With
``split``, each space is cut before, as by the library's Metaspace, and pieces of several marks don't count.

Defined results: null and empty texts have 0 tokens. Words of any length are whole; very long ones go alone. Repeated rows are counted each. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched

MARK = "▁"
#: What an unknown character costs beyond the least score.
UNKNOWN = 10.0
#: Characters of texts, and bytes of different words, that are worked on at once.
CHUNK, CELLS = 1_000_000, 4_000_000


def vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Ordinary pieces and scores of a sentencepiece file, and whether it has bytes to fall back on."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = range(model.vocab_size())
    plain = [(model.id_to_piece(k), model.get_score(k)) for k in n if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
    return plain, any(model.is_byte(k) for k in n)


class Automaton:
    def __init__(self, pieces: list[tuple[str, float]], fallback: bool, split: bool = True):
        self.fallback = fallback
        spans = any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in pieces) or not (fallback or any(p == MARK for p, _ in pieces))
        #: what texts are cut into, once marks are spaces
        self.part = re.compile(" [^ ]*" if split else "(?s:.+)" if spans else " +[^ ]*")
        trie: list[dict[int, int]] = [{}]
        score, length = {}, {}
        for piece, s in pieces:
            raw, at = piece.encode(), 0
            for c in raw:
                if c not in trie[at]:
                    trie[at][c] = len(trie)
                    trie.append({})
                at = trie[at][c]
            if at not in score:
                score[at], length[at] = s, len(raw)
        n = len(trie)
        self.go = np.zeros((n, 256), np.int32)
        #: per state: its own piece's score and bytes (0: none), and the next state with a piece on its chain of suffixes
        self.score, self.length, self.next = np.zeros(n), np.zeros(n, np.int32), np.zeros(n, np.int32)
        for k, s in score.items():
            self.score[k], self.length[k] = s, length[k]
        fail = np.zeros(n, np.int32)
        level = list(trie[0].values())
        for c, k in trie[0].items():
            self.go[0, c] = k
        while level:
            below = []
            for k in level:
                f = fail[k]
                self.next[k] = f if self.length[f] else self.next[f]
                self.go[k] = self.go[f]
                for c, child in trie[k].items():
                    fail[child] = self.go[f, c]
                    self.go[k, c] = child
                    below.append(child)
            level = below
        self.first = np.where(self.length > 0, np.arange(n, dtype=np.int32), self.next)  # the longest match that ends here
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN
        self.single = {p for p, _ in pieces if len(p) == 1}

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word; words of like length advance together."""
        raws = [w.encode("utf-8", "replace") for w in words]
        size = np.array([len(r) for r in raws], np.int64)
        out = np.zeros(len(words), np.int64)
        order = np.argsort(size, kind="stable")
        low = 0
        while low < len(order):
            high = low + 1
            # all of a part are as long as its longest when laid out
            while high < len(order) and size[order[high]] * (high + 1 - low) <= CELLS and size[order[high]] <= 1.25 * size[order[low]] + 4:
                high += 1
            part = order[low:high]
            out[part] = self._run([raws[k] for k in part], size[part])
            low = high
        return out

    def _run(self, raws: list[bytes], size: np.ndarray) -> np.ndarray:
        n, longest = len(raws), int(size[-1])
        if not longest:
            return np.zeros(n, np.int64)
        text = np.zeros((longest, n), np.uint8)  # by place, then word
        text[np.arange(longest)[:, None] < size[None, :]] = 0
        flat = np.frombuffer(b"".join(raws), np.uint8)
        word = np.repeat(np.arange(n), size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        text[place, word] = flat
        best = np.full((longest + 1, n), -np.inf)
        count = np.zeros((longest + 1, n), np.int32)
        run = np.zeros((longest + 1, n), bool)  # the best path ends in an unknown character
        best[0] = 0
        state = np.zeros(n, np.int32)
        every = np.arange(n)
        start = np.zeros(n, np.int64)  # of the character that this byte is in
        known = self._known(raws, size, text)
        for i in range(longest):
            live = every[size > i] if size[0] <= i else every  # rising sizes
            if len(live) < n:
                live = every[n - len(live) :]
            c = text[i, live]
            start[live] = np.where((c & 0xC0) == 0x80, start[live], i)
            state[live] = self.go[state[live], c]
            at, who = self.first[state[live]], live
            some = at > 0
            at, who = at[some], who[some]
            while len(who):
                before = i + 1 - self.length[at]
                offer = best[before, who] + self.score[at]
                better = offer > best[i + 1, who]
                w, b = who[better], before[better]
                best[i + 1, w] = offer[better]
                count[i + 1, w] = count[b, w] + 1
                run[i + 1, w] = False
                at = self.next[at]
                some = at > 0
                at, who = at[some], who[some]
            odd = live[known[i, live] == 2]  # a character ends here that no piece is alone
            if len(odd):
                before = start[odd]
                offer = best[before, odd] + self.unknown
                better = offer > best[i + 1, odd]
                w, b = odd[better], before[better]
                best[i + 1, w] = offer[better]
                more = i + 1 - b if self.fallback else np.where(run[b, w], 0, 1)
                count[i + 1, w] = count[b, w] + more
                run[i + 1, w] = True
        return count[size, every].astype(np.int64)

    def _known(self, raws: list[bytes], size: np.ndarray, text: np.ndarray) -> np.ndarray:
        """2 where a character ends that isn't a piece by itself."""
        out = np.zeros(text.shape, np.uint8)
        ascii_odd = np.array([chr(c) not in self.single for c in range(128)] + [False] * 128)
        inside = np.arange(len(text))[:, None] < size[None, :]
        out[ascii_odd[text] & inside] = 2
        if (text >= 0x80).any():
            for k in np.flatnonzero((text >= 0x80).any(0)):
                stop = 0
                for ch in raws[k].decode("utf-8", "replace"):
                    stop += len(ch.encode())
                    if ch not in self.single:
                        out[stop - 1, k] = 2
        return out


@cache
def automaton(path: str) -> Automaton:
    return Automaton(*vocabulary(path), split=False)


def count_texts(found: Automaton, texts: list[str | None]) -> list[int]:
    """Tokens of each whole text."""
    out = [0] * len(texts)
    low = 0
    while low < len(texts):
        high, held = low, 0
        while high < len(texts) and (held < CHUNK or high == low):
            held += len(texts[high] or "")
            high += 1
        seen: defaultdict[str, int] = defaultdict()
        seen.default_factory = seen.__len__
        ids = [np.fromiter(map(seen.__getitem__, w), np.int64, len(w)) for w in (_words(t, found.part) for t in texts[low:high])]
        n = found.counts([w.replace(" ", MARK) for w in seen])
        for k, x in enumerate(ids):
            out[low + k] = int(n[x].sum())
        low = high
    return out


def _words(text: str | None, part: re.Pattern) -> list[str]:
    """The parts of a text, once marks are spaces and it starts with one."""
    text = (text or "").replace(MARK, " ")
    return part.findall(text if text.startswith(" ") else " " + text) if text else []


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count_texts(found, b.column(1).to_pylist()), pa.int64())], ["doc_id", "n_tokens"])

    wanted = docs.select("doc_id", F.col("text").cast("string"))
    return batched(wanted).mapInArrow(run, f"doc_id {wanted.schema['doc_id'].dataType.simpleString()}, n_tokens long")
