"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

The index holds a bounded sample of labelled documents (``SAMPLE``, by a hash of doc_id; half of them toxic, if there are as many), with all of their words. Document
frequencies come from all documents. A word's weight is its TF-IDF times how much the sample says that it goes with the label, either way: c / (c + 20) of
its chi-squared value c (copies counted once), ``LEAST`` at least, so every word counts. Examples lie in blocks, like ones together; for each
word a block's largest weight bounds what any example in it can score. Blocks are
opened by falling bound until none can change the nearest ``K``: the result is that of scoring all of them. Neighbours vote with
their cosine; a logistic curve fitted to the votes that the sample's own documents (``CURVE`` of them at most) get without themselves
makes them a probability; there each label weighs what it has among all labelled documents.

Defined results: a null or empty text, and one without any word of the examples, has no neighbours and gets the share of toxic documents
among those of the sample without neighbours, or in all of it. Rows of labels with a null doc_id or label are not learned; of several labels of a doc_id the largest
counts. Without usable labels every score is 0. Repeated rows are scored each. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, cut

SAMPLE = 3_000
CURVE = 1_000
LEAST = 0.02
K = 15
BLOCK = 64
#: So many of the commonest words are kept as columns, not postings: their part of all scores is a matrix product for a whole batch of texts.
COMMON = 256
#: Blocks opened before the bound of the others is compared with what was found.
FIRST = 8

_NO_WORD = re.compile(rb"[^a-z0-9\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Runs of letters and digits; A to Z in lower case."""
    return _NO_WORD.sub(b" ", text.encode("utf-8", "surrogatepass").lower()).split() if text else []


@dataclass
class Index:
    """Labelled examples as an inverted index in blocks; picklable, its size bounded by the sample's words."""

    number: dict[bytes, int]  # of a word
    idf: np.ndarray  # times the word's factor
    ids: np.ndarray  # doc_ids of the examples, in index order
    toxic: np.ndarray
    common: np.ndarray  # example x word: weights of the COMMON first words
    cells: np.ndarray  # of each other word, where its cells (a word in a block) start
    block: np.ndarray  # of each cell
    most: np.ndarray  # the largest weight in each cell
    ptr: np.ndarray  # of each cell, where its postings start
    docs: np.ndarray
    weights: np.ndarray
    alone: float = 0.0  # the score of texts without neighbours
    curve: tuple[float, float] = (1.0, 0.0)

    def vector(self, found: Counter[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and unit-length TF-IDF weights of the vocabulary's words in a text."""
        hits = [(self.number[w], n) for w, n in found.items() if w in self.number]
        if not hits:
            return np.empty(0, np.int64), np.empty(0)
        at = np.array([h[0] for h in hits])
        x = (1 + np.log([h[1] for h in hits])) * self.idf[at]
        return at, x / np.sqrt((x * x).sum())

    def dense(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the commonest words give each text's cosine with each example."""
        x = np.zeros((len(vectors), self.common.shape[1]))
        for k, (at, w) in enumerate(vectors):
            some = at < x.shape[1]
            x[k, at[some]] = w[some]
        return x @ self.common.T

    def nearest(self, at: np.ndarray, x: np.ndarray, but: int = -1, k: int = K, dense: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``k`` nearest examples, without the one at ``but``; ties to the earlier place."""
        dense = self.dense([(at, x)])[0] if dense is None else dense.copy()
        if but >= 0:
            dense[but] = -9
        rare = at >= self.common.shape[1]
        at, x = at[rare] - self.common.shape[1], x[rare]
        cells, of = _ranges(self.cells[at], self.cells[at + 1])
        weight = x[of]
        starts = np.arange(0, len(dense), BLOCK)
        bounds = np.maximum.reduceat(dense, starts) + np.bincount(self.block[cells], weight * self.most[cells], minlength=len(starts))
        order = np.argsort(-bounds, kind="stable")[: int((bounds > 0).sum())]
        best, score = self._opened(cells, weight, order[:FIRST], dense, k)
        least = score[-1] - 1e-9 if len(score) == k else 0.0
        rest = order[FIRST:]
        rest = rest[bounds[rest] >= least]
        if len(rest):
            more, theirs = self._opened(cells, weight, rest, dense, k)
            best, score = np.concatenate((best, more)), np.concatenate((score, theirs))
            keep = np.lexsort((best, -score))[:k]
            best, score = best[keep], score[keep]
        return best, score

    def _opened(self, cells: np.ndarray, weight: np.ndarray, blocks: np.ndarray, dense: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest within ``blocks``: their postings of all words, added up by example."""
        wanted = np.zeros(-(-len(dense) // BLOCK), bool)
        wanted[blocks] = True
        some = wanted[self.block[cells]]
        place, of = _ranges(self.ptr[cells[some]], self.ptr[cells[some] + 1])
        found = dense + np.bincount(self.docs[place], weight[some][of] * self.weights[place], minlength=len(dense))
        found[~np.repeat(wanted, BLOCK)[: len(dense)]] = -9
        if len(found) > 4 * k:
            near = np.flatnonzero(found >= np.partition(found, -k)[-k])
        else:
            near = np.arange(len(found))
        near = near[found[near] > 0]
        keep = np.lexsort((near, -found[near]))[:k]
        return near[keep], found[near[keep]]

    def vote(self, best: np.ndarray, score: np.ndarray) -> float:
        return float((score * self.toxic[best]).sum() / score.sum())

    def probability(self, vote: float) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a * (vote - 0.5) + b, -50, 50))))


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and of which range each is."""
    size = stop - start
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + start[of], of


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def _curve(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """A logistic curve through votes, by Newton's method with a little ridge."""
    x = np.stack((votes - 0.5, np.ones(len(votes))), 1)
    beta = np.array([6.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (toxic - p)) - 0.1 * (beta - [6.0, 0.0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        beta = beta + np.linalg.solve(hess, grad)
    return float(max(beta[0], 0.1)), float(beta[1])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Index:
    """An index from labelled rows that aren't held out; the driver gets the words of ``sample`` documents and how many of all documents hold each, nothing else."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    of_label = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    some = min(of_label.get(1, 0), sample // 2)
    known = cut(known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(some).union(known.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample - some)))  # ids and labels only
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Counter(words(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64())),
                                              pa.array([hash_of(t) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "toxic", "words", "counts", "text_hash"])

    texts = texts.select(F.col("doc_id").cast("long"), "text", "toxic")
    bag = batched(texts).mapInArrow(bags, "doc_id long, toxic int, words array<binary>, counts array<long>, text_hash long")
    rows = sorted(((r.doc_id, r.toxic, Counter(dict(zip(map(bytes, r.words), r.counts))), r.text_hash) for r in bag.collect()), key=lambda r: (r[0], r[3] or 0))
    df, bad, seen = Counter(), Counter(), set()
    for _, toxic, found, key in rows:
        if (key, toxic) not in seen:
            seen.add((key, toxic))
            df.update(found.keys())
            bad.update(found.keys() if toxic else ())
    number = {w: k for k, w in enumerate(sorted(df, key=lambda w: (-df[w], w)))}  # common words first
    n, p = len(seen), sum(toxic for _, toxic in seen)
    d, a = (np.array([c[w] for w in number], float) for c in (df, bad))
    cross = a * (n - p - (d - a)) - (d - a) * (p - a)
    chi2 = n * cross * cross / np.maximum(d * (n - d) * p * (n - p), 1e-9)
    total, frequency = frequencies(docs, number)
    idf = (np.log((1 + total) / (1 + frequency)) + 1) * np.maximum(LEAST, chi2 / (chi2 + 20))
    index = Index(number, idf, *[np.empty(0, np.int64)] * 2, np.empty((0, 0)), np.zeros(len(number) + 1, np.int64), np.empty(0, np.int64), np.empty(0), np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0))
    vectors = [(r[0], r[1], *index.vector(r[2])) for r in rows if r[2]]
    without, of = len(rows) - len(vectors), sum(r[1] for r in rows) - sum(r[1] for r in vectors)
    vectors.sort(key=lambda r: (r[1], np.sort(r[2])[:3].tolist(), r[0]))  # those of like commonest words share blocks
    index.alone = float(of / without) if without > 0 else of_label.get(1, 0) / max(1, sum(of_label.values())) if n else 0.0
    if vectors:
        _fill(index, vectors)
        some = range(0, len(vectors), -(-len(vectors) // CURVE))
        votes = [(index.vote(*near), vectors[k][1]) for k in some if len((near := index.nearest(vectors[k][2], vectors[k][3], but=k))[0])]
        if len({y for _, y in votes}) == 2:
            y = np.array([y for _, y in votes], float)
            held = Counter(r[1] for r in rows)
            weight = np.where(y > 0, of_label[1] / held[1], of_label[0] / held[0])
            index.curve = _curve(np.array([v for v, _ in votes]), y, weight / weight.mean())
        elif votes:
            index.curve = (0.0, 50.0 if votes[0][1] else -50.0)
    return index


def hash_of(text: str | None) -> int | None:
    from xxhash import xxh3_64_intdigest

    return None if text is None else int(np.uint64(xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))).astype(np.int64))


def frequencies(docs: DataFrame, number: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many hold each word; of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(len(number), np.int64)
        for b in batches:
            n += len(b)
            for t in b.column(0).to_pylist():
                df[[number[w] for w in number.keys() & set(words(t))]] += 1
        yield pa.RecordBatch.from_arrays([pa.array([-1, *np.flatnonzero(df)], pa.int32()), pa.array([n, *df[df > 0]], pa.int64())], ["term", "n"])

    found = batched(docs.select(F.col("text").cast("string"))).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out, total = np.zeros(len(number)), 0
    for r in found.collect():
        if r.term < 0:
            total = r.n
        else:
            out[r.term] = r.n
    return total, out


def _fill(index: Index, vectors: list) -> None:
    index.ids = np.array([r[0] for r in vectors], np.int64)
    index.toxic = np.array([r[1] for r in vectors], float)
    term = np.concatenate([r[2] for r in vectors])
    doc = np.repeat(np.arange(len(vectors)), [len(r[2]) for r in vectors])
    weight = np.concatenate([r[3] for r in vectors])
    often = term < COMMON
    index.common = np.zeros((len(vectors), min(COMMON, len(index.number))))
    index.common[doc[often], term[often]] = weight[often]
    term, doc, weight = term[~often] - COMMON, doc[~often], weight[~often]
    order = np.lexsort((doc, term))
    term, index.docs, index.weights = term[order], doc[order].astype(np.int32), weight[order]
    block = index.docs // BLOCK
    first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))  # of each cell
    index.ptr = np.append(first, len(term))
    index.block, index.most = block[first], np.maximum.reduceat(index.weights, first) if len(first) else np.empty(0)
    index.cells = np.searchsorted(term[first], np.arange(max(0, len(index.number) - COMMON) + 1))


def score(docs: DataFrame, index: Index, evidence: int = 3) -> DataFrame:
    """doc_id, held_out, score, predicted and the nearest examples (their doc_ids, cosines and labels), of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by SAMPLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        known = index.number.keys()
        for b in batches:
            scores, near = [], []
            found = [index.vector(Counter(filter(known.__contains__, words(t)))) for t in b.column(1).to_pylist()]
            dense = index.dense(found) if len(index.ids) else None
            for k, (at, x) in enumerate(found):
                best, cosines = index.nearest(at, x, dense=dense[k]) if len(at) else ((), ())
                scores.append(index.probability(index.vote(best, cosines)) if len(best) else index.alone)
                near.append([{"doc_id": int(index.ids[j]), "cosine": float(c), "toxic": int(index.toxic[j])} for j, c in zip(best[:evidence], cosines)] if len(best) else [])
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(near, kind)], ["doc_id", "score", "nearest"])

    wanted = docs.select("doc_id", F.col("text").cast("string"))
    kind = wanted.schema["doc_id"].dataType.simpleString()
    found = batched(wanted).mapInArrow(run, f"doc_id {kind}, score double, nearest array<struct<doc_id:long,cosine:double,toxic:int>>")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "nearest")
