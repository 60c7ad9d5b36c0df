"""Tokens of sentences and their ids."""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS, BOS, EOS, UNK = 0, 1, 2, 3
RESERVED = ("<eps>", "<s>", "</s>", "<unk>")
#: Words of a vocabulary that is broadcast, at most.
IN_PLACE = 500_000
#: In arrays of ids: a null, and no word (before a sentence's start).
NULL, NONE = -(2**40), -1 - 2**31


def tokens(line: Column) -> Column:
    """The white-space separated tokens of a line; null and blank lines have none."""
    return F.coalesce(F.filter(F.split(line, r"\s+"), lambda t: t != ""), F.array().cast("array<string>"))


def sentences(docs: DataFrame, source: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """source, doc, line_no and line of every line of every document."""
    return docs.select(F.col(source).alias("source"), F.col(key).alias("doc"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def is_dev(key: str = "doc_id", every: int = 20) -> Column:
    """Whether a document is held out: one in ``every``, disjoint from training."""
    return F.col(key) % every == 0


def to_ids(lines: DataFrame, vocab: DataFrame) -> DataFrame:
    """``lines`` (source, doc, line_no, line) with ids in place of the line; what the vocabulary lacks, and its control symbols, are unknown.

    A vocabulary of up to :data:`IN_PLACE` words is broadcast, and tokens become ids in place, in Arrow batches, without a shuffle; a larger one joins.
    """
    if vocab.limit(IN_PLACE + 1).count() <= IN_PLACE:
        return _in_place(lines, vocab)
    words = lines.select("source", "doc", "line_no", F.posexplode_outer(tokens(F.col("line"))).alias("pos", "t"))
    ids = words.join(vocab.select(F.col("word").alias("t"), "id"), "t", "left")
    known = F.when(F.col("t").isNotNull(), F.when(F.coalesce(F.col("id"), F.lit(UNK)) <= EOS, F.lit(UNK)).otherwise(F.coalesce("id", F.lit(UNK))))
    in_order = F.sort_array(F.collect_list(F.when(known.isNotNull(), F.struct("pos", known.alias("id")))))
    found = ids.groupBy("source", "doc", "line_no").agg(in_order.alias("s"))
    return found.select("source", "doc", "line_no", F.col("s.id").cast("array<int>").alias("ids"))


def gathered(batches: Iterator[pa.RecordBatch], most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in larger batches, of about ``most`` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def pieces(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns as batches that the JVM takes at once."""
    yield from pa.Table.from_arrays(columns, names).to_batches(max_chunksize=20_000)


def split_lines(lines: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all lines, and where each line's start, with the end of the last."""
    apart = pc.ascii_split_whitespace(pc.fill_null(lines, ""))
    flat, at = apart.flatten(), apart.offsets.to_numpy()
    there = pc.not_equal(flat, "")  # white space at a line's ends
    before = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
    return flat.filter(there), before[at - at[0]].astype(np.int32)


def _in_place(lines: DataFrame, vocab: DataFrame) -> DataFrame:
    known = {r.word: r.id if r.id > EOS else UNK for r in vocab.collect()}  # IN_PLACE words at most
    shared = lines.sparkSession.sparkContext.broadcast((list(known), list(known.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = pa.array(shared.value[0], pa.string()), np.array([UNK, *shared.value[1]], np.int32)
        for b in gathered(batches):
            flat, starts = split_lines(b.column(3))
            found = ids[pc.fill_null(pc.index_in(flat, value_set=words), -1).to_numpy() + 1]
            yield from pieces([*b.columns[:3], pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(found))], ["source", "doc", "line_no", "ids"])

    wanted = lines.select("source", "doc", "line_no", F.col("line").cast("string"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema[:3])
    return wanted.mapInArrow(run, kinds + ", ids array<int>")


def ngrams(sents: DataFrame, order: int, limit_unknown: bool = False) -> DataFrame:
    """source, hist and word of each n-gram of ids: for each token and the sentence's end, the up to ``order`` - 1 tokens before it.

    hist has the most recent first, so that dropping its last element backs off. A history is shorter than asked for only where the
    sentence starts. With ``limit_unknown`` it stops at the first unknown, that included.
    """
    if order < 2:
        raise ValueError("n-grams have an order of 2 at least")
    s = F.concat(F.array(F.lit(BOS)), F.col("ids"), F.array(F.lit(EOS)))
    grams = F.transform(F.sequence(F.lit(2), F.size("s")), lambda p: F.struct(
        F.reverse(F.slice("s", F.greatest(F.lit(1), p - order + 1), F.least(p - 1, F.lit(order - 1)))).alias("hist"), F.element_at("s", p).alias("word")))
    found = sents.withColumn("s", s).select("source", F.explode(grams).alias("g")).select("source", "g.hist", "g.word")
    if limit_unknown:
        at = F.array_position("hist", F.lit(UNK)).cast("int")
        found = found.withColumn("hist", F.when(at > 0, F.slice("hist", F.lit(1), at)).otherwise(F.col("hist")))
    return found


def counted_ngrams(sents: DataFrame, order: int, limit_unknown: bool = False) -> DataFrame:
    """source, hist, word and n of the n-grams of :func:`ngrams`, counted in each batch of sentences: an n-gram comes once for each that has it."""
    if order < 2:
        raise ValueError("n-grams have an order of 2 at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, 4_000_000):
            b = b.filter(pc.is_valid(b.column(1)))
            flat, starts = b.column(1).flatten(), b.column(1).offsets.to_numpy()
            size = np.diff(starts)
            if not len(size):
                continue
            ends = np.cumsum(size + 2)
            first = ends - size - 2
            s = np.empty(ends[-1], np.int64)
            inner = np.ones(len(s), bool)
            inner[first], inner[ends - 1] = False, False
            s[first], s[ends - 1], s[inner] = BOS, EOS, pc.fill_null(flat.cast(pa.int64()), NULL).to_numpy()
            names = b.column(0).dictionary_encode(null_encoding="encode")
            at = np.delete(np.arange(len(s)), first)
            place = (np.arange(len(s)) - np.repeat(first, size + 2))[at]
            columns = [np.repeat(names.indices.to_numpy(), size + 1).astype(np.int64)]
            for k in range(1, order):
                h = np.where(place >= k, s[np.maximum(at - k, 0)], NONE)
                if limit_unknown and k > 1:
                    h[(columns[-1] == UNK) | (columns[-1] == NONE)] = NONE
                columns.append(h)
            columns, n = _different([*columns, s[at]])
            hists, word = np.stack(columns[1:-1], 1), columns[-1]
            there = hists != NONE
            flat = hists[there]
            starts = np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32)
            hist = pa.ListArray.from_arrays(pa.array(starts), pa.array(flat.astype(np.int32), mask=flat == NULL))
            yield from pieces([names.dictionary.take(pa.array(columns[0])), hist, pa.array(word.astype(np.int32), mask=word == NULL), pa.array(n)], ["source", "hist", "word", "n"])

    kind = sents.schema["source"].dataType.simpleString()
    return sents.select("source", F.col("ids").cast("array<int>")).mapInArrow(run, f"source {kind}, hist array<int>, word int, n long")


def _different(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of ``columns``, and how often each comes: by one number for each row where that fits, else sorted by all columns."""
    lows = [int(c.min()) for c in columns]
    widths = [int(c.max()) - low + 1 for c, low in zip(columns, lows)]
    if prod(widths) < 2**62:
        key = np.zeros(len(columns[0]), np.int64)
        for c, low, width in zip(columns, lows, widths):
            key = key * width + (c - low)
        key, n = np.unique(key, return_counts=True)
        out = []
        for low, width in zip(lows[::-1], widths[::-1]):
            key, rest = np.divmod(key, width)
            out.append(rest + low)
        return out[::-1], n
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.diff(np.append(at, len(order)))


def back_off(hist: str | Column = "hist") -> Column:
    """The history without its farthest word."""
    h = F.col(hist) if isinstance(hist, str) else hist
    return F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0)))


def shown(hist: str = "hist") -> Column:
    return F.concat_ws(" ", F.transform(hist, lambda x: x.cast("string")))
