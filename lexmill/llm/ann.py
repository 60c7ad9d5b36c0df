"""Approximate nearest neighbours by shifted space-filling curves.

Every vector is projected to a few random orthonormal directions, shifted at random, and gets its key on a Hilbert curve, once for each of
several orderings. Each ordering is range-partitioned into blocks of equal numbers of rows, and a query visits the blocks around
its own key: its neighbouring key window. In a block, queries meet candidates by matrix products, and each keeps its
best; the windows of all orderings merge and the exact cosine ranks what they found.

The window is a share of all rows. Vectors without structure, as the synthetic ones, have neighbours hardly nearer than anything
else, and only a share of all rows reaches a given recall; where vectors cluster, a smaller one does.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, as
queries or candidates, nor do rows without an id. Equal ids are the same row: never their own neighbours. Equal vectors tie and
go by id. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batched
from .hilbert import hilbert_keys

ORDERINGS = 6
#: Directions and bits of each in a key.
DIRECTIONS, BITS = 12, 4
#: What a query's window reaches to each side, as a share of all rows.
REACH = 0.1
#: Rows in a block, about; smaller where there would be under BLOCKS of them, but no smaller than LEAST.
BLOCK, BLOCKS, LEAST = 2048, 64, 32
#: Pairs whose exact cosines are worked out at once.
PAIRS = 65_536


def usable(vector: str) -> Column:
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(x.isNotNull() & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, which rounds nothing, so that no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _orderings(dim: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.RandomState(seed)
    m = min(DIRECTIONS, dim)
    return [(np.linalg.qr(rng.standard_normal((dim, m)))[0], rng.random_sample(m)) for _ in range(ORDERINGS)]


def _keys(x: np.ndarray, ids: np.ndarray, orderings) -> list[np.ndarray]:
    """A key of each unit vector in each ordering; its last bits are a hash of the id, so that equal vectors spread over blocks."""
    x = _scaled(x)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
    out = []
    for q, shift in orderings:
        at = (x @ q) * (np.sqrt(x.shape[1]) / 8) + 0.5  # about four standard deviations to each side
        cells = np.clip((at + shift / 4 - 0.125) * 2**BITS, 0, 2**BITS - 1)
        raw = hilbert_keys(cells, BITS)
        key = np.zeros(len(x), np.uint64)
        for c in range(raw.shape[1]):
            key = key << np.uint64(8) | raw[:, c].astype(np.uint64)
        out.append((key << np.uint64(14) | spread).astype(np.int64))
    return out


def nearest(table: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 7, reach: float = REACH) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of each row for which ``queries`` holds."""
    spark = table.sparkSession
    wide = isinstance(table.schema[vector].dataType.elementType, T.FloatType)
    kind = "<f4" if wide else "<f8"
    rows = table.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<float>" if wide else "array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(usable("v") & F.col("id").isNotNull())
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = lengths["d"], lengths["count"]
    rows = rows.where(F.size("v") == dim)
    orderings = _orderings(dim, seed)

    def matrix(b: pa.RecordBatch, c: int) -> np.ndarray:
        return b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for o, key in enumerate(_keys(matrix(b, 1).astype(np.float64), b.column(0).to_numpy(), orderings)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), o, np.int32)), pa.array(key)], ["o", "key"])

    blocks = max(1, min(n // LEAST, max(BLOCKS, n // BLOCK)))
    window = max(1, math.ceil(reach * blocks))
    shares = [j / blocks for j in range(1, blocks)]
    edges = {}
    if shares:
        found = batched(rows.select("id", "v")).mapInArrow(keyed, "o int, key long").groupBy("o")
        found = found.agg(F.percentile_approx("key", shares, max(10_000, 10 * blocks)).alias("edges"))
        edges = {r.o: np.array(r.edges) for r in found.collect()}  # ORDERINGS rows of one number for each block

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column(0).to_numpy(), matrix(b, 1)
            raw = np.array([r.tobytes() for r in x.astype(kind)], object)
            asks = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for o, key in enumerate(_keys(x.astype(np.float64), ids, orderings)):
                at = np.searchsorted(edges[o], key, "right") if edges else np.zeros(len(key), np.int64)
                yield part(o, at, np.ones(len(key), bool), ids, raw)
                for step in range(-window, window + 1):
                    to = at + step
                    some = asks & (to >= 0) & (to < blocks)
                    yield part(o, to[some], np.zeros(int(some.sum()), bool), ids[some], raw[some])

    def part(o: int, at: np.ndarray, found: np.ndarray, ids: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), o, np.int32)), pa.array(at.astype(np.int32)), pa.array(found), pa.array(ids), pa.array(raw.tolist(), pa.binary())], ["o", "block", "found", "id", "v"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def close() -> Iterator[pa.RecordBatch]:
            if state and state["best"] is not None:
                best, score = state["best"], state["score"]
                q = np.repeat(np.concatenate(state["q"]), best.shape[1])
                some = score.ravel() > -2
                yield pa.RecordBatch.from_arrays([pa.array(q[some]), pa.array(best.ravel()[some]), pa.array(score.ravel()[some])], ["query_id", "vec_id", "score"])

        for b in batches:
            o, block = b.column(0).to_numpy(), b.column(1).to_numpy()
            starts = np.flatnonzero((np.diff(o, prepend=o[:1] - 1) != 0) | (np.diff(block, prepend=block[:1] - 1) != 0))
            for a, z in zip(starts, np.append(starts[1:], len(o))):
                here = (o[a], block[a])
                if state is None or state["at"] != here:
                    yield from close()
                    state = {"at": here, "q": [], "qv": [], "best": None, "score": None}
                s = b.slice(a, z - a)
                found = s.column(2).to_numpy(zero_copy_only=False).astype(bool)
                ids = s.column(3).to_numpy()
                x = np.frombuffer(b"".join(s.column(4).to_pylist()), kind).reshape(-1, dim).astype(np.float64)
                x = _scaled(x)
                if not found.all():
                    state["q"].append(ids[~found])
                    state["qv"].append(x[~found])
                if found.any() and state["q"]:
                    _keep(state, ids[found], x[found], k + 3)
        yield from close()

    pairs = batched(rows.select("id", "v", "asks")).mapInArrow(spread, "o int, block int, found boolean, id long, v binary")
    pairs = pairs.repartition("o", "block").sortWithinPartitions("o", "block", "found", "id").mapInArrow(search, "query_id long, vec_id long, score double")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _keep(state: dict, ids: np.ndarray, x: np.ndarray, k: int) -> None:
    """Merges candidates into the best ``k`` of each query. Scores are recomputed pair by pair, so equal vectors tie exactly."""
    q, qv = np.concatenate(state["q"]), np.concatenate(state["qv"])
    nq, nx = np.sqrt(np.einsum("ij,ij->i", qv, qv)), np.sqrt(np.einsum("ij,ij->i", x, x))
    for low in range(0, len(ids), 4096):
        i, v, n = ids[low : low + 4096], x[low : low + 4096], nx[low : low + 4096]
        score = (qv @ v.T) / nq[:, None] / n[None, :]
        score[q[:, None] == i[None, :]] = -9
        # all that reach the k-th best, but for rounding: which of equal ones stay is for their ids to say
        kth = np.partition(score, max(0, len(i) - k), axis=1)[:, max(0, len(i) - k)]
        row, col = np.nonzero((score >= kth[:, None] - 8 * x.shape[1] * np.finfo(float).eps) & (score > -2))
        exact, cand = np.empty(len(row)), i[col]
        for a in range(0, len(row), PAIRS):
            r, c = row[a : a + PAIRS], col[a : a + PAIRS]
            exact[a : a + PAIRS] = np.einsum("ij,ij->i", qv[r], v[c]) / (nq[r] * n[c])
        if state["best"] is not None:
            row = np.concatenate((np.repeat(np.arange(len(q)), k), row))
            cand, exact = np.concatenate((state["best"].ravel(), cand)), np.concatenate((state["score"].ravel(), exact))
        order = np.lexsort((cand, -exact, row))
        row, cand, exact = row[order], cand[order], exact[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        some = place < k
        state["best"], state["score"] = np.zeros((len(q), k), np.int64), np.full((len(q), k), -9.0)
        state["best"][row[some], place[some]], state["score"][row[some], place[some]] = cand[some], exact[some]
