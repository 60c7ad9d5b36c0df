"""Token ids in binary files: each document compressed alone, with a zstandard dictionary that all share.

A shard holds, in ascending doc_id order: magic, version, bytes an id, dictionary hash; a frame for each document; the index
(doc_id, whether it is null, where its frame starts, number of ids); and last the index's place and length and the magic again. So a
reader finds one short document with two reads and without the rest. The dictionary lies beside the shards, by its hash.

Shards are ranges of doc_id, found from that column alone; a task streams its shard to a file named for this attempt, and
only files in the manifest that the tasks return count, so a repeated or lost task does no harm.

Defined results: a null text has only the end id. Null doc_ids come first. Rows of equal doc_id lie in the order of their
frames. An empty table gives no shards. Other columns aren't read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import word_bpe
from .common import batched

MAGIC = b"LXMT"
HEAD = "<4sHHQ"
FOOT = "<QQ4s"
#: Documents that the dictionary is trained on, about (chosen by a hash of doc_id), and its size in bytes.
SAMPLE = 2000
DICTIONARY = 64 * 1024
#: Documents in a shard, about.
SHARD_ROWS = 8_000


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _width(path: str) -> int:
    return 2 if word_bpe.tokenizer(path).get_vocab_size() <= 0x10000 else 4


@cache
def _zstd(dictionary: bytes):
    import zstandard

    kept = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=kept), zstandard.ZstdDecompressor(dict_data=kept)


def dictionary_hash(dictionary: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(dictionary)


def train(docs: DataFrame, path: str, end_id: int, sample: int = SAMPLE, size: int = DICTIONARY, head: int = 1 << 20) -> bytes:
    """A dictionary for the serialized ids of about ``sample`` documents, of very long ones the first ``head`` bytes; empty where there are too few to train one."""
    import zstandard

    width = _width(path)
    every = max(1, docs.count() // sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.append(x, np.array([end_id], "<u4")).astype(f"<u{width}").tobytes()[:head] for x in word_bpe.encode(path, b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select(F.col("text").cast("string"))
    samples = sorted(bytes(r.ids) for r in batched(some).mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(docs: DataFrame, path: str, to: str, end_id: int = 1, shard_rows: int = SHARD_ROWS) -> list[dict]:
    """Encodes ``docs`` into shards under the folder ``to``; the manifest, a row for each shard in doc_id order."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string"))
    dictionary, width = train(docs, path, end_id), _width(path)
    of = dictionary_hash(dictionary)
    files, root = _files(to)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/{of:016x}.dictionary") as f:
        f.write(dictionary)
    shards = max(1, docs.count() // shard_rows)
    edges = docs.select(F.percentile_approx("doc_id", [k / shards for k in range(1, shards)], max(10_000, 20 * shards))).first()[0] if shards > 1 else []
    edges = np.unique(np.array(edges or [], np.int64))
    shared = spark.sparkContext.broadcast(dictionary)  # DICTIONARY bytes at most

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _zstd(shared.value)[0]
        for b in batches:
            ids, frames, n = b.column(0).cast(pa.int64()), [], []
            for x in word_bpe.encode(path, b.column(1).to_pylist()):
                x = np.append(x, np.array([end_id], "<u4")).astype(f"<u{width}")
                frames.append(pack.compress(x.tobytes()))
                n.append(len(x))
            shard = np.searchsorted(edges, ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), ids, pa.array(n, pa.int64()), pa.array(frames, pa.binary())], ["shard", "doc_id", "n", "frame"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(to)
        done, shard, out = [], None, None

        def close() -> None:
            index = at
            ids = pa.array(held["doc_id"], pa.int64())
            for a in (ids.fill_null(0).to_numpy().astype("<i8"), np.array([x is None for x in held["doc_id"]], "u1"), np.array(held["at"], "<u8"), np.array(held["n"], "<u8")):
                out.write(a.tobytes())
            out.write(struct.pack(FOOT, index, len(ids), MAGIC))
            out.close()
            done.append((shard, name, len(ids), sum(held["n"])))

        for b in batches:
            for s, doc_id, n, frame in zip(*(c.to_pylist() for c in b.columns)):
                if s != shard:
                    if out:
                        close()
                    shard, name = s, f"{s:08d}-{uuid.uuid4().hex}.tokens"
                    out, held = files.open_output_stream(f"{root}/{name}"), {"doc_id": [], "at": [], "n": []}
                    out.write(struct.pack(HEAD, MAGIC, 1, width, of))
                    at = struct.calcsize(HEAD)
                for k, v in (("doc_id", doc_id), ("at", at), ("n", n)):
                    held[k].append(v)
                out.write(frame)
                at += len(frame)
        if out:
            close()
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], ["shard", "file", "docs", "tokens"])

    rows = batched(docs).mapInArrow(encode, "shard int, doc_id long, n long, frame binary").repartition(len(edges) + 1, "shard")
    made = rows.sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "frame").mapInArrow(store, "shard int, file string, docs long, tokens long").collect()
    made = sorted(made)
    starts = [0, *accumulate(r.tokens for r in made)]
    return [r.asDict() | {"uri": f"{to}/{r.file}", "start": s} for r, s in zip(made, starts)]


class Shard:
    """A shard opened for reading: its index is read, frames only as they're asked for."""

    def __init__(self, uri: str):
        files, path = _files(uri)
        self.file = files.open_input_file(path)
        magic, _, self.width, of = struct.unpack(HEAD, self.file.read_at(struct.calcsize(HEAD), 0))
        end = self.file.size()
        self.index, n, tail = struct.unpack(FOOT, self.file.read_at(struct.calcsize(FOOT), end - struct.calcsize(FOOT)))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError(f"not a token shard: {uri}")
        raw = self.file.read_at(end - struct.calcsize(FOOT) - self.index, self.index)
        self.doc_ids = np.frombuffer(raw, "<i8", n, 0)
        self.null = np.frombuffer(raw, "u1", n, 8 * n).astype(bool)
        self.at = np.append(np.frombuffer(raw, "<u8", n, 9 * n), np.uint64(self.index)).astype(np.int64)
        self.n = np.frombuffer(raw, "<u8", n, 17 * n).astype(np.int64)
        with files.open_input_file(f"{path.rpartition('/')[0]}/{of:016x}.dictionary") as f:
            dictionary = f.read()
        if dictionary_hash(dictionary) != of:
            raise ValueError("the dictionary isn't the one that the shard was written with")
        self.zstd = _zstd(dictionary)[1]

    def ids(self, k: int) -> np.ndarray:
        """Of the k-th document of the shard."""
        frame = self.file.read_at(int(self.at[k + 1] - self.at[k]), int(self.at[k]))
        return np.frombuffer(self.zstd.decompress(frame, max_output_size=int(self.n[k]) * self.width), f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> np.ndarray | None:
        known = int(self.null.sum())
        k = known + int(np.searchsorted(self.doc_ids[known:], doc_id))
        return self.ids(k) if k < len(self.n) and self.doc_ids[k] == doc_id else None


def read(spark: SparkSession, manifest: list[dict], with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document in the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard = Shard(uri)
                for low in range(0, len(shard.n), 1000):
                    part = range(low, min(low + 1000, len(shard.n)))
                    ids = [shard.ids(k) for k in part]
                    n = np.array([len(x) for x in ids], np.int64)
                    columns = [pa.array(shard.doc_ids[low : part.stop], mask=shard.null[low : part.stop]), pa.array(start + np.cumsum(n) - n), pa.array(n),
                               pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                    start += int(n.sum())
                    yield pa.RecordBatch.from_arrays(columns + [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))] * with_ids, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    where = spark.createDataFrame([(m["uri"], m["start"]) for m in manifest], "uri string, start long").repartition(max(1, len(manifest)))
    return where.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def remove(to: str) -> None:
    files, root = _files(to)
    files.delete_dir(root)
