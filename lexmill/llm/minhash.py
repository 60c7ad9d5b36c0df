"""MinHash near-duplicates by an LSH forest, each link confirmed on full shingle sets.

Exact copies (equal sets) fall into one class first, so a group of copies costs one row each and no pairs. Each class has a signature;
each tree of the forest takes another part of the signatures as its prefix, and classes with a common prefix are candidates, all pairs of
them: where more than ``crowd`` share one, they're compared block by block in as many tasks as there are pairs of blocks. Candidates
that their whole signatures place far below the threshold are dropped (by six standard deviations); the rest form clusters by the components
of their graph, and in each cluster every pair is compared on the full sets, by products of 0/1 matrices over the shingles
that at least two members have. Only a spanning set of the confirmed links leaves a task. Clusters of many members are compared block by block.

Defined results: a text without words has an empty set and is linked with nothing. A text of fewer words than a shingle is
one shingle. Rows of equal doc_id count as one document; null doc_ids belong to no component and are kept. Shingles are
compared by 64-bit hashes of 64-bit word hashes. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, cut
from .components import components

HASHES = 64
TREES = 20
#: Values in a prefix.
DEPTH = 3
#: Members of a cluster that one task compares at a time.
BLOCK = 1000
#: Below so many documents to look at closely, their ids (8 bytes each) are broadcast.
BROADCAST_IDS = 500_000

_RANDOM = np.random.RandomState(20)
_A = (_RANDOM.randint(0, 2**32, HASHES, np.uint64) << np.uint64(32) | _RANDOM.randint(0, 2**32, HASHES, np.uint64)) | np.uint64(1)
_B = _RANDOM.randint(0, 2**32, HASHES, np.uint64) << np.uint64(32) | _RANDOM.randint(0, 2**32, HASHES, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of a text, as ascending 64-bit hashes; A to Z count as lower case."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # of bytes: only A to Z, only U+0020 and U+0009 to U+000D
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, 2**64 - 1, np.uint64)
    for k in range(0, len(found), 2048):
        np.minimum(low, (np.multiply.outer(_A, found[k : k + 2048]) + _B[:, None]).min(1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, and its signature (null for an empty one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, one, two, sig = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text, width)
                n.append(len(s))
                one.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                two.append(int(np.bitwise_xor.reduce(mixed(s)).view(np.int64)) if len(s) else 0)
                sig.append(signature(s).tobytes() if len(s) else None)
            columns = [pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *columns], ["doc_id", "n_shingles", "h1", "h2", "signature"])

    wanted = docs.select("doc_id", F.col("text").cast("string"))
    return batched(wanted).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, signature binary")


def trees(classes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """For each class and tree: node, key (a hash of the tree's prefix), and a byte of each value of the signature."""
    order = [[(depth * t + k) % HASHES for k in range(depth)] for t in range(TREES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
            short = pa.array([x.tobytes() for x in (sig & 0xFF).astype(np.uint8)], pa.binary())
            for t in range(TREES):
                h = np.full(len(sig), t + 1, np.uint64)
                for c in order[t]:
                    h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, c])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h.view(np.int64)), short], ["node", "key", "short"])

    return batched(classes).mapInArrow(run, "node long, key long, short binary")


def _local(n: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest member that each of ``n`` reaches by ``pairs``."""
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        new = root.copy()
        for side in (0, 1):
            np.minimum.at(new, root[pairs[:, side]], low)
            np.minimum.at(new, pairs[:, side], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _stars(nodes: np.ndarray, root: np.ndarray, out: list) -> None:
    at = np.flatnonzero(root != np.arange(len(root)))
    out.extend(zip(nodes[at].tolist(), nodes[root[at]].tolist()))


def _links(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])


def _grown(short: np.ndarray, block: np.ndarray, agree: int) -> np.ndarray:
    """The first member of each one's component, where pairs agree in ``agree`` bytes or more; of two blocks, only pairs across."""
    root, across = np.arange(len(short)), block.min() < block.max()
    rest, values = root.copy(), short
    while len(rest) > 1:
        first = int(rest[0])
        queue, rest, values = [first], rest[1:], values[1:]
        while queue and len(rest):
            at = queue.pop()
            near = (values == short[at]).sum(1) >= agree
            if across:
                near &= block[rest] != block[at]
            if near.any():
                root[rest[near]] = first
                queue.extend(rest[near].tolist())
                rest, values = rest[~near], values[~near]
    return root


def candidates(forest: DataFrame, least: float, crowd: int) -> DataFrame:
    """Links a, b that join the classes which share a tree's prefix and whose signatures agree in a share of ``least`` or more."""
    agree = int(HASHES * least)
    rows = forest.withColumns({"block": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
    blocks = F.ceil(F.col("count") / crowd).cast("int")
    crowded = cut(forest.groupBy("key").count().where(F.col("count") > crowd).select("key", blocks.alias("blocks")))
    n = crowded.count()
    if n:
        # each pair of blocks is a task's group, so that no task holds more than about two blocks
        rows = forest.join(F.broadcast(crowded) if n <= BROADCAST_IDS else crowded, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        rows = rows.select("key", "node", "short", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty((0, 3), np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, HASHES), np.uint8)]

        def work(group: np.ndarray, block: np.ndarray, nodes: np.ndarray, short: np.ndarray) -> pa.RecordBatch:
            out: list = []
            start = np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(1)))[: len(group)]
            stop = np.append(start[1:], len(group))
            some = stop - start > 1
            for a, z in zip(start[some].tolist(), stop[some].tolist()):
                if z - a == 2:
                    if (short[a] == short[a + 1]).sum() >= agree:  # of one block, or of two
                        out.append((int(nodes[a + 1]), int(nodes[a])))
                else:
                    _stars(nodes[a:z], _grown(short[a:z], block[a:z], agree), out)
            return _links(out)

        for b in batches:
            group = np.stack([b.column(c).to_numpy().astype(np.int64) for c in range(3)], 1)
            short = np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint8).reshape(-1, HASHES)
            now = [np.concatenate(x) for x in zip(rest, (group, b.column(3).to_numpy().astype(np.int64), b.column(4).to_numpy(), short))]
            differ = np.flatnonzero((now[0] != now[0][-1:]).any(1))
            last = int(differ[-1]) + 1 if len(differ) else 0
            if last:
                yield work(*[x[:last] for x in now])
            rest = [x[last:] for x in now]
        yield work(*rest)

    rows = rows.select("key", "i", "j", "block", "node", "short")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(run, "a long, b long").distinct()


def confirmed(docs: DataFrame, clusters: DataFrame, width: int, share: int) -> DataFrame:
    """A spanning set of the links a, b with 100 * intersection >= share * union, from comparing all members of each cluster."""
    sizes = clusters.groupBy("root").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    members = clusters.join(sizes, "root").select("node", F.col("root").alias("cluster"), blocks.alias("blocks"))
    members = cut(members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    if members.count() <= BROADCAST_IDS:
        members = F.broadcast(members)
    texts = docs.select(F.col("doc_id").alias("node"), F.col("text").cast("string").alias("text")).join(members, "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t, width).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(found, pa.binary())], ["node", "cluster", "blocks", "block", "found"])

    texts = texts.select(F.col("node").cast("long"), "text", "cluster", "blocks", "block")
    found = batched(texts).mapInArrow(sets, "node long, cluster long, blocks int, block int, found binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    found = found.select("node", "cluster", "block", "found", other)
    found = found.select("node", "found", "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(nodes: list[int], found: list[bytes], out: list) -> None:
        sets = [np.frombuffer(x, np.uint64) for x in found]
        n = np.array([len(x) for x in sets])
        if len(sets) == 2:
            both = len(np.intersect1d(sets[0], sets[1], assume_unique=True)) if 100 * n.min() >= share * n.max() else 0
            if 100 * both >= share * (n.sum() - both) and both:
                out.append((nodes[0], nodes[1]))
            return
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), n)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        first = np.flatnonzero(np.diff(every, prepend=every[:1] - np.uint64(1)))
        count = np.diff(np.append(first, len(every)))
        column = np.repeat(np.where(count > 1, np.cumsum(count > 1) - 1, -1), count)
        owner, column = owner[column >= 0], column[column >= 0]
        both = np.zeros((len(sets), len(sets)), np.float32)
        edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + 2048, 2048))
        for a, z in zip(edges, edges[1:]):
            part = np.zeros((len(sets), 2048), np.float32)
            part[owner[a:z], column[a:z] % 2048] = 1
            both += part @ part.T
        both = both.astype(np.float64)
        total = n[:, None] + n[None, :] - both
        pairs = np.argwhere(np.triu((100 * both >= share * total) & (both > 0), 1))
        _stars(np.array(nodes, np.int64), _local(len(nodes), pairs), out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, found = None, [], []
        for b in batches:
            out: list = []
            for key, node, x in zip(zip(*(c.to_pylist() for c in b.columns[:3])), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if key != now:
                    if len(nodes) > 1:
                        compare(nodes, found, out)
                    now, nodes, found = key, [], []
                nodes.append(node)
                found.append(x)
            yield _links(out)
        out = []
        if len(nodes) > 1:
            compare(nodes, found, out)
        yield _links(out)

    keyed = found.select("cluster", "i", "j", "node", "found").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node")
    return keyed.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, share: int = 80, crowd: int = 2000, least: float = 0.5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the component's first document) of each row."""
    rows = cut(sketches(docs, width))
    same = ["h1", "h2", "n_shingles"]
    some = rows.where("n_shingles > 0 and doc_id is not null")
    classes = cut(some.groupBy(*same).agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature")))
    links = candidates(trees(classes.select("node", "signature")), least, crowd)
    clusters = cut(components(links))
    found = components(confirmed(docs, clusters, width, share))
    roots = classes.drop("signature").join(found, "node", "left").select(*same, F.coalesce("root", "node").alias("root"))
    ids = rows.drop("signature").join(roots, same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return ids.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def first_of_each(docs: DataFrame, width: int = 5, share: int = 80) -> DataFrame:
    """``docs`` without the documents that aren't the first of their component; rows of equal doc_id share a verdict."""
    gone = near_duplicates(docs, width, share).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = cut(gone)
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
