"""Best-fit packing of token sequences by swap-based local search.

What is to be packed is a histogram: lengths run from 1 to the size of a sequence, and pieces of one length are alike.
So the driver plans over at most ``size`` numbers, whatever the corpus. Best fit by falling length gives patterns (lengths that share a sequence) with multiplicities
(:func:`first_assignment` is a plainer start, from which the search does nearly all of the work, and takes longer). The search then empties the least filled patterns into others: it moves
a piece where it fits best, else exchanges one for one or two for one, always so that the sum of squared fills grows, for as many sequences of both
patterns at once as there are. It ends when no exchange is left, or no packing can have fewer sequences. A pattern without an exchange is
tried again only against patterns made since. The sum of squares grows with each exchange, so the search ends.

Pieces then get a number within their length: a count in their hash range plus the counts of the ranges before it,
so that a length that a third of all pieces share doesn't meet in one task.

Defined results: null texts are empty, and an empty text is one piece, its end id. Repeated rows are packed each. An
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import encode
from .common import batched, cut

#: With an exchange found, so many patterns are looked at for a better one; without one, all.
ENOUGH = 48
#: Pieces in a hash range of a length, about.
RANGE_ROWS = 50_000
Pattern = tuple[int, ...]


def best_fit(counts: dict[int, int], size: int) -> Counter[Pattern]:
    """Patterns and how often each is used: best fit by falling length over a histogram."""
    open_at: dict[int, Counter[Pattern]] = defaultdict(Counter)  # room left: patterns
    rooms: list[int] = []

    def put(pattern: Pattern, n: int) -> None:
        room = size - sum(pattern)
        if not open_at[room] and n:
            insort(rooms, room)
        open_at[room][pattern] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                pattern, bins, room = (), left, size
            else:
                room = rooms[k]
                pattern, bins = open_at[room].popitem()
                if not open_at[room]:
                    rooms.pop(k)
            each = room // length
            full = min(bins, left // each)
            if full:
                put(pattern + (length,) * each, full)
            left -= full * each
            rest = bins - full
            if left and rest and left < each:
                put(pattern + (length,) * left, 1)
                left, rest = 0, rest - 1
            if rest and pattern:
                put(pattern, rest)
    return Counter({p: n for at in open_at.values() for p, n in at.items() if n})


def first_assignment(counts: dict[int, int], size: int) -> Counter[Pattern]:
    """Patterns of a plain packing: by falling length, each piece into the sequence begun last or a new one."""
    out: Counter[Pattern] = Counter()
    begun: Pattern = ()
    for length in sorted(counts, reverse=True):
        left = counts[length]
        more = min(left, (size - sum(begun)) // length)
        begun, left = begun + (length,) * more, left - more
        if left:
            out[begun] += 1
            each = size // length
            out[(length,) * each] += (left - 1) // each
            begun = (length,) * (left - (left - 1) // each * each)
    out[begun] += 1
    del out[()]
    return +out


class Search:
    """Local search over patterns; ``accepted`` counts the sequences that moves and exchanges of each kind changed."""

    def __init__(self, patterns: Counter[Pattern], size: int):
        self.size, self.patterns, self.accepted = size, Counter(), Counter()
        self.at: dict[int, set[Pattern]] = defaultdict(set)  # by room left
        self.rooms: list[int] = []  # that have patterns, ascending
        self.bins, self.total = 0, 0
        self.stuck: set[Pattern] = set()
        self.fresh: list[Pattern] = []
        for p, n in patterns.items():
            self.put(p, n)
            self.bins += n
            self.total += sum(p) * n

    def put(self, p: Pattern, n: int) -> None:
        room = self.size - sum(p)
        before = self.patterns[p]
        self.patterns[p] += n
        if not before:
            if not self.at[room]:
                insort(self.rooms, room)
            self.at[room].add(p)
            self.fresh.append(p)
        elif not self.patterns[p]:
            del self.patterns[p]
            self.stuck.discard(p)
            self.at[room].remove(p)
            if not self.at[room]:
                self.rooms.pop(bisect_left(self.rooms, room))

    def lowest(self) -> Pattern | None:
        """The least filled pattern that an exchange may be open to."""
        for room in reversed(self.rooms):
            for p in sorted(self.at[room] - self.stuck) if room else ():
                return p
        return None

    def run(self) -> Counter[Pattern]:
        least = -(-self.total // self.size)
        while self.bins > least:
            low = self.lowest()
            if low is None:
                break
            step = self.move(low) or self.exchange(low, self.others(low))
            if step is None:
                self.stuck.add(low)
                continue
            kind, other, new_low, new_other = step
            n = self.patterns[low] // 2 if other == low else min(self.patterns[low], self.patterns[other])
            if not new_low:
                n = min(n, self.bins - least)
            self.fresh = []
            for p, k in ((low, -n), (other, -n), (new_low, n), (new_other, n)):
                if p:
                    self.put(p, k)
            self.bins -= n * (not new_low)
            self.accepted[kind] += n
            made = [p for p in self.fresh if p in self.patterns]
            for p in [p for p in self.stuck if self.exchange(p, [q for q in made if sum(q) >= sum(p)])]:
                self.stuck.discard(p)
        return self.patterns

    def others(self, low: Pattern) -> list[Pattern]:
        """Underfull patterns with no less in them than ``low``, the fullest last."""
        last = self.size - sum(low)
        return [p for room in reversed(self.rooms) if 0 < room <= last for p in sorted(self.at[room])]

    def move(self, low: Pattern) -> tuple[str, Pattern, Pattern, Pattern] | None:
        """The move of a piece of ``low`` that leaves least room where it goes."""
        best = None
        for a in sorted(set(low), reverse=True):
            k = bisect_left(self.rooms, a)
            while k < len(self.rooms) and self.rooms[k] <= self.size - sum(low):
                found = next((p for p in sorted(self.at[self.rooms[k]]) if p != low or self.patterns[p] > 1), None)
                if found is not None:
                    if best is None or self.rooms[k] - a < best[0]:
                        best = (self.rooms[k] - a, a, found)
                    break
                k += 1
        if best is None:
            return None
        _, a, other = best
        return "move", other, _without(low, a), _with(other, a)

    def exchange(self, low: Pattern, others: list[Pattern]) -> tuple[str, Pattern, Pattern, Pattern] | None:
        """The exchange of one for one, or two for one, that adds most to the other pattern; or a move."""
        fill, inner = sum(low), sorted(set(low))
        ones = [(a, (a,)) for a in inner]
        twos = [(a + b, (a, b)) for i, a in enumerate(inner) for b in inner[i:] if a != b or low.count(a) > 1]
        give = sorted(ones + twos)
        sums = [g[0] for g in give]
        best, looked = None, 0
        for other in others:
            room = self.size - sum(other)
            if other == low and self.patterns[low] < 2:
                continue
            for y in (0, *set(other)):
                k = bisect_left(sums, y + room + 1) - 1  # the most that fits
                if k >= 0 and sums[k] > y and (best is None or sums[k] - y > best[0]) and sums[k] - y <= fill:
                    best = (sums[k] - y, other, give[k][1], y)
            looked += 1
            if best and (best[0] == fill or looked >= ENOUGH):
                break
        if best is None:
            return None
        _, other, gone, y = best
        new_low, new_other = _without(low, *gone), _with(_without(other, y) if y else other, *gone)
        kind = "move" if not y else "one for one" if len(gone) == 1 else "two for one"
        return kind, other, _with(new_low, y) if y else new_low, new_other


def _without(p: Pattern, *gone: int) -> Pattern:
    rest = list(p)
    for x in gone:
        rest.remove(x)
    return tuple(rest)


def _with(p: Pattern, *more: int) -> Pattern:
    return tuple(sorted((*p, *more), reverse=True))


def plan(counts: dict[int, int], size: int) -> dict[int, np.ndarray]:
    """For each length, rows of (first number, sequence of that number, offset), ascending: where the pieces of the length go."""
    at: Counter[int] = Counter()
    rows = defaultdict(list)
    first = 0
    for pattern, n in sorted(Search(best_fit(counts, size), size).run().items(), reverse=True):
        offset = 0
        for length in pattern:
            rows[length].append((at[length], first, offset))
            at[length] += n
            offset += length
        first += n
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece, with its ids if asked for."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, out, parts = [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                tokens = np.append(encode(path, text), np.array([end_id], "<u4"))
                n, start = len(tokens), 0
                for piece in range(-(-n // size)):
                    stop = min(n, start + ((n - 1) % size + 1 if piece == 0 else size))
                    of.append(k)
                    out.append((piece, start, stop - start, zlib.crc32(tokens[start:stop].tobytes())))
                    if ids:
                        parts.append(tokens[start:stop].astype(np.int32))
                    start = stop
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, types)]
            columns += [pa.array(parts, pa.list_(pa.int32()))] * ids
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *columns], names)

    wanted = docs.select("doc_id", F.col("text").cast("string"))
    kind = wanted.schema["doc_id"].dataType.simpleString()
    return batched(wanted).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` with the sequence each goes to and its offset there."""
    rows = cut(pieces(docs, path, size, end_id, ids))
    ranges = max(1, rows.count() // RANGE_ROWS)
    rows = rows.withColumn("range", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(ranges)))
    per = cut(rows.groupBy("length", "range").count())
    counts = {r.length: r.n for r in per.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `size` rows
    before = F.sum("count").over(Window.partitionBy("length").orderBy("range")) - F.col("count")
    per = per.select("length", "range", before.alias("before"))
    where = F.row_number().over(Window.partitionBy("length", "range").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = rows.withColumn("place", where).join(per, ["length", "range"]).withColumn("number", F.col("before") + F.col("place"))
    names = [c for c in rows.columns if c != "range"]
    to = docs.sparkSession.sparkContext.broadcast(plan(counts, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    rows = to.value[int(length[part[0]])]
                    row = rows[np.searchsorted(rows[:, 0], number[part], "right") - 1]
                    sequence[part], offset[part] = row[:, 1] + number[part] - row[:, 0], row[:, 2]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "range")
    return batched(numbered.select(*names, "number")).mapInArrow(run, kinds + ", sequence_id long, offset long")
