"""Integer n-gram counts: counting, merging, splitting, minimum counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import back_off, counted_ngrams


def int_counts(sents: DataFrame, order: int, limit_unknown: bool = False) -> DataFrame:
    """source, ord, hist, word, cnt."""
    found = counted_ngrams(sents, order, limit_unknown).groupBy("source", "hist", "word").agg(F.sum("n").alias("cnt"))
    return found.select("source", (F.size("hist") + 1).alias("ord"), "hist", "word", "cnt")


def merge_int_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("ord", "hist", "word").agg(F.sum("cnt").alias("cnt"))


def split_of(pieces: int, divisor: int = 1) -> Column:
    """Which of ``pieces`` splits a history belongs to, by its most recent word."""
    return F.expr(f"cast((hist[0] div {int(divisor)}) % {int(pieces)} as int)")


def subset(counts: DataFrame, ratio: int, divisor: int = 1) -> DataFrame:
    """The first of ``ratio`` splits, of training and held-out counts alike."""
    return counts.where(split_of(ratio, divisor) == 0)


def of_order(counts: DataFrame, order: int) -> DataFrame:
    return counts.where(F.col("ord") == order)


def tallies(counts: DataFrame) -> DataFrame:
    """ord, ngrams and total: different n-grams and occurrences of each order."""
    return counts.groupBy("ord").agg(F.count("*").alias("ngrams"), F.sum("cnt").alias("total"))


def parse_min_counts(given: str, order: int, names: list[str]) -> dict[int, dict[str, float]]:
    """'2,3' for orders 3 and up, or 'name=2,3 default=2': the minimum of each order and source. The last one repeats; surplus ones go."""
    per: dict[str, list[float]] = {}
    for part in given.split():
        name, _, values = part.rpartition("=")
        per[name or "default"] = [float(x) for x in values.split(",")]
    unused = set(per) - set(names) - {"default"}
    if unused:
        raise ValueError(f"minimum counts for unknown sources: {sorted(unused)}")
    out: dict[int, dict[str, float]] = {o: {} for o in range(3, order + 1)}
    for name in names:
        values = per.get(name, per.get("default"))
        if values is None:
            raise ValueError(f"no minimum count for {name}")
        if any(v < 1 for v in values) or values != sorted(values):
            raise ValueError(f"minimum counts must be 1 or more and not fall: {values}")
        values = (values + [values[-1]] * order)[: max(0, order - 2)]
        for o, v in zip(range(3, order + 1), values):
            out[o][name] = v
    return out


def enforce_min_counts(counts: DataFrame, order: int, least: dict[int, dict[str, float]]) -> tuple[DataFrame, DataFrame]:
    """Counts after small n-grams of orders 3 and up moved to their shorter histories, and what each history lost (source, hist, discount).

    An n-gram stays if its count, with what moved to it, reaches its source's minimum, or if the raw counts of all sources of it and of longer
    n-grams that end in it, each over its own minimum, sum to one.
    """
    minimum = F.create_map(*[F.lit(x) for o, per in least.items() for s, v in per.items() for x in (f"{o} {s}", v)]) if least else None
    moved_in, done, lost = None, [], None
    raw = counts
    for o in range(order, 2, -1):
        of = F.try_element_at(minimum, F.concat_ws(" ", F.lit(o), F.col("source")))
        longer = raw.where(F.col("ord") >= o)
        weight = longer.groupBy(F.slice("hist", 1, o - 1).alias("hist"), "word").agg(F.sum(F.col("cnt") / F.try_element_at(minimum, F.concat_ws(" ", F.col("ord"), F.col("source")))).alias("w"))
        now = raw.where(F.col("ord") == o).select("source", "hist", "word", "cnt")
        if moved_in is not None:
            now = now.union(moved_in).groupBy("source", "hist", "word").agg(F.sum("cnt").alias("cnt"))
        judged = now.join(weight, ["hist", "word"]).withColumn("stays", (F.col("cnt") >= F.floor(of)) | (F.col("w") >= 0.999))
        done.append(judged.where("stays").select("source", F.lit(o).alias("ord"), "hist", "word", "cnt"))
        going = judged.where("not stays")
        gone = going.groupBy("source", "hist").agg(F.sum("cnt").alias("discount"))
        lost = gone if lost is None else lost.union(gone)
        moved_in = going.select("source", back_off().alias("hist"), "word", "cnt")
    now = raw.where(F.col("ord") == 2).select("source", "hist", "word", "cnt")
    if moved_in is not None:
        now = now.union(moved_in).groupBy("source", "hist", "word").agg(F.sum("cnt").alias("cnt"))
    out = now.select("source", F.lit(2).alias("ord"), "hist", "word", "cnt")
    for part in done:
        out = out.unionByName(part)
    if lost is None:
        lost = raw.where("false").select("source", "hist", F.col("cnt").alias("discount"))
    # a history that lost all it had stays only as long as something backs off to it
    used = out.select("hist").distinct()
    for k in range(3, order + 1):
        used = used.union(out.where(F.col("ord") == k).select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(k - 2)), lambda n: F.slice("hist", F.lit(1), n))).alias("hist"))).distinct()
    return out, lost.groupBy("source", "hist").agg(F.sum("discount").alias("discount")).join(used.distinct(), "hist", "left_semi").select("source", "hist", "discount")
