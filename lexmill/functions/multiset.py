"""Counts as multisets of piece sizes: their sum and three largest, a mergeable aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KIND = "struct<total:double,top1:double,top2:double,top3:double>"


def of_pieces(n: Column, size: Column) -> Column:
    """``n`` pieces of one size."""
    return F.struct((n * size).alias("total"), *[F.when(n >= k, size).otherwise(0.0).alias(f"top{k}") for k in (1, 2, 3)]).cast(KIND)


def merged(cnt: str = "cnt") -> Column:
    """The union of a group's multisets. A group has a row for each source and each longer history: no more than words and sources."""
    tops = F.flatten(F.collect_list(F.array(f"{cnt}.top1", f"{cnt}.top2", f"{cnt}.top3")))
    return F.struct(F.sum(f"{cnt}.total").alias("total"), F.slice(F.sort_array(tops, asc=False), 1, 3).alias("tops"))


def merge(counts: DataFrame, *keys: str, salt: str | None = None) -> DataFrame:
    """Merged by ``keys``; by them and ``salt`` first, if given, so that a key with very many rows meets in one task with one row for each salt."""
    m = F.col("m")
    if salt:
        counts = merge(counts, *keys, salt)
    found = counts.groupBy(*keys).agg(merged().alias("m"))
    return found.select(*keys, F.struct(m["total"].alias("total"), *[m["tops"][k].alias(f"top{k + 1}") for k in range(3)]).cast(KIND).alias("cnt"))
