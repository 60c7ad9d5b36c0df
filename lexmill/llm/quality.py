"""Quality rules: robust multivariate outliers by minimum covariance determinant, per language and source.

Each document becomes a vector of transformed statistics. Within each group (language and source) the estimate starts at
the medians and takes concentration steps: the nearest three quarters of the group's rows, by Mahalanobis distance,
give the next mean and covariance, ``STEPS`` times. A step is one distributed aggregate: rows fall into
bins of distance, each with its moments, so that the subset is cut without sorting or gathering a group. A fixed
variance is added to each statistic, so a group in which one never varies still has a distance.

Defined results: null or wordless texts have zero counts and fail the base rules. Null languages and sources are values
like others. Groups with under ``small`` rows share one estimate per language; where that too has under ``small``, theirs is that of all
rows of the language, and where the language has under ``small``, that of all documents, however many. So every row that passes the base rules
has a distance. Repeated rows are judged one by one and alike. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, cut
from .wordstats import STATS, text_stats

#: The share of each group that the covariance is fitted to.
SUBSET = 0.75
#: Rows of clean groups lie beyond the cutoff this rarely, were they normal.
CUTOFF = 0.99999
#: Concentration steps; the subsets hardly change after a few.
STEPS = 6
#: Rows from which a group has an estimate of its own: ten for each statistic.
SMALL = 50
#: Standard deviations added to those found: differences in a statistic that never matter alone.
FLOORS = {"length": 0.06, "symbols": 0.05, "dup_lines": 0.12, "repeats": 0.08, "distinct": 0.04}
#: Below so many rejected documents their ids (8 bytes each) are broadcast.
BROADCAST_IDS = 1_000_000
#: Below so many groups their estimates (under 400 bytes each) are broadcast.
BROADCAST_GROUPS = 20_000


def chi2_cdf(x: float, k: int) -> float:
    """Of the chi-squared distribution, by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of :data:`~.wordstats.STATS`, of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([text_stats(t) for t in b.column(3).to_pylist()], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *[pa.array(found[:, j]) for j in range(len(STATS))]], [*b.schema.names[:3], *STATS])

    wanted = docs.select("doc_id", "lang", "source", F.col("text").cast("string"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema[:3])
    return batched(wanted).mapInArrow(run, kinds + "".join(f", {c} long" for c in STATS))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics, in the order of :data:`FLOORS`; null for texts without words."""
    words, lines = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("n_lines"), F.lit(0))
    return [
        F.log(F.col("word_chars") / words), F.sqrt(F.col("n_symbols") / F.col("word_chars")), F.col("n_dup_lines") / lines,
        F.col("n_repeat_words") / words, F.log(F.col("n_distinct").cast("double") + 1) / F.log(words.cast("double") + 1),
    ]


def _fit(p: int, floors: np.ndarray):
    """Rows of moments to rows of estimates: the centre, and what makes distances from it (rows of a triangular matrix)."""
    factor = SUBSET / chi2_cdf(chi2_quantile(SUBSET, p), p + 2)

    def run(batches):
        for df in batches:
            centre, white = [], []
            for r in df.itertuples(index=False):
                m = np.asarray(r.first) / r.n
                second = np.zeros((p, p))
                second[np.triu_indices(p)] = np.asarray(r.second) / r.n
                second = np.triu(second) + np.triu(second, 1).T
                cov = (second - np.outer(m, m)) * factor + np.diag(floors**2)
                centre.append(m.tolist())
                white.append(np.linalg.inv(np.linalg.cholesky(cov)).ravel().tolist())
            yield df[["g"]].assign(centre=centre, white=white)

    return run


def distance(p: int) -> Column:
    off = [F.col("x")[j] - F.col("centre")[j] for j in range(p)]
    rows = [sum((F.col("white")[i * p + j] * off[j] for j in range(i + 1)), F.lit(0.0)) for i in range(p)]
    return sum((r * r for r in rows), F.lit(0.0))


def _joined(rows: DataFrame, estimates: DataFrame, groups: int) -> DataFrame:
    return rows.join(F.broadcast(estimates) if groups <= BROADCAST_GROUPS else estimates, "g")


def estimates(rows: DataFrame, floors: list[float], steps: int = STEPS) -> DataFrame:
    """centre and white of each group g of ``rows`` (g, x array of doubles), which are computed already."""
    p = len(floors)
    # medians, from counts on a fixed grid
    grid = rows.select("g", F.posexplode(F.transform("x", lambda v: F.round(v * 1000).cast("long"))).alias("j", "v"))
    grid = grid.groupBy("g", "j", "v").count()
    w = Window.partitionBy("g", "j")
    middle = grid.withColumn("upto", F.sum("count").over(w.orderBy("v"))).withColumn("all", F.sum("count").over(w))
    middle = middle.where(2 * F.col("upto") >= F.col("all")).groupBy("g", "j").agg((F.min("v") / 1000).alias("m"), F.first("all").alias("n"))
    start = middle.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("j", "m"))).alias("c"), F.first("n").alias("n"))
    white = F.array(*[F.lit(1 / floors[i] if i == j else 0.0) for i in range(p) for j in range(p)])
    now = cut(start.select("g", "n", F.col("c.m").alias("centre"), white.alias("white")))
    sizes, groups = now.select("g", F.ceil(F.col("n") * SUBSET).alias("h")), now.count()
    now = now.drop("n")
    products = [(i, j) for i in range(p) for j in range(i, p)]
    for _ in range(steps):
        near = _joined(rows, now, groups).select("g", "x", F.floor(F.log(distance(p) + 1e-9) * 32).alias("bin"))
        sums = [F.sum(F.col("x")[i]) for i in range(p)], [F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in products]
        bins = near.groupBy("g", "bin").agg(F.count("*").alias("n"), *[s.alias(f"a{k}") for k, s in enumerate(sums[0])], *[s.alias(f"b{k}") for k, s in enumerate(sums[1])])
        bins = bins.withColumn("before", F.sum("n").over(Window.partitionBy("g").orderBy("bin")) - F.col("n")).join(sizes, "g")
        taken = bins.where(F.col("before") < F.col("h")).groupBy("g").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(f"a{k}") for k in range(p)]).alias("first"), F.array(*[F.sum(f"b{k}") for k in range(len(products))]).alias("second")
        )
        now = cut(taken.mapInPandas(_fit(p, np.array(floors)), "g string, centre array<double>, white array<double>"))
    return now


def judge(docs: DataFrame, small: int = SMALL, cutoff: float = CUTOFF) -> DataFrame:
    """The counts of each document, base_failed, distance (squared; null where none is taken) and kept."""
    p, limit = len(FLOORS), chi2_quantile(cutoff, len(FLOORS))
    stats = statistics(docs).withColumn("base_failed", base_failed()).withColumn("x", F.when(~F.col("base_failed"), F.array(*vector())))
    stats = cut(stats)
    own = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    pooled, whole, every = (F.to_json(F.struct(*c, F.lit(k).alias("of")), {"ignoreNullFields": "false"}) for c, k in ((["lang"], "small"), (["lang"], "all"), ([], "all")))
    per = stats.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    per = per.withColumn("few", F.col("n") < small)
    in_pool = F.sum(F.when(F.col("few"), F.col("n")).otherwise(0)).over(Window.partitionBy("lang"))
    in_lang = F.sum("n").over(Window.partitionBy("lang"))
    per = per.withColumn("g", F.when(~F.col("few"), own).when(in_pool >= small, pooled).when(in_lang >= small, whole).otherwise(every))
    per = cut(per.select(F.col("lang").alias("gl"), F.col("source").alias("gs"), "g", whole.alias("whole")))
    groups = per.count()
    same = F.col("lang").eqNullSafe(F.col("gl")) & F.col("source").eqNullSafe(F.col("gs"))
    rows = stats.join(F.broadcast(per) if groups <= BROADCAST_GROUPS else per, same, "left")
    fit = rows.where("x is not null").select("g", "whole", "x")
    # fallbacks are fitted to the rows of other groups too
    wide = cut(per.where(F.col("g") == F.col("whole")).select(F.col("g").alias("wide")).distinct())
    mine = fit.where((F.col("g") != F.col("whole")) & (F.col("g") != every)).select("g", "x")
    mine = mine.unionByName(fit.join(F.broadcast(wide) if groups <= BROADCAST_GROUPS else wide, F.col("whole") == F.col("wide")).select(F.col("wide").alias("g"), "x"))
    if per.where(F.col("g") == every).count():
        mine = mine.unionByName(fit.select(every.alias("g"), "x"))
    found = estimates(cut(mine), list(FLOORS.values()))
    rows = rows.withColumn("g", F.when(F.col("x").isNotNull(), F.col("g")))
    rows = rows.join(F.broadcast(found) if groups <= BROADCAST_GROUPS else found, "g", "left").withColumn("distance", distance(p))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True))
    return rows.select("doc_id", "lang", "source", *STATS, "base_failed", "distance", kept.alias("kept"))


def passing(docs: DataFrame, small: int = SMALL, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that are kept; rows of equal doc_id (null counts as one) all go if any is rejected."""
    gone = cut(judge(docs, small, cutoff).where("not kept").select(F.col("doc_id").alias("_gone")).distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")
