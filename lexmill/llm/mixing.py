"""Mixing sources to target weights by hash-random order and exact budgets (DataFrame functions only).

Every row gets a key, a hash of its own values, which puts each source into a random but repeatable order. A source's
budget is cut in that order: sums of sizes over key ranges, prefix sums over those ranges, and only inside the one range
that holds the cut a running sum over rows. No task ever sees a whole source.

Defined results: a null source is a source of its own, after all others. A null or wordless text has size 0 and is taken
0 words. Rows that are equal in every value read (id, source, text) sit side by side in the order and count as one row of all their words,
which are handed out to them one after the other. An empty table gives an empty result. Other columns are ignored by the plan and
kept by :func:`mix_documents`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, word_count

#: Rows in a key range, about; the only rows that one task sorts for the cut of one source.
RANGE_ROWS = 50_000
#: Below so many sources the table of budgets is broadcast; it has one row of under 200 bytes for each.
BROADCAST_SOURCES = 10_000


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size, the two keys of the random order, and a number (uid, whose high bits are the partition) of each row."""
    text = F.col("text")
    return docs.select(
        "doc_id", "source", word_count(text).alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), text).alias("key"), F.xxhash64(F.lit(seed + 1), F.col("doc_id"), text).alias("tie"), F.monotonically_increasing_id().alias("uid"),
    )


def budgets(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3) -> DataFrame:
    """source, source_size and target of each source: shares by weight of the whole size, none above ``most`` times its source.

    The weights repeat over the sources in code point order, null last. The table has a row for each source, not for
    each document; ranking the sources is its only sort.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = cut(per.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * most))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    # a level: a source gets level * weight, or its cap; it rises as capped sources hand on their excess
    level, capped = 0.0, -1
    while True:
        above = F.col("cap") <= F.col("weight") * F.lit(level)
        taken, left, n = per.agg(
            F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))
        ).first()
        if n == capped or not left:
            break
        capped, level = n, (total - (taken or 0.0)) / left
    return per.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def mix_plan(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3) -> DataFrame:
    """For each source: source_size, target, how many whole epochs it gives, and where in its order the last one ends.

    ``rows`` are those of :func:`sized`, computed already (they're read several times).
    """
    per = budgets(rows, weights, most)
    whole = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")
    per = cut(per.withColumn("epochs", epochs).withColumn("rest", whole - F.col("epochs") * F.col("source_size")))
    bits = max(1, (rows.count() // RANGE_ROWS).bit_length())
    at = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(2**63)).cast("long")), 64 - bits)  # ranges in the order of signed keys
    ranged = rows.withColumn("range", at)
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    before = F.sum("in_range").over(Window.partitionBy("source").orderBy("range")) - F.col("in_range")
    holds = (F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("in_range"))
    want = per.select(F.col("source").alias("of"), "rest")
    edge = sums.withColumn("before", before).join(want, F.col("source").eqNullSafe(F.col("of"))).where(holds)
    edge = edge.select(F.col("of"), F.col("range").alias("edge"), "before", "rest")
    inside = ranged.join(edge, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("edge")))
    inside = inside.groupBy("of", "before", "rest", "key", "doc_id", "tie").agg(F.sum("size").alias("size"))
    run = Window.partitionBy("of").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("before") + F.sum("size").over(run) - F.col("size")
    last = inside.withColumn("start", start).where((F.col("start") < F.col("rest")) & (F.col("rest") <= F.col("start") + F.col("size")))
    cuts = last.select(
        F.col("of").alias("cut_of"), F.struct("key", "doc_id", "tie").alias("cut_at"), (F.col("rest") - F.col("start")).alias("cut_words")
    )
    return per.join(cuts, F.col("source").eqNullSafe(F.col("cut_of")), "left").drop("cut_of")


def _with_taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with key and tie, and source_size, target and taken."""
    plan = cut(plan.select(F.col("source").alias("_of"), "source_size", "target", "epochs", "cut_at", "cut_words"))
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    here = F.struct("key", "doc_id", "tie")
    # equal rows at a cut are numbered: within their partition, and by the sums of those before it
    known = rows.join(plan, F.col("source").eqNullSafe(F.col("_of"))).withColumn("_edge", F.coalesce(here == F.col("cut_at"), F.lit(False))).withColumn("_in", F.shiftright("uid", 33))
    per = known.where("_edge").groupBy(F.col("_of").alias("_e_of"), F.col("_in").alias("_e_in")).count()
    per = per.withColumn("_before", F.sum("count").over(Window.partitionBy("_e_of").orderBy("_e_in")) - F.col("count")).drop("count")
    number = F.row_number().over(Window.partitionBy("_of", "_in").orderBy("uid")) - 1 + F.col("_before")
    edge = known.where("_edge").join(per, F.col("_of").eqNullSafe(F.col("_e_of")) & (F.col("_in") == F.col("_e_in"))).withColumn("_n", number)
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("cut_words") - F.col("_n") * F.col("size")))
    rest = known.where("not _edge").withColumn("_n", F.lit(0).cast("long")).withColumn("_part", F.when(here < F.col("cut_at"), F.col("size")).otherwise(F.lit(0).cast("long")))
    both = edge.withColumn("_part", part).select(*rest.columns).unionByName(rest)
    return both.withColumn("taken", (F.col("epochs") * F.col("size") + F.col("_part")).cast("long"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) of each document."""
    rows = cut(sized(docs, seed))
    out = _with_taken(rows, mix_plan(rows, weights, most))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: int = 0) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a document once for each epoch that takes it; of the one at its source's cut,
    the last copy ends after the words that are taken."""
    names = docs.columns
    plan = mix_plan(cut(sized(docs, seed)), weights, most)
    keep = F.struct(*[F.col(c) for c in names]).alias("_row")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("key"),
                       F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("text")).alias("tie"), F.monotonically_increasing_id().alias("uid"), keep)
    taken = _with_taken(rows, plan).where(F.col("taken") > 0).select("_row", "taken", "size")
    whole, part = F.expr("cast(taken div size as int)"), (F.col("taken") % F.col("size")).cast("int")
    words = F.slice(F.split(F.col("_row.text"), f"(?<=[^{SPACE}])(?=[{SPACE}])"), F.lit(1), F.greatest(F.col("_part"), F.lit(1)))
    copies = F.array_repeat(F.lit(0), F.col("_whole"))
    copies = F.when(F.col("_part") > 0, F.concat(copies, F.array(F.col("_part")))).otherwise(copies)
    taken = taken.select("_row", whole.alias("_whole"), part.alias("_part")).select("_row", "_part", F.explode(copies).alias("_cut"))
    text = F.when(F.col("_cut") > 0, F.array_join(words, "")).otherwise(F.col("_row.text"))
    out = {c: F.col("_row")[c] for c in names} | {"text": text}
    if "n_chars" in names:
        out["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return taken.select(*[out[c].alias(c) for c in names])
