"""What else is done with tables of counts: printing, checking, splitting and merging, perturbing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import EOS, shown
from .counts import split_of
from .model import Model


def _history() -> Column:
    return F.concat(F.lit(" [ "), F.when(F.size("hist") > 0, F.concat(shown(), F.lit(" "))).otherwise(""), F.lit("]: "))


def _listed(value: Column) -> Column:
    each = F.sort_array(F.collect_list(F.struct("word", value.alias("v"))))
    return F.concat_ws("", F.transform(each, lambda x: F.concat(x["word"].cast("string"), F.lit("->"), x["v"], F.lit(" "))))


def int_counts_text(counts: DataFrame, lost: DataFrame | None = None) -> DataFrame:
    """source, hist and line: a printed line for each history of integer counts, with what minimum counts took from it."""
    per = counts.groupBy("source", "hist").agg(F.sum("cnt").alias("total"), _listed(F.col("cnt").cast("string")).alias("each"))
    if lost is not None:
        per = per.join(lost, ["source", "hist"], "full_outer")
    took = F.coalesce(F.col("discount"), F.lit(0)) if lost is not None else F.lit(0)
    said = F.when(took != 0, F.concat(F.lit("discount="), took.cast("string"), F.lit(" "))).otherwise("")
    total = (F.coalesce("total", F.lit(0)) + took).cast("string")
    return per.select("source", "hist", F.concat(_history(), F.lit("total="), total, F.lit(" "), said, F.coalesce("each", F.lit(""))).alias("line"))


def model_text(model: Model) -> DataFrame:
    """hist and line: a printed line for each state of a model, numbers with six significant digits."""
    from ..sources.arpa import number

    per = model.counts.groupBy("hist").agg(_listed(number(F.col("count"))).alias("each"))
    found = model.states.join(per, "hist", "left")
    return found.select("hist", F.concat(_history(), F.lit("total="), number(F.col("total")), F.lit(" discount="), number(F.col("discount")), F.lit(" "), F.coalesce("each", F.lit(""))).alias("line"))


def history_text(protected: DataFrame) -> DataFrame:
    """hist and line: a printed line for each history of a set of n-grams."""
    words = F.concat_ws("", F.transform(F.sort_array(F.collect_list("word")), lambda x: F.concat(x.cast("string"), F.lit(" "))))
    return protected.groupBy("hist").agg(words.alias("each")).select("hist", F.concat(_history(), "each").alias("line"))


def split_model(model: Model, pieces: int) -> DataFrame:
    """split, ord, hist, word, count, total and discount: histories by their most recent word; the empty one is in every split."""
    whole = model.counts.join(model.states.select("hist", "total", "discount"), "hist")
    longer = whole.where("ord > 1").withColumn("split", split_of(pieces))
    first = whole.where("ord = 1").withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    return longer.unionByName(first).select("split", "ord", "hist", "word", "count", "total", "discount")


def merge_model(parts: DataFrame, order: int, num_words: int) -> Model:
    """The model that :func:`split_model` split. A history in several splits must have the same counts in each; :func:`merge_problems` says where not."""
    once = parts.drop("split").dropDuplicates(["hist", "word"])
    return Model(once.select("ord", "hist", "word", "count"), once.select("ord", "hist", "total", "discount").dropDuplicates(["hist"]), order, num_words)


def merge_problems(parts: DataFrame) -> DataFrame:
    """hist and word of n-grams that differ between splits, or that some of their history's splits lack."""
    splits = parts.groupBy("hist").agg(F.countDistinct("split").alias("of"))
    found = parts.groupBy("hist", "word").agg(F.countDistinct("count", "total", "discount").alias("kinds"), F.countDistinct("split").alias("n")).join(splits, "hist")
    return found.where("kinds > 1 or n <> of").select("hist", "word")


def sentence_problems(sents: DataFrame, num_words: int) -> DataFrame:
    """What is wrong with sentences of ids (source, ids): ids out of the vocabulary or of control symbols, sources without sentences with words."""
    ids = sents.select("source", F.explode("ids").alias("id"))
    bad = ids.where((F.col("id") <= EOS) | (F.col("id") > num_words) | F.col("id").isNull()).groupBy("source").agg(F.count("*").alias("n"))
    empty = sents.groupBy("source").agg(F.max(F.size("ids")).alias("most")).where("most <= 0")
    return bad.select(F.concat(F.lit("ids out of range in "), "source", F.lit(": "), F.col("n").cast("string")).alias("problem")).union(empty.select(F.concat(F.lit("no words in "), "source")))


def count_problems(counts: DataFrame, order: int, num_words: int) -> DataFrame:
    """What is wrong with integer counts: counts below 1, histories of another length than the order says, words out of range, orders without n-grams."""
    bad = {"counts under 1 in ": "cnt < 1 or cnt is null", "orders that aren't the histories' in ": "size(hist) + 1 <> ord", "words out of range in ": f"word < {EOS} or word > {num_words}"}
    # one look at the counts: a row for each source and order, of which all else is made
    per = counts.groupBy("source", "ord").agg(*[F.max(F.coalesce(F.expr(x), F.lit(False))).alias(f"bad{k}") for k, x in enumerate(bad.values())])
    said = F.array(*[F.when(F.col(f"bad{k}"), F.concat(F.lit(text), "source")) for k, text in enumerate(bad)])
    missing = F.array_except(F.sequence(F.lit(2), F.lit(order)), F.coalesce(F.collect_set("ord"), F.array().cast("array<int>"))) if order >= 2 else F.array().cast("array<int>")
    lacks = F.transform(missing, lambda o: F.concat(F.lit("no n-grams of order "), o.cast("string")))
    found = per.agg(F.flatten(F.collect_set(said)).alias("said"), lacks.alias("lacks"))
    every = found.select(F.explode(F.concat("said", "lacks")).alias("problem"))
    return every.where("problem is not null").distinct()


def derivative_problems(found: dict[str, float], names: list[str], order: int) -> list[str]:
    """What is wrong with derivatives: names that miss or are too many, numbers that aren't finite."""
    wanted = {f"scale_{n}" for n in names} | {f"order{o}_D{k}" for o in range(2, order + 1) for k in (1, 2, 3, 4)}
    bad = [f"no derivative by {k}" for k in sorted(wanted - set(found))] + [f"a derivative by {k}" for k in sorted(set(found) - wanted)]
    bad += [f"the derivative by {k} is {v}" for k, v in found.items() if v != v or abs(v) == float("inf")]
    return bad


def perturbed(model: Model, delta: float = 5e-3, seed: int = 0) -> Model:
    """Counts and discounts changed by up to half of ``delta`` of themselves, by a hash of their keys; totals fit."""
    part = lambda *keys: 1 + F.lit(delta) * (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(100)) - 50) / 100
    counts = model.counts.withColumn("count", F.col("count") * part("hist", "word"))
    sums = counts.groupBy("hist").agg(F.sum("count").alias("s"))
    disc = F.col("discount") * part("hist")
    states = model.states.join(sums, "hist", "left").select("ord", "hist", (disc + F.coalesce("s", F.lit(0.0))).alias("total"), disc.alias("discount"))
    return Model(counts, states, model.order, model.num_words, model.meta)


def normalised(line: Column) -> Column:
    """Transcripts as the recipes clean them: lower case, without annotations in brackets, without partial words' marks and punctuation."""
    text = F.lower(line)
    text = F.regexp_replace(text, r"\[[^\]]*\]|<[^>]*>|\([^)]*\)|\{[^}]*\}", " ")
    text = F.regexp_replace(text, r"[.,?!;:\"]+(?=\s|$)", "")
    text = F.regexp_replace(text, r"[_\-]+(?=\s|$)|(?<=\s|^)[_\-]+", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))
