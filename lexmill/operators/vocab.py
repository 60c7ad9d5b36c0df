"""Word counts, vocabularies and the unigram weights of sources."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import RESERVED, gathered, pieces, split_lines, tokens


def word_counts(lines: DataFrame) -> DataFrame:
    """source, word, cnt. Batches of lines are counted in Arrow, and their counts added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            flat, starts = split_lines(b.column(1))
            if not len(flat):
                continue
            names, words = b.column(0).dictionary_encode(null_encoding="encode"), flat.dictionary_encode()
            width = len(words.dictionary)
            key, n = np.unique(np.repeat(names.indices.to_numpy().astype(np.int64), np.diff(starts)) * width + words.indices.to_numpy(), return_counts=True)
            source, word = np.divmod(key, width)
            yield from pieces([names.dictionary.take(pa.array(source)), words.dictionary.take(pa.array(word)), pa.array(n)], ["source", "word", "n"])

    kind = lines.schema["source"].dataType.simpleString()
    found = lines.select("source", F.col("line").cast("string")).mapInArrow(run, f"source {kind}, word string, n long")
    return found.groupBy("source", "word").agg(F.sum("n").alias("cnt"))


def source_names(lines: DataFrame) -> DataFrame:
    """id (from 1, by name) and name of each source."""
    return lines.select(F.col("source").alias("name")).distinct().select(F.row_number().over(Window.orderBy("name")).alias("id"), "name")


def vocabulary(counts: DataFrame, num_words: int, weights: dict[str, float] | None = None) -> DataFrame:
    """word and id: the control symbols, then words by falling weighted count (ties by word), ``num_words`` + 1 entries in all."""
    per = counts.where(~F.col("word").isin(*RESERVED))
    scale = F.lit(1.0)
    if weights:
        scale = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("source")), F.lit(0.0))
    total = per.groupBy("word").agg(F.sum(F.col("cnt") * scale).alias("weight"))
    best = total.orderBy(F.desc("weight"), "word").limit(max(0, num_words + 1 - len(RESERVED)))
    ranked = best.select("word", (F.row_number().over(Window.orderBy(F.desc("weight"), "word")) + len(RESERVED) - 1).alias("id"))
    return reserved(counts.sparkSession).unionByName(ranked)


def reserved(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(zip(RESERVED, range(len(RESERVED)))), "word string, id int")


def vocabulary_of_list(spark: SparkSession, words: list[str], control: tuple[str, ...] = RESERVED) -> DataFrame:
    """A vocabulary of a word list (two words at least) in its order; repeated and control words are errors."""
    times = Counter(words)
    bad = sorted({w for w in words if w in control or not w or len(w.split()) != 1 or times[w] > 1})
    if bad or len(words) < 2:
        raise ValueError(f"not a word list: {bad or 'too short'}")
    return spark.createDataFrame([*zip(control, range(4)), *((w, k + 4) for k, w in enumerate(words))], "word string, id int")


def vocabulary_problems(vocab: DataFrame) -> DataFrame:
    """What is wrong with a vocabulary: ids not from 0 without gaps, words that repeat or hold white space, control symbols out of place."""
    spread = vocab.agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.countDistinct("id").alias("ids"))
    return (
        spread.where("n < 5").select(F.lit("fewer than five entries").alias("problem"))
        .union(spread.where("low <> 0 or high <> n - 1 or ids <> n").select(F.lit("ids have gaps or repeat")))
        .union(vocab.groupBy("word").count().where("count > 1").select(F.concat(F.lit("repeated word "), "word")))
        .union(vocab.where("word = '' or word rlike '\\\\s'").select(F.concat(F.lit("bad word '"), "word", F.lit("'"))))
        .union(reserved(vocab.sparkSession).join(vocab, ["word", "id"], "left_anti").select(F.concat(F.lit("control symbol out of place: "), "word")))
    )


def oov_rates(lines: DataFrame, vocab: DataFrame) -> DataFrame:
    """source, tokens, unknown and reserved: how many tokens the vocabulary lacks, and how many are control symbols in the text."""
    words = lines.select("source", F.explode(tokens(F.col("line"))).alias("word"))
    found = words.groupBy("source", "word").agg(F.count("*").alias("n")).join(vocab, "word", "left")
    return found.groupBy("source").agg(
        F.sum("n").alias("tokens"), F.sum(F.when(F.col("id").isNull() | (F.col("id") <= 3), F.col("n")).otherwise(0)).alias("unknown"), F.sum(F.when(F.col("id") <= 2, F.col("n")).otherwise(0)).alias("reserved"))


def text_problems(lines: DataFrame, dev: str = "dev") -> DataFrame:
    """What is wrong with a text table: no held-out or no training source, sources without words, control symbols as tokens."""
    words = lines.select("source", F.explode(tokens(F.col("line"))).alias("word"))
    names = lines.agg(F.max((F.col("source") == dev).cast("int")).alias("dev"), F.max((F.col("source") != dev).cast("int")).alias("train"))
    empty = lines.select("source").distinct().join(words.select("source").distinct(), "source", "left_anti")
    return (
        names.where("coalesce(dev, 0) = 0").select(F.lit("no held-out source").alias("problem"))
        .union(names.where("coalesce(train, 0) = 0").select(F.lit("no training source")))
        .union(empty.select(F.concat(F.lit("no words in "), "source")))
        .union(words.where(F.lower("word").isin("<s>", "</s>")).select(F.concat(F.lit("control symbol in "), "source")).distinct())
    )


def utterance_ids(lines: DataFrame) -> DataFrame:
    """source and first, of sources whose every first token (on two lines or more) occurs only there, as utterance ids would: a warning."""
    t = lines.select("source", tokens(F.col("line")).alias("t")).where("size(t) > 1")
    first = t.groupBy("source", F.col("t")[0].alias("w")).agg(F.count("*").alias("n"))
    later = t.select("source", F.explode(F.slice("t", F.lit(2), F.size("t"))).alias("w")).distinct().withColumn("later", F.lit(True))
    per = first.join(later, ["source", "w"], "left").groupBy("source").agg(F.sum("n").alias("lines"), F.max(F.coalesce(F.col("later"), F.col("n") > 1)).alias("ordinary"), F.min("w").alias("first"))
    return per.where("lines > 1 and not ordinary").select("source", "first")


def unigram_weights(counts: DataFrame, dev: DataFrame, tolerance: float = 1e-3, most: int = 100) -> dict[str, float]:
    """Weights of sources by expectation maximisation on held-out words, relative to the largest."""
    per, names, sizes = mixture_table(counts, dev)
    if len(names) == 1:
        return {names[0]: 1.0}
    per = per.persist()
    try:
        shares = [1 / len(names)] * len(names)
        for _ in range(most):
            new = mixture_step(per, shares)
            moved = sum((a - b) ** 2 for a, b in zip(new, shares)) ** 0.5
            shares = new
            if moved < tolerance:
                break
    finally:
        per.unpersist()
    raw = [s * n for s, n in zip(shares, sizes)]
    return {name: r / max(raw) for name, r in zip(names, raw)}


def mixture_table(counts: DataFrame, dev: DataFrame) -> tuple[DataFrame, list[str], list[int]]:
    """For each held-out word that some source has: n and q, its probability in each source by name; and names and sizes of sources."""
    total = counts.groupBy("source").agg(F.sum("cnt").alias("all")).orderBy("source")
    sized = total.collect()  # a row for each source
    names = [r.source for r in sized]
    # a join by source, or a pivot's first values, would sort all of a source's words, or all sources', in one task
    shared = counts.join(F.broadcast(total), "source").withColumn("p", F.col("cnt") / F.col("all"))
    table = shared.groupBy("word").agg(*[F.coalesce(F.max(F.when(F.col("source") == x, F.col("p"))), F.lit(0.0)).alias(f"q{k}") for k, x in enumerate(names)])
    held = dev.groupBy("word").agg(F.sum("cnt").alias("n"))
    per = held.join(table, "word").select("word", "n", F.array(*[f"q{k}" for k in range(len(names))]).alias("q"))
    if per.isEmpty():
        raise ValueError("no held-out word occurs in any source")
    return per, names, [r.all for r in sized]


def mixture_step(per: DataFrame, shares: list[float]) -> list[float]:
    parts = [F.lit(s) * F.col("q")[k] for k, s in enumerate(shares)]
    mix = sum(parts[1:], parts[0])
    row = per.agg(F.sum("n"), *[F.sum(F.col("n") * p / mix) for p in parts]).first()
    return [x / row[0] for x in row[1:]]
