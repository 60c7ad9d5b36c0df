"""Models as ARPA text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import BOS
from ..operators.model import BROADCAST_WORDS, Model, back_off_weights, probabilities
from ..session import cut


def number(x: Column) -> Column:
    """Six significant digits as C's %g writes them: no zeros at the end, an exponent for what is under 1e-4; null stays null."""
    size = F.abs(x)
    place = F.when(size > 0, F.floor(F.log10(size))).otherwise(0).cast("int")
    digits = F.greatest(F.lit(0), F.lit(5) - place)
    fixed = F.format_string("%.10f", x)
    for k in range(10):  # only the one that is wanted is made
        fixed = F.when(digits == k, F.format_string(f"%.{k}f", x)).otherwise(fixed)
    fixed = F.when(fixed.contains("."), F.regexp_replace(fixed, r"\.?0+$", "")).otherwise(fixed)
    small = F.regexp_replace(F.format_string("%.5e", x), r"\.?0*e", "e")
    return F.when(x.isNotNull(), F.when((size > 0) & (size < 1e-4), small).otherwise(fixed))


def rows(model: Model, vocab: DataFrame) -> DataFrame:
    """ord, ngram (words, oldest first), ids, prob and backoff (log10; null where there is none) of each line. Begin-of-sentence gets probability -99.

    An id that the vocabulary lacks, and a history with a back-off weight but no probability, are errors.
    """
    probs = probabilities(model).select("ord", F.concat(F.reverse("hist"), F.array("word")).alias("ids"), F.col("log10").alias("prob"))
    start = model.counts.sparkSession.range(1).select(F.lit(1).alias("ord"), F.array(F.lit(BOS)).alias("ids"), F.lit(-99.0).alias("prob"))
    weights = back_off_weights(model).select((F.col("ord") - 1).alias("ord"), F.reverse("hist").alias("ids"), F.col("log10").alias("backoff"))
    # weights belong to shorter n-grams, so the longest, which are most, aren't joined
    both = probs.where(F.col("ord") < model.order).unionByName(start).join(weights, ["ord", "ids"], "full_outer")
    shown = F.concat_ws(" ", F.transform("ids", lambda x: x.cast("string")))
    both = both.withColumn("prob", F.when(F.col("prob").isNull(), F.raise_error(F.concat(F.lit("a back-off weight without a probability: "), shown)).cast("double")).otherwise(F.col("prob")))
    named = both.unionByName(probs.where(F.col("ord") == model.order).withColumn("backoff", F.lit(None).cast("double")))
    words = []
    for k in range(model.order):
        names = vocab.select(F.col("id").alias(f"id{k}"), F.col("word").alias(f"word{k}"))
        named = named.withColumn(f"id{k}", F.get("ids", F.lit(k))).join(F.broadcast(names) if model.num_words <= BROADCAST_WORDS else names, f"id{k}", "left")
        lacks = F.col(f"id{k}").isNotNull() & F.col(f"word{k}").isNull()
        words.append(F.when(lacks, F.raise_error(F.concat(F.lit("no word has the id "), F.col(f"id{k}").cast("string")))).otherwise(F.col(f"word{k}")))
    return named.select("ord", "ids", "prob", "backoff", F.concat_ws(" ", *words).alias("ngram"))


def lines(model: Model, vocab: DataFrame) -> DataFrame:
    """The file's lines in order: ord, key and line. n-grams of an order go by their ids as text."""
    found = cut(rows(model, vocab))
    text = F.concat(number(F.col("prob")), F.lit("\t"), F.col("ngram"), F.coalesce(F.concat(F.lit("\t"), number(F.col("backoff"))), F.lit("")))
    body = found.select("ord", F.concat(F.lit("1"), F.concat_ws(" ", F.transform("ids", lambda x: x.cast("string")))).alias("key"), text.alias("line"))
    counts = found.groupBy("ord").agg(F.count("*").alias("n"))
    spark = model.counts.sparkSession
    head = counts.select(F.lit(0).alias("ord"), F.concat(F.lit("1"), F.lpad(F.col("ord").cast("string"), 3, "0")).alias("key"), F.concat(F.lit("ngram "), "ord", F.lit("="), "n").alias("line"))
    titles = counts.select("ord", F.lit("0").alias("key"), F.concat(F.lit("\n\\"), "ord", F.lit("-grams:")).alias("line"))
    ends = spark.createDataFrame([(0, "0", "\\data\\"), (1000, "0", "\n\\end\\")], "ord int, key string, line string")
    return body.unionByName(head).unionByName(titles).unionByName(ends)


def write(model: Model, vocab: DataFrame, path: str) -> None:
    """One ARPA file at ``path``: parts are written in order by all tasks, then joined as streams of bytes."""
    spark = model.counts.sparkSession
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    lines(model, vocab).orderBy("ord", "key").select("line").write.text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder, to = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(conf)
    names = sorted(f.getPath().getName() for f in files.listStatus(folder))
    with_data = files.create(to, True)
    try:
        for name in (n for n in names if n.startswith("part-")):
            part = files.open(jvm.org.apache.hadoop.fs.Path(folder, name))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, with_data, 1 << 20, False)
            part.close()
    finally:
        with_data.close()
        files.delete(folder, True)


def read(spark: SparkSession, path: str, vocab: DataFrame) -> DataFrame:
    """ord, hist (ids, most recent first), word, prob and backoff (log10) of the n-grams in ARPA text; a number that isn't one, or an unknown word, is an error."""
    found = spark.read.text(path).where(F.col("value").contains("\t"))
    part = F.split("value", "\t")
    each = found.select(part[0].cast("double").alias("prob"), F.split(part[1], " ").alias("words"), F.get(part, F.lit(2)).cast("double").alias("backoff")).withColumn("at", F.monotonically_increasing_id())
    ids = each.select("*", F.posexplode("words").alias("pos", "word")).join(vocab, "word", "left")
    known = F.when(F.col("id").isNull(), F.raise_error(F.concat(F.lit("not in the vocabulary: "), "word")).cast("int")).otherwise(F.col("id"))
    ids = ids.groupBy("at", "prob", "backoff").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", known.alias("id")))), lambda x: x["id"]).alias("ids"))
    return ids.select(F.size("ids").alias("ord"), F.reverse(F.slice("ids", F.lit(1), F.size("ids") - 1)).alias("hist"), F.element_at("ids", -1).alias("word"), "prob", "backoff")
