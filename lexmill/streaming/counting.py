"""Word and n-gram counts that grow with a stream of lines: counts add up, so complete or update mode is exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tokens import ngrams, tokens


def word_stream(lines: DataFrame) -> DataFrame:
    """source, word and cnt so far of a stream of source and line."""
    return lines.select("source", F.explode(tokens(F.col("line"))).alias("word")).groupBy("source", "word").agg(F.count("*").alias("cnt"))


def ngram_stream(sents: DataFrame, order: int, limit_unknown: bool = False) -> DataFrame:
    """source, ord, hist, word and cnt so far of a stream of source and ids."""
    found = ngrams(sents, order, limit_unknown).groupBy("source", "hist", "word").agg(F.count("*").alias("cnt"))
    return found.select("source", (F.size("hist") + 1).alias("ord"), "hist", "word", "cnt")


def start(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Runs to the end of what is there, into the in-memory table ``name``."""
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_text_stream(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.readStream.text(path)
    return lines.select(F.lit("stream").alias("source"), F.col("value").alias("line"))
