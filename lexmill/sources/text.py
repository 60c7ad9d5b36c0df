"""Text directories: NAME.txt or NAME.txt.gz, a sentence a line; the source called dev is held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_dir(spark: SparkSession, path: str) -> DataFrame:
    """source, doc, line_no and line of every line below ``path``; gzip is read as it is. Lines keep no place in their file, only a number apart."""
    lines = spark.read.text(f"{path}/*.txt*").withColumn("file", F.input_file_name())
    source = F.regexp_extract("file", r"([^/]+?)\.txt(?:\.gz)?$", 1)
    at = F.monotonically_increasing_id()
    return lines.select(source.alias("source"), at.alias("doc"), F.lit(0).alias("line_no"), F.col("value").alias("line"))


def read_word_list(spark: SparkSession, path: str) -> list[str]:
    """A word a line, in order; vocabularies are small, so this reads on the driver."""
    return [r.value.strip() for r in spark.read.text(path).coalesce(1).collect() if r.value.strip()]


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="word string, id int", quote="")


def read_weights(spark: SparkSession, path: str) -> dict[str, float]:
    """name weight, a line each; a source named twice or a weight out of range is an error."""
    rows = spark.read.csv(path, sep=" ", schema="name string, weight double").collect()
    out = {r.name: r.weight for r in rows}
    if len(out) != len(rows) or any(w is None or w < 0 for w in out.values()):
        raise ValueError("bad unigram weights")
    return out
