"""The queries of this package, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, linededup, minhash, mixing, packing, quality, secrets, tokenstore, toxicity, unigram
from .common import cut, shared_dir, table


def tokens(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = tokenstore.write(table(spark, sf_dir, "documents"), tokens("word_bpe_49k.json"), to, end_id=1)
    found = cut(tokenstore.read(spark, manifest))
    tokenstore.remove(to)
    return found


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.judged(table(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = secrets.dictionary(docs)
    return secrets.scan(docs, secrets.train(secrets.examples(spark), words), words)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens("byte_bpe_50k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(table(spark, sf_dir, "documents"), tokens("piece_bpe_32k.model"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_binary, op2_line_dedup, op3_secret_scans, op4_best_fit_packing, op5_toxicity, op6_nearest_neighbours, op7_token_counts, op8_quality_rules, op9_minhash_near_dedup, op10_mixing_sources)}


def oracle_sql() -> dict[str, str]:
    return {}
