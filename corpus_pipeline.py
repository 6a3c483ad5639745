"""From raw documents to token ids: five stages, each one of the corpus operators over all its predecessor kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from textmeter.llm import bpe, decontaminate, language, line_dedup, simhash
from textmeter.llm.common import store, table

#: Rows of an Arrow batch: texts may be long, and executor and worker each hold whole batches.
BATCH_ROWS = 1000
#: Columns of documents; each stage passes others on as they are.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: SQL has neither XXH64 nor learned models nor BPE; the stages are tested one by one instead.
ORACLE_SQL = None


def _small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        # Columns beside those of documents pass through under names that no operator uses.
        extra = {c: f"extra {i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
        return stage(spark, docs.withColumnsRenamed(extra), sf_dir).withColumnsRenamed({v: c for c, v in extra.items()})
    return run


@_small_batches
def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without any letter are rejected."""
    found = language.identify(docs, language.learn(docs))
    return found.filter(F.col("lang_pred") != language.UNKNOWN).select(docs.columns)


@_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class: three-word shingles, two bits."""
    return simhash.representatives(docs, width=3, distance=2).select(docs.columns)


@_small_batches
def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines, and the sentences of five words, that an earlier document has; texts of which nothing is left go."""
    cut = line_dedup.drop_repeated_units(docs, min_words=1, sentence_words=5)
    emptied = (F.size("removed") > 0) & (F.trim("text") == "")
    length = F.when(F.size("removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cut.filter(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", length.cast("long")).select(docs.columns)


@_small_batches
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


@_small_batches
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether decoding them gives its bytes back."""
    tokenizer = bpe.tokenizer_json(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    decoded = bpe.encode(docs.select("doc_id", "lang", "source", "text", F.xxhash64(data).alias("given")), tokenizer, decoded=True)
    same = F.xxhash64("decoded") == F.col("given")
    return decoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("lossless"))


STAGES = [
    ("language", languages),
    ("simhash", near_duplicates),
    ("lines", repeated_lines),
    ("benchmark", decontaminated),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is a written table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
