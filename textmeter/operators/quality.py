"""Quality gates: realism, duplicates, label leakage, vocabulary, lengths, balance."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textmeter import resources as R
from textmeter.functions import text as X


def require_columns(df: DataFrame, columns: Iterable[str] = ("review", "sentiment")) -> DataFrame:
    """The table itself, or an error naming the missing columns; reads no data."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def column_report(df: DataFrame, columns: Iterable[str] = ("review", "sentiment")) -> DataFrame:
    """(column, present, filled): whether each column exists and how many rows have a value."""
    columns = list(columns)
    filled = [F.count(c) if c in df.columns else F.lit(0).cast("bigint") for c in columns]
    counted = df.agg(*[f.alias(f"f{i}") for i, f in enumerate(filled)])
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(c in df.columns).alias("present"), F.col(f"f{i}").alias("filled"))
        for i, c in enumerate(columns)
    ]
    return counted.select(F.inline(F.array(*rows)))


def realism_gate(df: DataFrame, min_rows: int = R.MIN_ROWS, min_avg_words: float = R.MIN_AVG_WORDS,
                 min_vocabulary: int = R.MIN_VOCABULARY) -> DataFrame:
    """One row: the three measures, the verdict and the first gate that failed. All texts are measured."""
    known = df.filter(F.col("review").isNotNull())
    words = known.select(F.explode(X.split_words(F.lower("review"))).alias("word"))
    vocabulary = words.agg(F.count_distinct("word").alias("vocabulary"))
    measured = df.agg(
        F.count("*").alias("n_rows"),
        F.avg(F.when(F.col("review").isNotNull(), X.word_count(F.col("review")))).alias("avg_words"),
    ).withColumn("vocabulary", vocabulary.scalar())
    reason = (
        F.when(F.col("n_rows") < min_rows, "rows")
        .when(F.col("avg_words") < min_avg_words, "avg_words")
        .when(F.col("vocabulary") < min_vocabulary, "vocabulary")
        .otherwise("ok")
    )
    return measured.select(
        "n_rows", F.round("avg_words", 4).alias("avg_words"), "vocabulary",
        (reason == "ok").alias("passed"), reason.alias("reason"),
    )


def digest(text: Column) -> Column:
    """Stands for the text as a key: equal texts, equal digests, a few bytes to shuffle."""
    return F.sha2(text.cast("binary"), 256)


def dedup(df: DataFrame, text: str = "review", id_col: str = "id") -> DataFrame:
    """Keep one row of each text, that of the smallest id; null counts as one text.

    A null id comes last. Of rows with the same text and id one stays, chosen by
    a hash of all columns. So no text is lost and none stays twice, whatever the
    ids.

    Copies are reduced to one (digest, id) pair per map task before anything
    moves, so a text that makes up a third of the table is no hot spot; whole
    rows then move once, by digest and id.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))
    rows = df.withColumn("_digest", F.coalesce(digest(F.col(text)), F.lit("null"))).withColumn("_key", key)
    first = rows.groupBy("_digest").agg(F.min("_key").alias("_key"))
    # Placed by the join, so the window moves nothing.
    one = F.row_number().over(W.partitionBy("_digest", "_key").orderBy(F.xxhash64(*df.columns)))
    kept = rows.join(first, ["_digest", "_key"], "left_semi").withColumn("_one", one)
    return kept.filter("_one = 1").select(*df.columns)


def dedup_cleaned(df: DataFrame, id_col: str = "id") -> DataFrame:
    return dedup(df, "cleaned_review", id_col)


def _duplicates(key: str) -> Column:
    return F.count("*") - F.count_distinct(F.coalesce(F.col(key), F.lit("null")))


def dup_counts(df: DataFrame, raw: str = "review", cleaned: str = "cleaned_review") -> DataFrame:
    """Rows beyond the first of their raw and of their cleaned text."""
    digests = df.select(digest(F.col(raw)).alias("_raw"), digest(F.col(cleaned)).alias("_cleaned"))
    return digests.agg(
        _duplicates("_raw").alias("raw_duplicates"), _duplicates("_cleaned").alias("cleaned_duplicates")
    )


def label_leakage(df: DataFrame, words: Iterable[str] = R.LEAKAGE_WORDS, text: str = "cleaned_review",
                  label: str = "sentiment") -> DataFrame:
    """Rows that contain a word, in total and per class, for words that occur at all.

    One pass: the words become flags, the flags become counts, the counts become rows.
    """
    words = list(words)
    flags = df.select(F.col(label).alias("_label"), *leakage_hits(words, text))
    return leaked_words(flags.agg(*leakage_measures(words, "_label")), words)


def leakage_hits(words: list[str], text: str = "cleaned_review") -> list[Column]:
    """One flag for each word, ``_h0`` and so on: whether the text contains it."""
    return [F.coalesce(F.col(text).rlike(rf"(?iU)\b{re.escape(w)}\b"), F.lit(False)).alias(f"_h{i}") for i, w in enumerate(words)]


def leakage_measures(words: list[str], label: str = "sentiment") -> list[Column]:
    """Aggregates over the flags: rows with each word, in total and per class."""
    counts = []
    for i in range(len(words)):
        hit = F.col(f"_h{i}")
        counts += [
            F.count_if(hit).alias(f"_n{i}"),
            F.count_if(hit & (F.col(label) == 1)).alias(f"_p{i}"),
            F.count_if(hit & (F.col(label) == 0)).alias(f"_m{i}"),
        ]
    return counts


def leaked_words(measured: DataFrame, words: list[str]) -> DataFrame:
    """(word, n_rows, pos, neg) from one row of measures, for words that occur."""
    rows = [
        F.struct(F.lit(w).alias("word"), F.col(f"_n{i}").alias("n_rows"), F.col(f"_p{i}").alias("pos"), F.col(f"_m{i}").alias("neg"))
        for i, w in enumerate(words)
    ]
    return measured.select(F.inline(F.array(*rows))).filter("n_rows > 0")


def _audit_words(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(X.vector_tokens(F.col(text))).alias("token"))


def token_counts(df: DataFrame, text: str = "cleaned_review") -> DataFrame:
    return _audit_words(df, text).groupBy("token").agg(F.count("*").alias("n"))


def vocabulary_verdict(size: Column) -> Column:
    return (
        F.when(size < R.AUDIT_VOCABULARY_CRITICAL, "critical")
        .when(size < R.AUDIT_VOCABULARY_WARNING, "warning")
        .otherwise("ok")
    )


def vocab_sanity(df: DataFrame, text: str = "cleaned_review") -> DataFrame:
    """Vocabulary size and its verdict."""
    counted = _audit_words(df, text).agg(F.count_distinct("token").alias("vocabulary"))
    return counted.withColumn("verdict", vocabulary_verdict(F.col("vocabulary")))


def top_tokens(df: DataFrame, k: int = R.AUDIT_TOP_TOKENS, text: str = "cleaned_review") -> DataFrame:
    """The k most frequent tokens; ties go to the alphabetically first."""
    return token_counts(df, text).orderBy(F.desc("n"), "token").limit(k)


def length_audit(df: DataFrame, text: str = "cleaned_review", min_mean: float = R.AUDIT_MIN_MEAN_WORDS) -> DataFrame:
    return length_verdict(df.select(X.word_count(F.col(text)).alias("n")).agg(*length_measures("n")), min_mean)


def length_measures(count: str) -> list[Column]:
    return [F.avg(count).alias("avg_words"), F.min(count).alias("min_words"), F.max(count).alias("max_words")]


def length_verdict(measured: DataFrame, min_mean: float = R.AUDIT_MIN_MEAN_WORDS) -> DataFrame:
    return measured.select(
        F.round("avg_words", 4).alias("avg_words"), "min_words", "max_words",
        (F.col("avg_words") < min_mean).alias("too_short"),
    )


def class_balance(df: DataFrame, label: str = "sentiment", low: float = R.BALANCE_RANGE[0],
                  high: float = R.BALANCE_RANGE[1]) -> DataFrame:
    return balance_verdict(df.agg(*balance_measures(label)), low, high)


def balance_measures(label: str = "sentiment") -> list[Column]:
    return [F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")]


def balance_verdict(counted: DataFrame, low: float = R.BALANCE_RANGE[0], high: float = R.BALANCE_RANGE[1]) -> DataFrame:
    ratio = F.col("pos") / F.greatest("neg", F.lit(1))
    return counted.select("pos", "neg", F.round(ratio, 4).alias("ratio"), ratio.between(low, high).alias("balanced"))


def perfect_score_flag(results: DataFrame, threshold: float = R.PERFECT_SCORE) -> DataFrame:
    """Mark experiments too good to be true."""
    return results.withColumn("suspicious", F.col("Accuracy") >= threshold)


def split_leakage(df: DataFrame, text: str = "cleaned_review") -> DataFrame:
    """Texts that occur in train and in test, and how many rows of either side they cover.

    Counted per text before comparing, so no row of one side meets a row of the other.
    """
    sides = df.groupBy(digest(F.col(text)).alias("_digest")).agg(
        F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test")
    )
    return sides.filter("train > 0 AND test > 0").agg(
        F.count("*").alias("shared_texts"),
        F.coalesce(F.sum("train"), F.lit(0)).alias("train_rows"),
        F.coalesce(F.sum("test"), F.lit(0)).alias("test_rows"),
    )
