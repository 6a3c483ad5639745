"""Cleaning a review table: tokens, lemmas and the cleaned text."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from textmeter import resources as R
from textmeter.functions import text as X
from textmeter.operators.lookup import fits_broadcast
from textmeter.session import materialize

# Noun endings and what replaces them, in the order they are tried.
NOUN_ENDINGS = (
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
    ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
)


def clean_text(df: DataFrame, lemmas: DataFrame | None = None, stop_words: Iterable[str] = R.STOP_WORDS,
               min_length: int = 2, keep_letters: bool = False, text: str = "review") -> DataFrame:
    """Add ``tokens`` and ``cleaned_review``. Without a lemma table this is a projection."""
    tokens = X.clean_tokens(F.col(text), stop_words, min_length, keep_letters)
    cleaned = df.withColumn("tokens", tokens)
    if lemmas is not None:
        cleaned = lemmatize(cleaned, lemmas)
    return cleaned.withColumn("cleaned_review", F.array_join("tokens", " "))


def lemmatize(df: DataFrame, lemmas: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Replace each token by its lemma from ``lemmas(form, lemma)``; unknown tokens stay.

    Each row is rewritten by itself, whatever its id. A table of lemmas found
    small enough is sent to the workers, and only the token lists pass through
    them: nothing is shuffled. A larger one is joined with the distinct tokens of
    each row, which is told by a number of its own, and what changes in a row is
    put into its list. Null and empty lists come back empty, null tokens go.
    """
    words = lemmas.filter("form IS NOT NULL").groupBy(F.col("form").alias("_form")).agg(F.min("lemma").alias("_lemma"))
    words = words.filter("_lemma <> _form")
    given = F.filter(F.coalesce(F.col(tokens), F.array().cast("array<string>")), lambda t: t.isNotNull())
    if fits_broadcast(words):
        return df.withColumn(tokens, _swapped(words)(given))
    # Written, so that the numbers stay.
    rows = materialize(df.withColumn(tokens, given).withColumn("_row", F.monotonically_increasing_id()), "lemmas")
    exploded = rows.select("_row", F.explode(F.array_distinct(tokens)).alias("_form"))
    changes = exploded.join(words, "_form").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_form", "_lemma"))).alias("_changes"))
    changed = F.transform(tokens, lambda t: F.coalesce(F.try_element_at("_changes", t), t))
    whole = rows.join(changes, "_row", "left")
    return whole.withColumn(tokens, F.when(F.col("_changes").isNull(), F.col(tokens)).otherwise(changed)).drop("_row", "_changes")


def _swapped(words: DataFrame):
    """A function of token lists. The table of words is known to be small."""
    held = words.toArrow().combine_chunks()
    shipped = words.sparkSession.sparkContext.broadcast((held.column("_form").combine_chunks(), held.column("_lemma").combine_chunks()))

    @F.arrow_udf("array<string>")
    def swap(lists: pa.Array) -> pa.Array:
        forms, lemmas = shipped.value
        flat = lists.flatten()
        lemma = lemmas.take(pc.index_in(flat, value_set=forms))
        edges = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype("i4")
        return pa.ListArray.from_arrays(pa.array(edges), pc.coalesce(lemma, flat))

    return swap


def lemma_table(tokens: DataFrame, nouns: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """``(form, lemma)`` for the words in ``tokens(token)`` whose lemma differs.

    A word's candidates are itself and what remains after swapping a plural
    ending, or its listed ``exceptions(form, lemma)``; those found in
    ``nouns(term)`` count, and the shortest one wins.
    """
    words = tokens.select(F.col("token").alias("form")).distinct()
    form = F.col("form")
    swapped = [
        F.when(form.endswith(old), F.concat(F.expr(f"left(form, length(form) - {len(old)})"), F.lit(new)))
        for old, new in NOUN_ENDINGS
    ]
    candidates = F.array(form, *swapped)
    if exceptions is not None:
        listed = exceptions.groupBy("form").agg(F.sort_array(F.collect_set("lemma")).alias("_listed"))
        words = words.join(listed, "form", "left")
        candidates = F.when(F.col("_listed").isNotNull(), F.concat(F.array(form), "_listed")).otherwise(candidates)
    options = words.select("form", F.posexplode(candidates).alias("_rank", "term")).filter("term <> ''")
    known = options.join(nouns.select("term").distinct(), "term", "left_semi")
    best = known.groupBy("form").agg(
        F.min(F.struct(F.length("term").alias("_length"), "_rank", F.col("term").alias("lemma"))).alias("_best")
    )
    return best.select("form", F.col("_best.lemma").alias("lemma")).filter("lemma <> form")
