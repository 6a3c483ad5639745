"""Text features: vocabulary, counts, TF-IDF, mean word vectors, hybrid.

Fitting (which terms, which weights) is an aggregation over the training texts
whose result is bounded by ``max_features``; it runs when ``fit_*`` is called.
Transforming is a projection: a text's vector depends on that text and the
fitted vocabulary alone, so no transform shuffles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from textmeter import resources as R
from textmeter.functions import text as X
from textmeter.operators.lexicon import lexicon_scores
from textmeter.operators.lookup import fits_broadcast, join_words
from textmeter.operators.word_vectors import WordVectors, fit_cbow, part_means
from textmeter.session import materialize


def with_terms(df: DataFrame, text: str = "cleaned_review", out: str = "terms") -> DataFrame:
    """Add unigrams and bigrams of the vectoriser's tokens."""
    tokens = df.withColumn("_tokens", X.vector_tokens(F.col(text)))
    return tokens.withColumn(out, X.ngrams_1_2(F.col("_tokens"))).drop("_tokens")


def term_stats(df: DataFrame, terms: str = "terms") -> DataFrame:
    """(term, tf, df) over all texts.

    A text's terms are sorted first; a term that differs from the one before it
    is its first in the text. So one aggregation by term, combined on the map
    side, counts occurrences and texts, and no (text, term) pair is shuffled.
    """
    ordered = df.select(F.sort_array(terms).alias("_sorted"))
    before = F.concat(
        F.array(F.lit(None).cast("string")),
        F.slice("_sorted", F.lit(1), F.greatest(F.size("_sorted") - 1, F.lit(0))),
    )
    pairs = ordered.select(F.inline(F.arrays_zip(F.col("_sorted"), before.alias("_before"))).alias("term", "_before"))
    first = F.when(F.col("term").eqNullSafe(F.col("_before")), 0).otherwise(1)
    return (
        pairs.filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("tf"), F.sum(first).alias("df"))
    )


def _floor_of_top(stats: DataFrame, k: int) -> int:
    """A power of two that at least k terms reach, and not many more do.

    Counts terms by the binary magnitude of their tf: at most 64 rows.
    """
    magnitude = F.floor(F.log2(F.col("tf").cast("double"))).cast("int").alias("m")
    sizes = stats.groupBy(magnitude).agg(F.count("*").alias("n")).collect()
    reached = 0
    for row in sorted(sizes, key=lambda r: -r.m):
        reached += row.n
        if reached >= k:
            # One lower, should a logarithm just below a power of two have been rounded up.
            return 2 ** max(row.m - 1, 0)
    return 1


def top_terms(stats: DataFrame, k: int) -> DataFrame:
    """The k terms with the largest tf; ties go to the alphabetically first.

    A limit takes k rows from every partition to one task. With a large k and
    many partitions that is too much, so terms clearly below the k-th are
    dropped where they are; ``stats`` is read twice and should be a written table.
    """
    contenders = stats.filter(F.col("tf") >= _floor_of_top(stats, k))
    return contenders.orderBy(F.desc("tf"), "term").limit(k)


def vocabulary(df: DataFrame, max_features: int = R.MAX_FEATURES, min_df: int = R.MIN_DF,
               terms: str = "terms") -> DataFrame:
    """(term, idx, tf, df): terms of at least ``min_df`` texts, the most frequent ones, indexed alphabetically."""
    stats = materialize(term_stats(df, terms).filter(F.col("df") >= min_df), "terms")
    # At most max_features rows, so one task may number them.
    index = F.row_number().over(W.orderBy("term")) - 1
    return top_terms(stats, max_features).select("term", index.cast("int").alias("idx"), "tf", "df")


@dataclass(frozen=True)
class TermModel:
    """A fitted vocabulary: terms in index order with their document frequencies."""

    terms: list[str]
    df: list[int]
    n_docs: int

    @property
    def idf(self) -> list[float]:
        return [math.log((1 + self.n_docs) / (1 + d)) + 1 for d in self.df]


def fit_terms(train: DataFrame, max_features: int = R.MAX_FEATURES, min_df: int = R.MIN_DF,
              terms: str = "terms") -> TermModel:
    """Fit on the training texts. At most ``max_features`` rows come to the driver."""
    rows = vocabulary(train, max_features, min_df, terms).collect()
    rows.sort(key=lambda r: r.idx)
    return TermModel([r.term for r in rows], [r.df for r in rows], train.count())


def idf_table(train: DataFrame, max_features: int = R.MAX_FEATURES, min_df: int = R.MIN_DF,
              terms: str = "terms") -> DataFrame:
    """(term, idx, df, idf) with the smoothed inverse document frequency."""
    n = train.agg(F.count("*")).scalar()
    fitted = vocabulary(train, max_features, min_df, terms)
    return fitted.select("term", "idx", "df", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def count_vectors(df: DataFrame, model: TermModel, terms: str = "terms", out: str = "bow") -> DataFrame:
    """Sparse counts of the vocabulary's terms; other terms are dropped."""
    if not model.terms:
        raise ValueError("the fitted vocabulary is empty")
    counter = CountVectorizerModel.from_vocabulary(model.terms, inputCol=terms, outputCol=out)
    return counter.transform(df)


def _sublinear(vector: str, size: int) -> Column:
    """1 + ln(count) on a sparse vector's stored entries.

    A vector opens into its indices and values with ``unwrap_udt``; the only
    built-in way back is to parse it, which keeps the entries exact and the
    work on the JVM.
    """
    opened = F.unwrap_udt(F.col(vector))
    rebuilt = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        opened.getField("indices").alias("indices"),
        F.transform(opened.getField("values"), lambda c: 1 + F.log(c)).alias("values"),
    )
    schema = T.StructType([T.StructField("v", VectorUDT())])
    return F.from_json(F.to_json(F.struct(rebuilt.alias("v"))), schema).getField("v")


def tfidf_vectors(df: DataFrame, model: TermModel, counts: str = "bow", out: str = "tfidf") -> DataFrame:
    """(1 + ln count) * idf, each row scaled to unit length; rows without known terms stay zero."""
    logged = df.withColumn("_log", _sublinear(counts, len(model.terms)))
    weighted = ElementwiseProduct(scalingVec=DenseVector(model.idf), inputCol="_log", outputCol="_weighted")
    unit = Normalizer(p=2.0, inputCol="_weighted", outputCol=out)
    return unit.transform(weighted.transform(logged)).drop("_log", "_weighted")


def entries(df: DataFrame, vector: str, id_col: str = "id", value: str = "weight") -> DataFrame:
    """Long form (id, idx, value) of a sparse vector column."""
    opened = df.select(id_col, F.unwrap_udt(F.col(vector)).alias("_v"))
    pairs = F.arrays_zip(F.col("_v.indices").alias("idx"), F.col("_v.values").alias(value))
    return opened.select(id_col, F.inline(pairs)).select(id_col, "idx", value)


def feature_shape(df: DataFrame, vector: str, size: int, minimum: int = R.AUDIT_VOCABULARY_CRITICAL) -> DataFrame:
    """One row: rows, columns, non-zero entries in all and in the fullest row, and whether the vocabulary is small."""
    filled = F.size(F.unwrap_udt(F.col(vector)).getField("indices")).cast("bigint")
    return df.select(filled.alias("_n")).agg(
        F.count("*").alias("n_rows"),
        F.lit(size).cast("bigint").alias("n_columns"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("non_zeros"),
        F.coalesce(F.max("_n"), F.lit(0)).alias("max_non_zeros"),
        F.lit(size < minimum).alias("too_small"),
    )


def term_names(df: DataFrame, model: TermModel) -> DataFrame:
    """(idx, term) of a fitted vocabulary as a table."""
    schema = "idx int, term string"
    return df.sparkSession.createDataFrame(list(enumerate(model.terms)), schema)


def top_weighted_terms(df: DataFrame, vector: str, model: TermModel, k: int = 10) -> DataFrame:
    """The k terms with the largest total weight."""
    sums = entries(df.withColumn("_id", F.lit(0)), vector, "_id").groupBy("idx").agg(F.sum("weight").alias("weight"))
    # Proven bound: one row per vocabulary term on either side.
    named = sums.join(F.broadcast(term_names(df, model)), "idx")
    rounded = named.select("term", F.round("weight", 6).alias("weight"))
    return rounded.orderBy(F.desc("weight"), "term").limit(k)


def fit_word2vec(train: DataFrame, dim: int = R.WORD2VEC_DIM, window: int = R.WORD2VEC_WINDOW, min_count: int = 2,
                 epochs: int = R.WORD2VEC_EPOCHS, seed: int = R.SEED, tokens: str = "tokens") -> WordVectors:
    """Word vectors of the training tokens (``word_vectors.fit_cbow``)."""
    return fit_cbow(train, dim, window, min_count, epochs, seed, tokens)


def numbered(df: DataFrame, name: str = "numbered") -> DataFrame:
    """The table, written, with ``_row``: a number of its own for each row.

    What is worked out per row and joined back goes by this number, so rows
    without an id, or with the same one, stay apart and none is lost.
    """
    return materialize(df.withColumn("_row", F.monotonically_increasing_id()), name)


def word2vec_vectors(df: DataFrame, model: WordVectors, tokens: str = "tokens", out: str = "word2vec") -> DataFrame:
    """Add the mean vector of a text's *known* words, zero without any.

    Every row gets its own, whatever its id; a null or empty token list has no
    known word. The tokens are read from a written table.
    """
    rows = df if "_row" in df.columns else numbered(df)
    means = _means(rows, model.getVectors().withColumnRenamed("vector", "_vec"), model.dim, tokens, "_row", out)
    joined = rows.join(means, "_row")
    return joined if "_row" in df.columns else joined.drop("_row")


def _means(df: DataFrame, vectors: DataFrame, dim: int, tokens: str, by: str, out: str) -> DataFrame:
    """(by, mean vector) of each row, ``by`` being a long different in all rows; vectors are (word, _vec).

    A small word table is broadcast. With a larger one rows are not exploded and
    moved by word, where each would leave a partial mean for nearly every word
    of its own: parts of the rows are brought the vectors of their words.
    """
    if fits_broadcast(vectors):
        # Outer, so that no size test repeats the work behind the tokens; nulls find no vector.
        exploded = df.select(by, F.explode_outer(tokens).alias("word"))
        found = join_words(exploded, vectors, "word", True, "inner")
        means = found.groupBy(by).agg(Summarizer.mean(F.col("_vec")).alias(out))
    else:
        given = vectors.select("word", vector_to_array("_vec").alias("vector"))
        means = part_means(df.select(by, tokens), given, dim, tokens, by).select(by, array_to_vector("mean").alias(out))
    zero = array_to_vector(F.array_repeat(F.lit(0.0), dim))
    return df.select(by).join(means, by, "left").withColumn(out, F.coalesce(out, zero))


def mean_vectors(df: DataFrame, vectors: DataFrame, tokens: str = "tokens", id_col: str = "id",
                 out: str = "mean") -> DataFrame:
    """(id, mean) as arrays, from any table ``vectors(word, vector)`` of equally long arrays.

    One row for each row of ``df``, also where ids are null or repeated. Means
    are combined per text on the map side. Texts without a known word get zeros.
    """
    dim = vectors.select(F.size("vector")).first()[0]
    lookup = vectors.select("word", array_to_vector(F.col("vector").cast("array<double>")).alias("_vec"))
    rows = numbered(df.select(id_col, tokens), "tokens")
    means = _means(rows, lookup, dim, tokens, "_row", out)
    return rows.select("_row", id_col).join(means, "_row").select(id_col, vector_to_array(out).alias(out))


def hybrid_vectors(df: DataFrame, scores: DataFrame, tfidf: str = "tfidf", id_col: str = "id",
                   out: str = "hybrid") -> DataFrame:
    """The TF-IDF vector followed by the six lexicon scores.

    ``scores`` has one row per id. Null ids match each other; a row without
    scores gets zeros, so every row of ``df`` comes back once.
    """
    given = scores.select(F.col(id_col).alias("_scored"), *R.LEXICON_COLUMNS)
    joined = df.join(given, F.col(id_col).eqNullSafe(F.col("_scored")), "left").drop("_scored")
    joined = joined.fillna(0.0, list(R.LEXICON_COLUMNS))
    assembler = VectorAssembler(inputCols=[tfidf, *R.LEXICON_COLUMNS], outputCol=out)
    return assembler.transform(joined).drop(*R.LEXICON_COLUMNS)


@dataclass(frozen=True)
class FeatureSets:
    """All representations of one split table, in the columns named by ``columns``."""

    table: DataFrame
    terms: TermModel
    word2vec: WordVectors
    columns: dict[str, str]


def all_feature_sets(df: DataFrame, valence: DataFrame, polarity: DataFrame, max_features: int = R.MAX_FEATURES,
                     word2vec_dim: int = R.WORD2VEC_DIM, word2vec_epochs: int = R.WORD2VEC_EPOCHS,
                     **rules) -> FeatureSets:
    """Four vector columns on a table with ``split``, ``review``, ``tokens`` and ``cleaned_review``.

    Vocabulary and word vectors are fitted on the train rows only, once each;
    TF-IDF and hybrid share the vocabulary of the bag of words. Terms are made
    once, and the four columns are written once: what reads one of them later
    is a scan of that column. Every row keeps its own features, whatever its id.
    """
    termed = numbered(with_terms(df), "terms")
    train = termed.filter("split = 'train'")
    model = fit_terms(train, max_features)
    embedder = fit_word2vec(train, word2vec_dim, epochs=word2vec_epochs)
    table = tfidf_vectors(count_vectors(termed, model), model).drop("terms")
    table = word2vec_vectors(table, embedder)
    scores = lexicon_scores(termed, valence, polarity, id_col="_row", **rules)
    table = materialize(hybrid_vectors(table, scores, id_col="_row").drop("_row"), "features")
    return FeatureSets(table, model, embedder, dict(zip(R.FEATURE_SETS, ("bow", "tfidf", "word2vec", "hybrid"))))
