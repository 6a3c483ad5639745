import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textmeter import resources as R
from textmeter.operators import features as V


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    words = [f"w{i:02d}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    return [" ".join(rng.choices(words, weights, k=rng.randint(0, 30))) for _ in range(n)]


def terms_of(text):
    t = text.split()
    return t + [f"{a} {b}" for a, b in zip(t, t[1:])]


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "train" if i < 100 else "test") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, cleaned_review string, split string")
    return V.with_terms(df).cache()


def brute_vocabulary(texts, k):
    tf, df = Counter(), Counter()
    for t in texts:
        tf.update(terms_of(t))
        df.update(set(terms_of(t)))
    top = sorted((x for x in tf if df[x] >= 2), key=lambda x: (-tf[x], x))[:k]
    return [(x, i, tf[x], df[x]) for i, x in enumerate(sorted(top))]


@pytest.mark.parametrize("k", [50, 10_000])
def test_vocabulary(docs, texts, k):
    got = V.vocabulary(docs.filter("split = 'train'"), k).orderBy("idx").collect()
    assert [tuple(r) for r in got] == brute_vocabulary(texts[:100], k)


def brute_tfidf(texts, vocabulary, n):
    idf = {x: math.log((1 + n) / (1 + df)) + 1 for x, _, _, df in vocabulary}
    index = {x: i for x, i, _, _ in vocabulary}
    out = {}
    for d, t in enumerate(texts):
        w = {index[x]: (1 + math.log(c)) * idf[x] for x, c in Counter(terms_of(t)).items() if x in index}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out |= {(d, i): v / norm for i, v in w.items()}
    return out


def test_tfidf_is_fitted_on_train_only(docs, texts):
    model = V.fit_terms(docs.filter("split = 'train'"), 200)
    table = V.tfidf_vectors(V.count_vectors(docs, model), model)
    got = {(r.id, r.idx): r.weight for r in V.entries(table, "tfidf").collect()}
    expected = brute_tfidf(texts, brute_vocabulary(texts[:100], 200), 100)
    assert got.keys() == expected.keys()
    assert all(math.isclose(got[k], expected[k], rel_tol=1e-9) for k in got)
    norms = {r.id: r.s for r in V.entries(table, "tfidf").groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()}
    assert all(math.isclose(s, 1.0) for s in norms.values())
    assert set(range(120)) - norms.keys() == {i for i, t in enumerate(texts) if not t}


def test_counts_and_shape(docs, texts):
    model = V.fit_terms(docs.filter("split = 'train'"), 200)
    table = V.count_vectors(docs, model)
    got = {(r.id, model.terms[r.idx]): r.n for r in V.entries(table, "bow", value="n").collect()}
    expected = {(i, x): c for i, t in enumerate(texts) for x, c in Counter(terms_of(t)).items() if x in set(model.terms)}
    assert got == expected
    shape = V.feature_shape(table, "bow", len(model.terms)).first()
    assert (shape.n_rows, shape.n_columns, shape.non_zeros, shape.too_small) == (120, 200, len(expected), True)


def test_top_weights(docs, texts):
    model = V.fit_terms(docs.filter("split = 'train'"), 200)
    table = V.tfidf_vectors(V.count_vectors(docs, model), model).filter("split = 'train'")
    sums = Counter()
    for (_, i), w in brute_tfidf(texts[:100], brute_vocabulary(texts[:100], 200), 100).items():
        sums[model.terms[i]] += w
    expected = sorted(sums, key=lambda x: (-round(sums[x], 6), x))[:10]
    assert [r.term for r in V.top_weighted_terms(table, "tfidf", model).collect()] == expected


def test_idf_table_agrees_with_model(docs):
    train = docs.filter("split = 'train'")
    model = V.fit_terms(train, 50)
    table = {r.term: r.idf for r in V.idf_table(train, 50).collect()}
    assert table == pytest.approx(dict(zip(model.terms, model.idf)))


@pytest.mark.parametrize("limit", [500_000, 1])
def test_mean_of_known_vectors(table, monkeypatch, limit):
    import textmeter.operators.lookup as lookup
    monkeypatch.setattr(lookup.fits_broadcast, "__defaults__", (limit,))
    vectors = table([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "word string, vector array<double>")
    docs = table([(0, ["a", "b", "zzz", "qqq"]), (1, []), (2, ["zzz"]), (3, ["a", "a", "b"])], "id long, tokens array<string>")
    got = {r.id: r.mean for r in V.mean_vectors(docs, vectors).collect()}
    assert got[0] == [2.0, 3.0] and got[1] == [0.0, 0.0] and got[2] == [0.0, 0.0]
    assert got[3] == pytest.approx([5 / 3, 8 / 3])


def test_word2vec_vocabulary_and_means(spark, docs, texts):
    tokens = docs.select("id", "split", F.split("cleaned_review", " ").alias("tokens"))
    model = V.fit_word2vec(tokens.filter("split = 'train'"), dim=4, epochs=1)
    vectors = model.getVectors().select("word", F.unwrap_udt("vector").getField("values").alias("vector"))
    counts = Counter(w for t in texts[:100] for w in t.split(" "))
    assert {r.word for r in vectors.collect()} == {w for w, c in counts.items() if c >= 2}
    fast = V.word2vec_vectors(tokens, model)
    slow = {r.id: r.mean for r in V.mean_vectors(tokens, vectors).collect()}
    for r in fast.collect():
        assert list(r.word2vec.toArray()) == pytest.approx(slow[r.id], abs=1e-6)


def test_hybrid_appends_six_scores(table):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("tfidf", VectorUDT())])
    df = table([(1, Vectors.sparse(3, [1], [0.5]))], schema)
    scores = table([(1, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6)], "id long, " + ", ".join(f"{c} double" for c in R.LEXICON_COLUMNS))
    v = V.hybrid_vectors(df, scores).first().hybrid
    assert v.size == 9 and list(v.toArray()) == [0, 0.5, 0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6]
