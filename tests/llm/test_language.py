"""Language identification: accuracy on held-out documents, and odd texts."""

import zlib

import numpy as np
import pytest

from textmeter.llm import language

HELD_OUT = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 3 == 1)
LEARNED = [k for k in range(100) if zlib.crc32(str(k).encode()) % 3 != 1]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return language.learn(docs, sample=60)


def test_machines(model):
    assert model["languages"] == ["de", "en", "es", "fr"]
    assert set(model["machines"]) == {("family", "germanic", ""), ("family", "romance", ""), ("pair", "de", "en"), ("pair", "es", "fr")}


def test_accuracy_on_held_out_documents(docs, model):
    got = language.identify(docs.filter(language.held_out("doc_id")), model).collect()
    assert len(got) > 250
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_is_the_checksum(docs):
    for r in docs.limit(50).select("doc_id", language.held_out("doc_id").alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_features_in_blocks(monkeypatch):
    text = "Größe, 12 naïve   Wörter... 日本 x" * 40
    whole = language.features(text)
    assert abs(np.linalg.norm(whole) - 1) < 1e-5
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(language, "BLOCK", size)
        assert np.allclose(language.features(text), whole)
    assert np.array_equal(language.features("a-b"), language.features("A  b!"))


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)).astype("f4")
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0.3, 1, -1)
    w = language.fit_svm(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97


def test_odd_texts(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 !!! 😀", "x"), (4, "Der die und nicht " * 50_000, "x"), (None, "Der die und nicht", "x"), (4, "é", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = language.identify(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.lang_pred == "und") == (r.text in (None, "", "123 !!! 😀")) and 0 <= r.score <= 1
    assert language.identify(df.limit(0), model).count() == 0


@pytest.mark.parametrize(("rows", "want"), [
    ([], "und"), ([(0, "ab cd", None)], "und"), ([(0, "ab cd", "xx")], "xx"), ([(0, "ab cd", "de"), (2, "ef gh", "en")], "de"),
    ([(0, "ab cd", "de"), (2, "ef gh", "xx"), (None, "12", "yy"), (0, "ab cd", "de")], "de"), ([(0, "ef gh", "fr"), (HELD_OUT, "ab cd", "es")], "fr"),
])
def test_few_labels(spark, rows, want):
    rows = [(k if k in (None, HELD_OUT) else LEARNED[k], *rest) for k, *rest in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(df)
    asked = spark.createDataFrame([(5, "ab ab cd")], "doc_id long, text string")
    assert language.identify(asked, model).first().lang_pred == (want if model["languages"] else "und")
