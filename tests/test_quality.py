import pytest
from pyspark.sql import functions as F

from textmeter.operators import cleaning as C, quality as Q


def test_missing_columns_fail_before_any_work(table):
    with pytest.raises(ValueError, match="sentiment"):
        Q.require_columns(table([("a",)], "review string"))


def test_dedup_keeps_first_and_one_null(table):
    rows = [(5, "a"), (2, "a"), (9, None), (7, None), (1, "b")] + [(100 + i, "hot") for i in range(500)]
    kept = Q.dedup(table(rows, "id long, review string").repartition(5)).collect()
    assert sorted(r.id for r in kept) == [1, 2, 7, 100]


def test_dup_counts(table):
    rows = [("A!", "a"), ("a", "a"), (None, ""), (None, "")]
    r = Q.dup_counts(table(rows, "review string, cleaned_review string")).first()
    assert (r.raw_duplicates, r.cleaned_duplicates) == (1, 2)


def test_leakage_counts_whole_words(table):
    rows = [("a Positive b", 1), ("positively", 1), ("positive", 0), (None, 0)]
    out = Q.label_leakage(table(rows, "cleaned_review string, sentiment int")).collect()
    assert [(r.word, r.n_rows, r.pos, r.neg) for r in out] == [("positive", 2, 1, 1)]


def test_gate_names_the_first_failure(table):
    df = table([(i, f"w{i} x y") for i in range(20)] + [(99, None)], "id long, review string")
    gate = lambda **k: Q.realism_gate(df, **({"min_rows": 1, "min_avg_words": 1, "min_vocabulary": 1} | k)).first()
    assert gate(min_rows=22).reason == "rows"
    assert gate(min_avg_words=4).reason == "avg_words"
    assert gate(min_vocabulary=23).reason == "vocabulary"
    ok = gate()
    assert (ok.passed, ok.n_rows, ok.avg_words, ok.vocabulary) == (True, 21, 3.0, 22)


def test_vocabulary_verdict_and_top(table):
    df = table([("bb aa bb a cc aa",)], "cleaned_review string")
    assert tuple(Q.vocab_sanity(df).first()) == (3, "critical")
    assert [tuple(r) for r in Q.top_tokens(df, 2).collect()] == [("aa", 2), ("bb", 2)]


def test_vocabulary_has_no_cap(spark):
    df = spark.range(60_000).selectExpr("concat('w', id) AS cleaned_review")
    assert Q.vocab_sanity(df).first().vocabulary == 60_000


def test_leakage_words_are_literal(table):
    out = Q.label_leakage(table([("a.c", 1), ("abc", 0)], "cleaned_review string, sentiment int"), ["a.c"]).collect()
    assert [(r.word, r.n_rows) for r in out] == [("a.c", 1)]


def test_balance(table):
    df = lambda p, n: table([(1,)] * p + [(0,)] * n, "sentiment int")
    assert tuple(Q.class_balance(df(23, 20)).first()) == (23, 20, 1.15, True)
    assert tuple(Q.class_balance(df(3, 0)).first()) == (3, 0, 3.0, False)


def test_split_leakage(table):
    rows = [("x", "train")] * 3 + [("x", "test"), ("y", "test"), ("z", "train")]
    assert tuple(Q.split_leakage(table(rows, "cleaned_review string, split string")).first()) == (1, 3, 1)


NOUNS = ["movie", "city", "box", "us", "u", "church", "man", "wolf", "glasses", "glass", "bus"]
LEMMAS = {
    "movies": "movie", "cities": "city", "boxes": "box", "us": "u", "churches": "church", "men": "man",
    "wolves": "wolf", "glasses": "glass", "geese": "goose", "running": "running", "bus": "bus",
}


@pytest.mark.parametrize("limit", [500_000, 1])
def test_lemmas(table, monkeypatch, limit):
    import textmeter.operators.lookup as lookup
    monkeypatch.setattr(lookup.fits_broadcast, "__defaults__", (limit,))
    tokens = table([(w,) for w in LEMMAS], "token string")
    nouns = table([(n,) for n in NOUNS + ["goose"]], "term string")
    lemmas = C.lemma_table(tokens, nouns, table([("geese", "goose")], "form string, lemma string"))
    got = {r.form: r.lemma for r in lemmas.collect()}
    assert got == {f: l for f, l in LEMMAS.items() if f != l}

    rows = [(i, list(LEMMAS) * 3, "kept") for i in range(20)] + [(99, [], "kept")]
    out = {r.id: r for r in C.lemmatize(table(rows, "id long, tokens array<string>, other string"), lemmas).collect()}
    assert out[3].tokens == list(LEMMAS.values()) * 3 and out[99].tokens == [] and out[99].other == "kept"


def test_length_is_tested_before_the_lemma(table):
    df = table([(1, "us a x")], "id long, review string")
    lemmas = table([("us", "u")], "form string, lemma string")
    assert C.clean_text(df, lemmas).first().cleaned_review == "u"


def test_dedup_loses_no_text_and_keeps_none_twice(table):
    rows = [(1, "a a", 0), (None, "b b", 0), (2, "a a", 0), (2, "c c", 0), (None, "b b", 1), (3, "d", 5), (3, "d", 5), (3, "d", 6), (None, None, 0), (None, None, 0), (4, None, 0)]
    kept = Q.dedup(table(rows, "id long, review string, n int").repartition(5))
    got = sorted(((r.id, r.review) for r in kept.collect()), key=repr)
    assert got == sorted([(1, "a a"), (None, "b b"), (2, "c c"), (3, "d"), (4, None)], key=repr)
    assert kept.columns == ["id", "review", "n"]


def test_lemmas_of_rows_without_their_own_id(table, monkeypatch):
    import textmeter.operators.lookup as lookup
    rows = [(None, ["cats", "zz"]), (2, ["z"]), (2, ["cats", "cats", "z"]), (None, None), (3, []), (4, ["dogs", None, "cats"])]
    lemmas = table([("cats", "cat"), ("dogs", "dog"), (None, "x"), ("same", "same")], "form string, lemma string")
    want = sorted([(None, ["cat", "zz"]), (2, ["z"]), (2, ["cat", "cat", "z"]), (None, []), (3, []), (4, ["dog", "cat"])], key=repr)
    for limit in (500_000, 1):
        monkeypatch.setattr(lookup.fits_broadcast, "__defaults__", (limit,))
        got = C.lemmatize(table(rows, "id long, tokens array<string>").repartition(3), lemmas)
        assert got.columns == ["id", "tokens"]
        assert sorted(((r.id, r.tokens) for r in got.collect()), key=repr) == want
