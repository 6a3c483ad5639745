import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from textmeter import resources as R
from textmeter.functions import text as X


def apply(table, values, fn):
    rows = [(i, v) for i, v in enumerate(values)]
    out = table(rows, "i int, t string").select("i", fn(F.col("t")).alias("r")).orderBy("i").collect()
    return [r.r for r in out]


CONTRACTIONS = {
    "I can't say it's good, Don't go": "I cannot say it is good, do not go",
    "DON'T bother. It's bad": "DON'T bother. It's bad",
    "don’t watch; I'd not": "don’t watch; I would not",
    "They're fine but they're late, he's she's": "They're fine but they are late, he is she is",
    "cannot gonna wanna movies 10/10": "cannot gonna wanna movies 10/10",
    "Won't WON'T won't": "will not WON'T will not",
    "<b>isn't</b>it isn't.it": "<b>is not</b>it is not.it",
}


def test_contractions_golden(table):
    assert apply(table, CONTRACTIONS, X.expand_contractions) == list(CONTRACTIONS.values())


def one_by_one(text):
    for form, expansion in R.CONTRACTIONS.items():
        text = re.sub(rf"\b{form}\b", expansion, text)
    return text


def test_grouped_rules_equal_the_table_applied_row_by_row(table):
    rng = random.Random(7)
    words = list(R.CONTRACTIONS) + ["DON'T", "don", "t", "xisn't", "isn'tx", "éisn't", "it", "'s", "cannots", "he'll"]
    glue = [" ", ",", "", "'", "é", ". "]
    texts = ["".join(itertools.chain.from_iterable((rng.choice(words), rng.choice(glue)) for _ in range(8))) for _ in range(400)]
    expected = [one_by_one(t) for t in texts]
    assert apply(table, texts, X.expand_contractions) == expected
    folded = apply(table, texts, lambda c: F.lower(X.expand_contractions(c, fold_case=True)))
    assert folded == [t.lower() for t in expected]


SPLITS = {f"{a}{b}": f"{a} {b}" for a, b in R.TOKEN_SPLITS.values()}


def stepwise_tokens(text, stop_words=R.STOP_WORDS):
    """The chain step by step, in Python."""
    text = re.sub(r"<[^>]+>", " ", text)
    text = re.sub(r"http\S+|www\.\S+", " ", text)
    text = one_by_one(text).lower()
    text = re.sub(r"[^a-zA-Z0-9\s]", " ", text)
    text = re.sub(r"\s+", " ", text).strip()
    for whole, parts in SPLITS.items():
        text = re.sub(rf"\b{whole}\b", parts, text)
    return [t for t in text.split() if t not in stop_words and len(t) >= 2]


CLEANED = {
    "I can't say it's good, Don't go": "i can not say it is good do not go",
    "DON'T bother. It's bad": "don t bother it s bad",
    "don’t watch; I'd not": "don t watch i would not",
    "They're fine but they're late, he's she's": "they re fine but they are late he is she is",
    "cannot gonna wanna movies 10/10": "can not gon na wan na movies 10 10",
    "Won't WON'T won't": "will not won t will not",
    "<b>isn't</b>it isn't.it": "is not it is not it",
    "<a\nb>c": "c",
    "www.foo.com,bar": "",
    "café naïve 10/10": "caf na ve 10 10",
    "x y　z": "x y z",
    "İstanbul": "i stanbul",
    "xcannot cannots cannoté": "xcannot cannots can not",
}


def test_chain_without_stop_words_golden(table):
    got = apply(table, CLEANED, lambda c: F.array_join(X.clean_tokens(c, stop_words=(), min_length=1), " "))
    assert got == list(CLEANED.values())


def test_fused_chain_equals_single_steps(table, spark):
    rng = random.Random(11)
    pieces = ["<br />", "<p\nx>", "http://a.b/c?d", "www.x.y", "isn't", "Can't", "cannot", "gonna", "WANNA", "the", "not",
              "é", "İ", " ", "\t", "\n", "!!", "a", "ok", "10/10", "it's", "<", ">", "xcannot", "Movie", " ", "_"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(15)) for _ in range(400)]
    assert apply(table, texts, X.clean_tokens) == [stepwise_tokens(t) for t in texts]

    def chained(c):
        x = X.lowercase(X.expand_contractions(X.strip_urls(X.strip_html(c))))
        return X.min_token_length(X.remove_stop_words(X.tokenize(X.normalize_whitespace(X.strip_special(x)))))

    assert apply(table, texts, chained) == [stepwise_tokens(t) for t in texts]


def test_null_text_is_empty(table):
    assert apply(table, [None], X.clean_tokens) == [[]]
    assert apply(table, [None, "", "  ", " a  b\n"], X.word_count) == [0, 0, 0, 2]


def test_keep_letters(table):
    assert apply(table, ["Café Größe!"], lambda c: X.clean_tokens(c, keep_letters=True)) == [["café", "größe"]]


def test_negations_keep_their_punctuation(table):
    assert apply(table, ["Not not, never don't dont NOR"], X.negation_count) == [4]


def test_preview_cuts_before_it_replaces(table):
    assert apply(table, ["ab\ncdef"], lambda c: X.text_preview(c, 4)) == ["ab c"]


def test_labels_and_argmax(table):
    out = table([(0, [0.5, 0.5]), (1, [0.1, 0.9])], "c int, s array<double>")
    rows = out.select(X.label_name(F.col("c")).alias("n"), X.argmax(F.col("s")).alias("a")).collect()
    assert [(r.n, r.a) for r in rows] == [("Negative", 0), ("Positive", 1)]


@pytest.mark.parametrize("tokens, expected", [
    ([], []), (["aa"], ["aa"]), (["aa", "bb", "cc"], ["aa", "bb", "cc", "aa bb", "bb cc"]),
])
def test_ngrams(table, tokens, expected):
    rows = table([(tokens,)], "t array<string>").select(X.ngrams_1_2(F.col("t")).alias("r")).collect()
    assert rows[0].r == expected


def test_vector_tokens_skip_single_letters(table):
    assert apply(table, ["A bc d, É éa x_y"], X.vector_tokens) == [["bc", "éa", "x_y"]]
