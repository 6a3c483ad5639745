"""Ranked search against scoring every document plainly."""

import math
import random
import re

import numpy as np
import pytest

from textmeter.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, score string", "item_id long, text string, rank string"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    counted = [(i, t) for i, t in ((i, terms(t)) for i, t, *_ in docs) if t]
    n, length = len(counted), sum(len(t) for _, t in counted)
    df = {}
    for _, t in counted:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text, *_ in items:
        scored = []
        for i, t in counted:
            m = 50 + (50 * len(t) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * t.count(x)) // (1000 * t.count(x) + 20 * m)) for x in set(terms(text)) & set(t))
            if score > 0:
                scored.append((-score, i if i is not None else lexical.LAST_ID, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda s: s[:2])[:k], 1)]
    return out


def run(table, docs, items, k):
    found = lexical.best_documents(table(docs, DOCS), table(items, ITEMS), k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, found.collect()), key=repr)


def check(table, docs, items, k=5):
    assert run(table, docs, items, k) == sorted(plain(docs, items, k), key=repr)


def random_rows(seed, n, words, longest):
    rng = random.Random(seed)
    # Few words occur often, most seldom: many equal masks and equal scores.
    return [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % words}" for _ in range(rng.randint(0, longest))), "x") for i in range(n)]


@pytest.mark.parametrize("k", [1, 5, 50])
def test_random_rows(table, k):
    check(table, random_rows(1, 400, 40, 30), random_rows(2, 12, 60, 25), k)


def test_many_terms_and_blocks(table, monkeypatch):
    # Items of more than 64 terms, several blocks and several parts.
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", 300)
    monkeypatch.setattr(lexical, "PART_BYTES", 2000)
    monkeypatch.setattr(lexical, "FIRST_DOCS", 2)
    check(table, random_rows(3, 300, 500, 60), random_rows(4, 9, 500, 400), 7)


def test_hard_rows(table):
    docs = [
        (1, "Alpha beta", "a"), (1, "Alpha beta", "a"), (None, "alpha BETA", None), (2, None, "a"), (3, "", "a"), (4, "-- \n !", "a"),
        (5, "É é ÀB alpha", "a"), (6, "beta " * 5000, "a"), (7, "gamma 7 x", "a"), (8, "x_y x`z x{", "a"),
    ]
    items = [(1, "alpha alpha beta", "r"), (1, "alpha", "r"), (None, "beta", "r"), (2, None, "r"), (3, "", "r"), (4, "nothing here", "r"), (5, "é àb 7 x y", "r")]
    check(table, docs, items)


def test_equal_scores_by_id(table):
    docs = [(i, "same words here", "x") for i in range(300, 0, -1)] + [(1000 + i, f"other {i}", "x") for i in range(400)]
    assert [r[2] for r in sorted(run(table, docs, [(1, "same", "r")], 50), key=lambda r: r[1])] == list(range(1, 51))


def test_empty_tables(table):
    some = [(1, "a b", "x")]
    assert run(table, [], some, 5) == [] and run(table, some, [], 5) == [] and run(table, [], [], 5) == []


def test_no_group_that_could_win_is_left_out():
    rng = np.random.default_rng(7)
    for _ in range(30):
        n, vocabulary = 600, 90
        tf = rng.integers(0, 4, (n, vocabulary)) * (rng.random((n, vocabulary)) < rng.random(vocabulary) ** 2)
        weights, mass = rng.integers(0, 5000, vocabulary), rng.integers(50, 400, n)
        doc, term = np.nonzero(tf)
        order = rng.permutation(n)
        block = lexical.Block(order, mass, doc, term, tf[doc, term], weights)
        adds = weights * ((lexical.UNIT * tf) // np.maximum(1, 1000 * tf + lexical.MASS * mass[:, None]))
        item = rng.permutation(vocabulary)[:rng.integers(1, vocabulary)].tolist()
        total = adds[:, item].sum(axis=1)
        expected = sorted((-t, i) for t, i in zip(total.tolist(), order.tolist()) if t > 0)[:20]
        scores, ids = block.best(item, 20, np.zeros(0, "i8"), np.zeros(0, "i8"))
        assert list(zip((-scores).tolist(), ids.tolist())) == expected
