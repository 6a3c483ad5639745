"""Runs of words against every period tried at every place."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from textmeter.llm import queries, word_runs


def every_run(w, min_length=6, min_exponent=4):
    found = []
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            part = w[a:i + q]
            smaller = any(all(x == y for x, y in zip(part, part[p:])) for p in range(1, q))
            if len(part) >= max(min_length, min_exponent * q) and not smaller:
                found.append((a, len(part), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbers(w):
    return np.array(w, "u8")


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (5, 2), (6, 3), (9, 4)])
def test_runs_of_random_rows(least, times):
    rng = random.Random(least * 10 + times)
    for _ in range(1500):
        w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 50))]
        if rng.random() < 0.5:
            w[len(w) // 2:len(w) // 2] = [rng.randrange(4) for _ in range(rng.randint(1, 6))] * rng.randint(2, 8)
        assert word_runs.runs_of(numbers(w), least, times) == every_run(w, least, times), w


def test_long_rows():
    rng = random.Random(3)
    period = [rng.randrange(5000) for _ in range(700)]
    w = period * 9 + list(range(6000, 6500)) + [1] * 3000 + [1, 2] * 2000
    assert word_runs.runs_of(numbers(w)) == [(0, 6300, 700), (6800, 3001, 1), (9800, 4000, 2)] or every_run(w) == word_runs.runs_of(numbers(w))
    assert word_runs.runs_of(numbers(range(20000))) == []


def test_parts_hold_every_run():
    # Cutting at rare word groups loses nothing, whatever the thresholds.
    rng = random.Random(5)
    for _ in range(500):
        w = [rng.randrange(3) for _ in range(60)]
        for least, times in ((6, 4), (4, 2), (8, 3)):
            parts = list(word_runs.stretches(numbers(w), least, times))
            for a, n, _ in every_run(w, least, times):
                assert any(first <= a and a + n <= end for first, end in parts)


def test_each_visit_tells_the_last_one():
    # Against a plain walk to the root that keeps the last visit of each node.
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(1, 40)
        parent = [-1] + [rng.randrange(i) for i in range(1, n)]
        ends, plain = word_runs.LastEnds(parent), [-1] * n
        for moment in range(60):
            node = rng.randrange(n)
            told = [(x, m) for x, m in ends.visit(node, moment)]
            walk, expected = node, []
            while walk >= 0:
                if plain[walk] >= 0 and (not expected or expected[-1][1] != plain[walk]):
                    expected.append((walk, plain[walk]))
                plain[walk], walk = moment, parent[walk]
            assert told == expected


def test_automaton_states_are_the_distinct_groups():
    w = [1, 2, 1, 2, 3, 1, 2, 2, 1]
    length, link, prefix = word_runs.suffix_automaton(w)
    distinct = {tuple(w[a:b]) for a in range(len(w)) for b in range(a + 1, len(w) + 1)}
    assert sum(length[s] - length[link[s]] for s in range(1, len(length))) == len(distinct)
    assert [length[s] for s in prefix] == list(range(1, len(w) + 1))


HARD = [
    (1, "a b " * 10, "x"), (1, "a b " * 10, "x"), (2, None, "x"), (3, "", None), (4, " \t\n\x0b\f\r", "x"), (None, "z " * 7, None),
    (5, "no break no break no break no break no break no break", "x"), (6, "a a a a a", "x"), (7, "q q " * 6, "x"),
]


def test_hard_rows(table):
    docs = table(HARD, "doc_id long, text string, runs string")
    got = sorted(((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in word_runs.find_runs(docs).collect()))
    assert got == sorted([
        (1, [(0, 20, 2)], "a b"), (1, [(0, 20, 2)], "a b"), (2, [], ""), (3, [], ""), (4, [], ""), (0, [(0, 7, 1)], "z"),
        (5, [(0, 6, 1)], "no break"), (6, [], "a a a a a"), (7, [(0, 6, 1)], "q q"),
    ])
    empty = word_runs.find_runs(docs.limit(0))
    assert empty.columns == ["doc_id", "runs", "collapsed"] and empty.collect() == []


def test_overlapping_runs_keep_the_first_period():
    w = list("aaaaaabaaaaaab" * 4)
    words = [x.encode() for x in w]
    runs = word_runs.runs_of(word_runs.numbered(words))
    assert runs == every_run(w)
    dropped = {i for a, n, q in runs for i in range(a + q, a + n)}
    assert word_runs.collapse(words, runs) == " ".join(x for i, x in enumerate(w) if i not in dropped)


def test_thresholds_below_two_are_refused(table):
    with pytest.raises(ValueError):
        word_runs.find_runs(table([], "doc_id long, text string"), min_exponent=1)


def test_query_equals_every_run(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_word_runs"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = (texts[r.doc_id] or "").encode().split()
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 4000:
            continue
        runs = every_run(w)
        dropped = {i for a, m, q in runs for i in range(a + q, a + m)}
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        milli = best and 1000 * best[1] // best[2]
        listed = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
        kept = b" ".join(x for i, x in enumerate(w) if i not in dropped)
        assert tuple(r) == (r.doc_id, len(runs), *(best or (None,) * 3), milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
