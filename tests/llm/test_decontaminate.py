"""Contaminated documents against all windows of all items, without fingerprints."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from textmeter.llm import decontaminate
from textmeter.llm.decontaminate import Benchmark, HammingIndex


def plain(docs, items, limit=0.8):
    """{(doc, item): (start, end, similarity)}: the best of all windows, the first among equals."""
    def bag(words):
        return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))

    held = [(i, [w.lower() for w in re.findall(r"\w+", t)]) for i, t in items if t and re.search(r"\w", t)]
    bags = [bag(w) for _, w in held]

    def weight(s):
        return len("".join(s))

    out = {}
    for d, text in docs:
        found = list(re.finditer(r"\w+", text or ""))
        words = [m.group().lower() for m in found]
        for (item, w), b in zip(held, bags):
            best = None
            for start in range(len(words) - len(w) + 1):
                c = bag(words[start:start + len(w)])
                both = sum(weight(s) * min(b[s], c[s]) for s in b.keys() | c.keys())
                similarity = both / sum(weight(s) * max(b[s], c[s]) for s in b.keys() | c.keys())
                if similarity >= limit and (best is None or similarity > best[2]):
                    best = found[start].start(), found[start + len(w) - 1].end(), similarity
            if best:
                out.setdefault((d, item), []).append(best)
    return out


def prose(rng, n):
    return " ".join(rng.choice("the of and thin reed over ather ingen tion ble ou shand".split()) + rng.choice(["", "", "", "s", ",", "."]) for _ in range(n))


def sample(seed=6):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.randint(8, 50))) for i in range(25)]
    items += [(40, items[3][1] + " and more"), (41, "Three short words"), (42, "one two three four five"), (43, "..."), (44, None), (None, prose(rng, 20)), (3, items[5][1])]
    docs = [(i, prose(rng, rng.randint(0, 120))) for i in range(40)]
    for i in range(60):
        item = rng.choice([t for _, t in items if t])
        words = item.split()
        change = rng.randint(0, 3)
        for _ in range(change):
            words[rng.randrange(len(words))] = rng.choice(["changed", "", "the"])
        docs.append((100 + i, f"{prose(rng, 20)} {rng.choice([str.upper, str.lower, str])(' '.join(words))}\n{prose(rng, 20)}"))
    return docs, items


def test_equals_all_windows(spark):
    docs, items = sample()
    docs += [(900, None), (901, ""), (902, "... !!"), (903, prose(random.Random(1), 600)), (None, items[0][1]), (100, docs[-1][1])]
    want = plain(docs, items)
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, similarity double").repartition(4)
    got = decontaminate.find_items(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {}
    for r in got:
        found.setdefault((r.doc_id, r.item_id), []).append((r.start, r.end, r.similarity))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert all(r.distance <= decontaminate.RADIUS for r in got)
    kept = decontaminate.drop_contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == df.columns
    hit = {d for d, _ in want}
    left = [(r.doc_id, r.text) for r in kept.collect()]
    # Key 100 has two texts: each decides for itself.
    assert sorted(str(d) for d in left if d[0] != 100) == sorted(str(d) for d in docs if d[0] not in hit and d[0] != 100)
    assert sorted(d for d in left if d[0] == 100) == sorted(d for d in docs if d[0] == 100 and not plain([d], items))


def shortened(text, item, limit=0.8):
    """(start, end, similarity) of a text with fewer words than the item, as a whole."""
    found, other = list(re.finditer(r"\w+", text)), re.findall(r"\w+", item.lower())
    words = [m.group().lower() for m in found]
    if not words or len(words) >= len(other):
        return None
    a, b = (Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) for w in (words, other))
    both, every = (sum(len("".join(s)) * pick(a[s], b[s]) for s in a.keys() | b.keys()) for pick in (min, max))
    return (found[0].start(), found[-1].end(), both / every) if both / every >= limit else None


def test_texts_shorter_than_the_item():
    rng = random.Random(8)
    letters = "abcdefghijklmnop"
    items = [(i, " ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(size))) for i, size in enumerate([1, 3, 4, 5, 6, 7, 9, 12, 20, 33, 59, 59, 120])]
    items.append((90, "word " * 30))
    benchmark, hits = Benchmark(items), 0
    first = items[10][1].split()
    assert [m[0] for m in benchmark.search(" ".join(first[:55]))] == [10]
    for _, text in items:
        words = text.split()
        for left in range(max(0, len(words) - 30), len(words)):
            begin = rng.randint(0, len(words) - left)
            doc = f" ({', '.join(words[begin:begin + left]).title()}."
            got = {m[0]: m[1:4] for m in benchmark.search(doc) if len(re.findall(r"\w+", dict(items)[m[0]])) > left}
            want = {i: found for i, t in items if (found := shortened(doc, t))}
            assert got == want
            hits += len(want)
    assert hits > 40


def test_a_shortened_item_goes(spark):
    item = " ".join(f"word{i}" for i in range(59))
    rows = [(1, " ".join(item.split()[:55])), (2, " ".join(item.split()[:40])), (3, "own words of this text only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.start, r.end) for r in decontaminate.find_items(docs, asked).collect()] == [(1, 7, 0, len(rows[0][1]))]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, asked).collect()) == [2, 3]


def test_a_very_long_text(spark):
    long_text = "lorem ipsum " * 200_000 + "the quick brown fox jumps over the lazy dog " + "dolor sit " * 100_000
    items = [(1, "quick brown fox jumps over the lazy"), (2, "not in there at all today")]
    assert [m[0] for m in Benchmark(items).search(long_text)] == [1]


def test_parts_of_a_large_benchmark_find_the_same(spark, monkeypatch):
    docs, items = sample(11)
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontaminate.find_items(df, asked).collect()))
    monkeypatch.setattr(decontaminate, "PART_BYTES", 1500)
    assert whole and sorted(map(str, decontaminate.find_items(df, asked).collect())) == whole


@pytest.mark.parametrize("radius", [0, 3, 23])
def test_index_misses_nothing_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    prints = rng.integers(0, 2**63, 50, dtype="u8")
    queries = np.concatenate((rng.integers(0, 2**63, 50, dtype="u8"), prints))
    for i in range(50, 100):
        for bit in rng.integers(0, 64, radius).tolist():
            queries[i] ^= np.uint64(1 << bit)
    got = set(zip(*(x.tolist() for x in HammingIndex(prints, radius).near(queries))))
    assert got == {(i, j) for i in range(100) for j in range(50) if (int(queries[i]) ^ int(prints[j])).bit_count() <= radius}


def test_radius():
    """Windows that reach the similarity differ by less than the radius, at every size and place of the change."""
    rng = random.Random(3)
    worst = 0
    for _ in range(1500):
        size = rng.randint(5, 60)
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        other = list(words)
        cut = rng.randint(0, max(1, size // 9))
        other = [f"x{rng.randrange(10**6)}" for _ in range(cut)] + other[cut:] if rng.random() < 0.5 else other[cut:] + [f"x{i}" for i in range(cut)]
        b = Benchmark([(0, " ".join(words))])
        if b.similar(Counter(decontaminate.shingles(words)), Counter(decontaminate.shingles(other))) >= 0.8:
            prints = [decontaminate.packed(b._sums(decontaminate.shingles(w))[None])[0] for w in (words, other)]
            worst = max(worst, (int(prints[0]) ^ int(prints[1])).bit_count())
    assert 5 < worst < decontaminate.RADIUS


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = docs.selectExpr("doc_id AS item_id", "text").limit(0)
    assert decontaminate.find_items(docs, none).count() == 0
    assert decontaminate.find_items(docs, none).columns == ["doc_id", "item_id", "start", "end", "similarity", "distance"]
    assert decontaminate.drop_contaminated(docs, none).count() == 1
    assert decontaminate.find_items(docs.limit(0), docs.selectExpr("doc_id AS item_id", "text")).count() == 0
