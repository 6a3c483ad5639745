"""Word bigram models against ones kept in dictionaries; the query uses them."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import compute as pc

from textmeter.llm import queries, word_lm

ROWS = [(1, "the cat sat on the mat."), (2, "Colourless green ideas sleep"), (3, "the mat sat on a cat"), (4, None), (5, " \n"), (6, "theé theé ünï, the"),
        (6, "second text of six"), (None, "the cat"), (7, "the cat sat on the mat."), (8, "我们的猫the猫"), (9, "the " * 40 + "end")]
GOOD = [1, 3, 3, 6, None]


def plain_words(text):
    """Runs of letters, single Chinese characters, single marks."""
    return re.findall(r"[一-鿿]|[^\W一-鿿]+|[^\w\s]", text or "")


def plain_model(texts, vocabulary):
    """p(w | h) by Witten-Bell, straight from the definition."""
    bi, uni = Counter(), Counter()
    for t in texts:
        w = plain_words(t)
        uni.update(w)
        bi.update(zip([None, *w], w))
    total, kinds = sum(uni.values()), max(len(uni), 1)

    def p(h, w):
        p1 = (uni[w] + kinds / len(vocabulary)) / (total + kinds)
        after = [n for (a, _), n in bi.items() if a == h]
        return (bi[h, w] + len(after) * p1) / (sum(after) + len(after)) if after else p1

    return p


def wanted(rows, good):
    vocabulary = {w for _, t in rows for w in plain_words(t)}
    models = [plain_model([t for k, t in rows if k in good and k is not None], vocabulary), plain_model([t for _, t in rows], vocabulary)]
    for h in (None, "the", "never"):
        assert all(abs(sum(m(h, w) for w in vocabulary) - 1) < 1e-9 for m in models)
    out = []
    for k, t in rows:
        w = plain_words(t)
        a, b = ([-math.log(m(x, y)) for x, y in zip([None, *w], w)] for m in models)
        out.append((k, len(w), *((sum(a) / len(w), sum(b) / len(w), (sum(a) - sum(b)) / len(w)) if w else (None,) * 3)))
    return out


def check(got, want):
    def order(r):
        return str((r[0], r[1], r[2] and round(r[2], 6)))

    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order)):
        assert a[:2] == b[:2]
        assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(a[2:], b[2:]))


@pytest.mark.parametrize(("block", "piece"), [(1 << 20, 1 << 20), (3, 5)])
def test_equals_the_dictionaries(spark, monkeypatch, block, piece):
    monkeypatch.setattr(word_lm, "BLOCK", block)
    monkeypatch.setattr(word_lm, "SLICE", piece)
    docs = spark.createDataFrame([(*r, 9.5) for r in ROWS], "doc_id long, text string, score double").repartition(3)
    good = spark.createDataFrame([(k, 1) for k in GOOD], "doc_id long, quality int")
    check(word_lm.cross_entropy_difference(docs, good).collect(), wanted(ROWS, GOOD))


def test_the_query_counts_words(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (3, 1), (6, 1), (2, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    check(queries.QUERIES["op5_cross_entropy"](spark, str(tmp_path)).collect(), wanted(ROWS, [1, 3, 6]))


def test_no_target_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    none = docs.limit(0).select("doc_id")
    r = word_lm.cross_entropy_difference(docs, none).first()
    assert abs(r.target_loss - math.log(4)) < 1e-9 and r.n_tokens == 4
    assert word_lm.cross_entropy_difference(docs.limit(0), none).count() == 0


def test_totals_come_back_in_the_order_asked():
    """Blocks ask for sums over all of them; a distinct pair takes less than 8 bytes on its way, 24 to 40 as a row."""
    rng = np.random.default_rng(3)
    blocks = [np.unique(rng.integers(0, 2**64, 1000, "u8", endpoint=False)[rng.integers(0, 1000, 800)]) for _ in range(2)]
    blocks += [np.unique(np.concatenate([blocks[0][::2], blocks[1][::3]])), np.array([0, 2**64 - 1], "u8")]
    asked = [word_lm.ask(i, keys, [keys % 7 + 1, keys % 2], 3, 10 + i) for i, keys in enumerate(blocks)]
    every = pa.concat_tables(asked)
    back = pa.concat_tables([word_lm.answer(every.filter(pc.equal(every["part"], p))) for p in range(3)])
    times = Counter(k for keys in blocks for k in keys.tolist())
    owned = Counter()
    for i, keys in enumerate(blocks):
        rows = back.filter(pc.equal(back["block"], i))
        assert set(rows["carried"].to_pylist()) == {10 + i}
        n, odd, own = word_lm.answered(rows, 2)
        assert n.tolist() == [times[k] * (k % 7 + 1) for k in keys.tolist()]
        assert odd.tolist() == [times[k] * (k % 2) for k in keys.tolist()]
        owned.update(k for k, o in zip(keys.tolist(), own) if o)
    assert owned == dict.fromkeys(times, 1)
    kinds = [k for k in back["kinds"].to_pylist() if k]
    assert [sum(k) for k in zip(*kinds)] == [len(times), sum(k % 2 for k in times)]
    wide = np.unique(rng.integers(0, 2**64, 1 << 18, "u8", endpoint=False))
    sent = word_lm.ask(0, wide, [np.ones(len(wide), "i8"), np.arange(len(wide)) % 2], 8, 0)
    assert sum(map(len, sent["keys"].to_pylist() + sent["sums"].to_pylist())) < 8 * len(wide)


def test_numbers_are_packed_whole():
    for values in (np.zeros(0, "i8"), np.array([0, -1, 2**63 - 1, -2**63]), np.arange(5)):
        assert word_lm.unpack(word_lm.pack(values)).tolist() == values.tolist()
