"""SimHash: fingerprints against a plain count of bits, classes against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from textmeter.llm import simhash

HARD = [None, "", "   ", "one", "One two", "one two three", "ONE two three", "é ü x y z", "a b c a b c a b c", "\x0ba\tb\x1cc\nd"]


def plain_fingerprint(text, width=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c == " " or 9 <= ord(c) <= 13:
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    """Smallest index reachable over pairs within two bits."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(len(prints)):
                if (prints[i] ^ prints[j]).bit_count() <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def texts(n=60, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(40, 400))) for _ in range(n // 3)]
    near = [b.replace("w1 ", "w2 ", 1) for b in base]
    return base + near + rng.sample(base, n // 6) + HARD


def test_fingerprint_counts_bits():
    for t in texts():
        assert simhash.fingerprint(t or "", 3) % 2**64 == plain_fingerprint(t)


def test_long_texts_are_counted_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "HASHED_AT_ONCE", 7)
    for t in texts(12):
        assert simhash.fingerprint(t or "", 3) % 2**64 == plain_fingerprint(t)


def test_classes_equal_all_pairs(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    want = [(i, f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, plain_classes(prints)))]
    assert sorted(map(tuple, simhash.near_duplicates(df).collect())) == want
    kept = {r.doc_id for r in simhash.representatives(df).collect()}
    assert kept == {c for _, _, c in want}


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 12, dtype="u8")
    prints = set(rng.integers(0, 2**63, n // 3, dtype="u8").tolist())
    for c in rng.choice(centres, n).tolist():
        for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
            c ^= 1 << b
        prints.add(c)
    return sorted(prints)


@pytest.mark.parametrize("subtree", [1 << 16, 40])
def test_links_connect_what_all_pairs_connect(spark, subtree):
    prints = clustered(400, 5)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = [(r.fp % 2**64, r.below % 2**64) for r in simhash.hamming_links(df, 2, subtree).collect()]
    assert all((a ^ b).bit_count() >= 1 for a, b in links)
    at = {p: i for i, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = root(at[a]), root(at[b])
        parent[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(prints))] == plain_classes(prints)


def test_trie_meets_each_pair_once(monkeypatch):
    monkeypatch.setattr(simhash, "EXPANDED_AT_ONCE", 16)
    prints = np.array(clustered(150, 8), "u8")
    met = [tuple(sorted(p)) for block in simhash.trie_links(prints, prints, 0, 0, 3, True) for p in block.T.tolist()]
    want = {(i, j) for j in range(len(prints)) for i in range(j) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 3}
    assert len(met) == len(set(met)) and set(met) == want


def test_missing_keys_repeats_and_empty_tables(spark):
    long_text = " ".join(f"word{i}" for i in range(300))
    rows = [(5, long_text), (5, long_text), (None, long_text), (None, "alone here at last"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (None, None), (3, 3), (4, 3)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in simhash.representatives(df).collect()), key=str)
    assert kept == sorted([(5, long_text), (None, "alone here at last"), (3, None)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.representatives(df.limit(0)).columns == ["doc_id", "text"]
