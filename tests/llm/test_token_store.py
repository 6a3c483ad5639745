"""Perfect hash, shard files and keyed access, against ids encoded directly."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textmeter.llm import bpe, token_store

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 65, 1000, 20_000):
        keys = rng.choice(2**62, n, replace=False).astype("i8")
        f = token_store.PerfectHash.build(keys)
        assert sorted(f.slots(keys).tolist()) == list(range(n))
        assert n < 1000 or sum(f.bits) < 4.5 * n
    keys = np.arange(5000)
    assert sorted(token_store.PerfectHash.build(keys).slots(keys).tolist()) == list(range(5000))


def expected(rows, library):
    """Ids in ascending key order, null last; [(key, start, n, crc)]."""
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def read_back(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string").repartition(3)
    manifest, folder = token_store.write_ids(df, bpe.tokenizer_json(FILE), 2)
    return manifest, folder, sorted((tuple(r) for r in token_store.checksums(manifest, folder).collect()), key=lambda r: (r[0] is None, r[1]))


def test_files_hold_all_ids_in_order(spark, library, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_TOKENS", 500)
    rows = [(r.doc_id * 3 - 50, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()[:120]]
    rows += [(10**12, None), (-5, ""), (10**12 + 1, "<|endoftext|> ordinary  text "), (None, "no key"), (10**12 + 2, "long " * 30_000)]
    manifest, folder, got = read_back(spark, rows)
    assert got == expected(rows, library)
    assert manifest.select("shard").distinct().count() > 1
    names = [r.shard for r in manifest.select("shard", "task", "part").distinct().orderBy("task", "part").collect()]
    payload = np.concatenate([token_store.Shard(f"{folder}/{n}").payload for n in names])
    direct = [library.encode(t or "", add_special_tokens=False).ids + [2] for _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))]
    assert payload.tolist() == [i for d in direct for i in d]


def test_keyed_access(spark, library):
    rows = [(i * 7, f"text number {i}") for i in range(50)]
    manifest, folder, _ = read_back(spark, rows)
    name = manifest.first().shard
    shard = token_store.Shard(f"{folder}/{name}")
    held = [r.key for r in manifest.filter(manifest.shard == name).collect()]
    for key in held:
        d = int(shard.find(np.array([key]))[0])
        assert shard.ids(d).tolist() == library.encode(f"text number {key // 7}", add_special_tokens=False).ids + [2]
    absent = np.arange(10_000, 12_000)
    assert (shard.find(absent) == -1).all()
    asked = spark.createDataFrame([(name, held[0], 0), (name, 99_999, 0)], "shard string, key long, copy int")
    found = {r.key: r for r in token_store.look_up(asked, folder).collect()}
    assert found[99_999].ids is None
    assert np.frombuffer(found[held[0]].ids, "<u4").tolist() == library.encode(f"text number {held[0] // 7}", add_special_tokens=False).ids + [2]


def test_repeated_keys_and_empty(spark, library):
    rows = [(4, "same"), (4, "same"), (4, "other text here"), (2, "before"), (None, None), (None, "b")]
    _, _, got = read_back(spark, rows)
    want = expected(rows, library)
    assert sorted((k, n, c) for k, _, n, c in got if k) == sorted((k, n, c) for k, _, n, c in want if k)
    starts = sorted((s, n) for _, s, n, _ in got)
    assert [s for s, _ in starts] == np.cumsum([0, *(n for _, n in starts)])[:-1].tolist()
    df = spark.createDataFrame([], "doc_id long, text string")
    manifest, folder = token_store.write_ids(df, bpe.tokenizer_json(FILE), 2)
    assert token_store.checksums(manifest, folder).count() == 0
