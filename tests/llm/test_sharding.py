"""Interleaved shards: sizes, slots, mixture, and the plain order they follow."""

import hashlib
import zlib
from collections import Counter

from textmeter.llm import sharding


def plain(rows, shards, seed=42):
    """(doc_id -> (shard, slot)) by sorting everything in one place."""
    def order(r):
        return int(hashlib.md5(f"{seed}|{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:15], 16), str(r[0])
    by = {}
    for r in rows:
        by.setdefault("null" if r[2] is None else "=" + r[2], []).append(r)
    ranked = []
    for s, group in by.items():
        for i, r in enumerate(sorted(group, key=order)):
            ranked.append(((i + 1 - 0.5) / len(group), s, order(r), r))
    ranked.sort(key=lambda x: x[:3])
    n, out, slots = len(rows), {}, Counter()
    for p, (*_, r) in enumerate(ranked):
        shard = p * shards // n
        out[r[0]] = (shard, slots[shard])
        slots[shard] += 1
    return out


def sample(n):
    return [(i, None if i % 17 == 0 else "té" * (i % 9), "hot" if i % 3 else (None if i % 5 == 0 else f"s{i % 7}")) for i in range(n)]


def test_follows_the_plain_order(spark, monkeypatch):
    for bucket in (50_000, 16):
        monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
        rows = sample(333)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = {r.doc_id: r for r in sharding.shard_rows(df, 40).collect()}
        assert {k: (r.shard, r.slot) for k, r in got.items()} == plain(rows, 40)
        for k, text, _ in rows:
            data = (text or "").encode()
            assert (got[k].size, got[k].text_crc32, got[k].law, got[k].grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)


def test_many_sources_of_one_row(spark):
    # All fractions are 0.5.
    rows = [(i, "t", f"s{i:04d}") for i in range(3000)]
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), 7).collect()
    want = plain(rows, 7)
    assert {r.doc_id: (r.shard, r.slot) for r in got} == want


def test_every_shard_has_the_mixture(spark):
    rows = sample(2000)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.interleave(df.select("doc_id", "source"), 10).collect()
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(10)) and max(counts.values()) - min(counts.values()) <= 1
    total = Counter(r.source for r in got)
    for (shard, source), n in Counter((r.shard, r.source) for r in got).items():
        # Rounding moves a cut by less than one row for each stratum.
        assert abs(n - total[source] / 10) < len(total)


def test_fewer_rows_than_shards_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, shard string").withColumnRenamed("shard", "source")
    got = sharding.interleave(df, 5).collect()
    assert len(got) == 3 and all(r.slot == 0 for r in got) and len({r.shard for r in got}) == 3
    assert sharding.interleave(df.limit(0), 5).count() == 0


def test_written_shards_read_back_in_slot_order(spark):
    df = spark.createDataFrame(sample(100), "doc_id long, text string, source string")
    dealt = sharding.interleave(df, 4)
    path = sharding.write_shards(dealt)
    back = spark.read.parquet(path)
    assert sorted((r.doc_id, r.shard, r.slot) for r in back.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in dealt.collect())
