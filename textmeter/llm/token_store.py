"""Token ids as binary files with keyed access: raw payloads, and a minimal perfect hash index per shard.

A shard is two files. ``.ids`` holds nothing but token ids, little-endian, two
bytes each if the vocabulary allows, else four. ``.idx`` maps document keys to
places in it:

    8 bytes   magic
    12 int64  id width, documents, keys, levels, tokens, seed, and six spare
    per level int64 bits, then ceil(bits / 64) uint64 words
    int64     per document + 1: where its ids begin, in ids
    int64     per slot: the first document with that key
    uint32    per slot: fingerprint of the key

A key is looked up by hashing it level by level until a set bit is met; the
number of set bits before it is its slot; the fingerprint tells whether the key
is there at all. Keys themselves are not stored.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from textmeter.llm import bpe
from textmeter.llm.common import ranked_id, store
from textmeter.session import fresh_path

MAGIC = b"IDSHARD1"
HEADER = 12
#: A shard is closed once it holds so many ids.
SHARD_TOKENS = 1 << 22
#: Bits of a level per key that is left.
GAMMA = 2


# --- minimal perfect hash ----------------------------------------------------

def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mix of the keys, different for each salt."""
    with np.errstate(over="ignore"):
        x = keys.astype("u8") + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray, seed: int) -> np.ndarray:
    return (mixed(keys, seed - 1) >> np.uint64(32)).astype("u4")


@dataclass
class PerfectHash:
    """Slots 0 to n - 1 for n distinct 64-bit keys; about three bits a key."""

    bits: list[int]
    words: list[np.ndarray]
    seed: int

    @classmethod
    def build(cls, keys: np.ndarray, seed: int = 0) -> "PerfectHash":
        """A level keeps the keys that are alone at their bit; the others go on to the next."""
        bits, words, left, level = [], [], keys.astype("u8"), 0
        while len(left):
            size = max(64, GAMMA * len(left))
            at = mixed(left, seed + 1 + level) % np.uint64(size)
            alone = np.bincount(at.astype("i8"), minlength=size) == 1
            bits.append(size)
            words.append(np.packbits(np.pad(alone, (0, -size % 64)), bitorder="little").view("<u8"))
            left, level = left[~alone[at.astype("i8")]], level + 1
            if level > 200:
                raise ValueError("keys are not distinct")
        return cls(bits, words, seed)

    @functools.cached_property
    def _before(self) -> list[np.ndarray]:
        """Set bits before each word, over all levels."""
        counts = [np.bitwise_count(w).astype("i8") for w in self.words]
        total, out = 0, []
        for c in counts:
            out.append(total + np.cumsum(c) - c)
            total += int(c.sum())
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for some that are not there (others meet a foreign slot)."""
        keys, out = keys.astype("u8"), np.full(len(keys), -1, "i8")
        open_ = np.arange(len(keys))
        for level, (size, words) in enumerate(zip(self.bits, self.words)):
            if not len(open_):
                break
            at = mixed(keys[open_], self.seed + 1 + level) % np.uint64(size)
            word, bit = (at >> np.uint64(6)).astype("i8"), at & np.uint64(63)
            held = words[word]
            hit = (held >> bit) & np.uint64(1) == 1
            below = held[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = self._before[level][word[hit]] + np.bitwise_count(below)
            open_ = open_[~hit]
        return out


# --- files -------------------------------------------------------------------

def open_store(uri: str):
    """(filesystem, path) of a folder named by the cluster: a path, or a uri Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _put(uri: str, data: bytes) -> None:
    files, path = open_store(uri)
    with files.open_output_stream(path) as f:
        f.write(data)


def _get(uri: str) -> bytes:
    files, path = open_store(uri)
    with files.open_input_stream(path) as f:
        return f.read()


def index_bytes(keys: np.ndarray, starts: np.ndarray, width: int) -> bytes:
    """The index of documents in order; copies of a key are adjacent, and the first one is found."""
    distinct, first = np.unique(keys, return_index=True)
    function = PerfectHash.build(distinct)
    slots = function.slots(distinct)
    firsts, prints = np.empty(len(distinct), "<i8"), np.empty(len(distinct), "<u4")
    firsts[slots], prints[slots] = first, fingerprints(distinct, function.seed)
    header = np.zeros(HEADER, "<i8")
    header[:6] = width, len(keys), len(distinct), len(function.bits), starts[-1], function.seed
    levels = b"".join(np.array([b], "<i8").tobytes() + w.astype("<u8").tobytes() for b, w in zip(function.bits, function.words))
    return b"".join((MAGIC, header.tobytes(), levels, starts.astype("<i8").tobytes(), firsts.tobytes(), prints.tobytes()))


class Shard:
    """Reads one shard: ids of a document by its key."""

    def __init__(self, uri: str):
        data = _get(f"{uri}.idx")
        if data[:8] != MAGIC:
            raise ValueError(f"{uri}.idx is not an index of this format")
        at = 8

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.width, self.documents, self.keys, levels, self.tokens, seed = (int(x) for x in take("<i8", HEADER)[:6])
        bits, words = [], []
        for _ in range(levels):
            bits.append(int(take("<i8", 1)[0]))
            words.append(take("<u8", -(-bits[-1] // 64)))
        self.hash = PerfectHash(bits, words, seed)
        self.starts, self.firsts, self.prints = take("<i8", self.documents + 1), take("<i8", self.keys), take("<u4", self.keys)
        self.payload = np.frombuffer(_get(f"{uri}.ids"), f"<u{self.width}")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first document with each key, -1 if there is none."""
        slots = self.hash.slots(keys)
        known = slots >= 0
        known[known] = self.prints[slots[known]] == fingerprints(keys[known], self.hash.seed)
        out = np.full(len(keys), -1, "i8")
        out[known] = self.firsts[slots[known]]
        return out

    def ids(self, document: int) -> np.ndarray:
        return self.payload[self.starts[document]:self.starts[document + 1]]


class _Writer:
    """Collects documents of one shard and writes its two files."""

    def __init__(self, folder: str, task: int, kind: str):
        self.folder, self.task, self.kind, self.count = folder, task, kind, 0
        self._new()

    def _new(self) -> None:
        self.keys: list[int] = []
        self.parts: list[bytes] = []
        self.lengths: list[int] = []
        self.size = 0

    def add(self, key: int, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.parts.append(ids.astype(self.kind).tobytes())
        self.lengths.append(len(ids))
        self.size += len(ids)

    def close(self) -> pa.RecordBatch:
        """Write, and report each document. The name is this attempt's own: a task run twice harms nothing."""
        name = f"{self.task:08d}-{self.count:06d}-{uuid.uuid4().hex}"
        keys, starts = np.array(self.keys, "i8"), np.cumsum([0, *self.lengths])
        _put(f"{self.folder}/{name}.ids", b"".join(self.parts))
        _put(f"{self.folder}/{name}.idx", index_bytes(keys, starts, np.dtype(self.kind).itemsize))
        repeat = np.arange(len(keys)) - np.unique(keys, return_index=True)[1][np.unique(keys, return_inverse=True)[1]]
        n = len(keys)
        report = pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(repeat.astype("i4")), pa.array(np.full(n, self.task, "i4")), pa.array(np.full(n, self.count, "i4")),
             pa.array([name] * n, pa.string()), pa.array(np.array(self.lengths, "i8"))],
            ["key", "copy", "task", "part", "shard", "n"],
        )
        self.count += 1
        self._new()
        return report


# --- tables ------------------------------------------------------------------

def write_ids(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Encode all texts, end each with ``end_id`` and write them in ascending key order.

    Returns the manifest, a written table of one narrow row per document (key,
    copy, task, part, shard), and the folder. Only files the manifest names
    count; what a lost task left behind is never read.

    Texts are shuffled once, by ranges of the key (then of a hash of the text:
    a key with very many rows is spread over tasks too), and encoded where they
    are written. A task holds one shard of ``SHARD_TOKENS`` ids.

    The text of a special token is that token, as the library has it by default.
    A null or empty text has the end id alone. A null key ranks last. Repeated
    keys are adjacent, ordered by their texts' hash, and told apart by ``copy``.
    An empty table gives an empty manifest. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-ids")
    files, path = open_store(folder)
    files.create_dir(path, recursive=True)
    kind = "<u2" if max(len(bpe.token_bytes(tokenizer)) - 1, end_id) < 1 << 16 else "<u4"
    shipped = spark.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer, end = _Writer(folder, TaskContext.get().partitionId(), kind), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for k, data in zip(batch.column(0).to_pylist(), bpe.encode_with_special(shipped.value, texts)):
                writer.add(k, np.frombuffer(data + end, "<u4"))
                if writer.size >= SHARD_TOKENS:
                    yield writer.close()
        if writer.keys:
            yield writer.close()
        bpe.forget(shipped.value)

    rows = docs.select(ranked_id(F.col(key)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = ["key", F.xxhash64("text")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = "key long, copy int, task int, part int, shard string, n long"
    manifest, _ = store(sorted_rows.mapInArrow(run, schema), "manifest")
    return manifest, folder


def shard_starts(manifest: DataFrame) -> DataFrame:
    """(shard, base): ids in all shards before it. One row per shard."""
    sizes = manifest.groupBy("task", "part", "shard").agg(F.sum("n").alias("n"))
    return sizes.select("shard", (F.sum("n").over(W.orderBy("task", "part")) - F.col("n")).alias("base"))


def look_up(keys: DataFrame, folder: str) -> DataFrame:
    """(key, copy, at, n, ids) of (shard, key, copy): found through each shard's index, read from its payload.

    ``at`` is the place in the shard. A key that is not there has null ids.
    """

    def read(rows: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(f"{folder}/{rows['shard'].iat[0]}")
        found = shard.find(rows["key"].to_numpy("i8"))
        document = np.where(found >= 0, found + rows["copy"].to_numpy(), -1)
        at = [int(shard.starts[d]) if d >= 0 else None for d in document]
        ids = [shard.ids(d).astype("<u4").tobytes() if d >= 0 else None for d in document]
        return pd.DataFrame({"shard": rows["shard"], "key": rows["key"], "copy": rows["copy"], "at": pd.array(at, "Int64"), "ids": ids})

    schema = "shard string, key long, copy int, at long, ids binary"
    return keys.select("shard", "key", "copy").groupBy("shard").applyInPandas(read, schema)


def checksums(manifest: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document, read back from the files by key."""

    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(f"{folder}/{rows['shard'].iat[0]}")
        document = shard.find(rows["key"].to_numpy("i8")) + rows["copy"].to_numpy()
        crc = [zlib.crc32(shard.ids(d).astype("<u4").tobytes()) for d in document]
        return pd.DataFrame({
            "shard": rows["shard"], "key": rows["key"], "at": shard.starts[document],
            "n_tokens": shard.starts[document + 1] - shard.starts[document], "ids_crc32": np.array(crc, "i8"),
        })

    schema = "shard string, key long, at long, n_tokens long, ids_crc32 long"
    # As many tasks as shards: a number given by hand is not merged by the manifest's few bytes.
    shards = max(1, manifest.select("shard").distinct().count())
    read = manifest.select("shard", "key", "copy").repartition(shards, "shard").groupBy("shard").applyInPandas(sums, schema)
    null_last = F.when(F.col("key") != 2**63 - 1, F.col("key"))
    return read.join(shard_starts(manifest), "shard").select(
        null_last.alias(key), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
