"""Cross-entropy difference by word bigrams: neither model is ever in one place.

Texts become blocks of word numbers, one file each. A block asks for the totals
of its pairs, then of its words: sorted numbers go to the parts of the number
range, are added there over all blocks, and the sums come back in the order
asked. So a block never moves, and each distinct pair of a block moves once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import parquet
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from textmeter.llm.common import settle, store
from textmeter.llm.token_store import open_store
from textmeter.session import fresh_path, remove, spread

#: Scripts that set no blanks: each of their characters is a word.
UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
#: Elsewhere a word is a run of letters, digits and underscores; every other mark but blanks is one.
WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+|[^\w\s]")
BLANK = re.compile(r"\s")
#: What the first word of a text follows; the other words are known by their XXH64.
START = 0
#: Characters of a text taken at a time, up to the next blank.
SLICE = 1 << 20
#: Words of a block, and words whose numbers a task remembers.
BLOCK, REMEMBERED = 1 << 21, 1 << 19
#: Words of all texts for each part that totals are added in.
PART = 1 << 22


class Numbers(dict):
    """Words' numbers, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = number = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return number


def words(text: str, numbers: Numbers, piece: int = SLICE) -> Iterator[np.ndarray]:
    """Numbers of the text's words, in slices that end at a blank."""
    at = 0
    while at < len(text):
        blank = BLANK.search(text, at + piece)
        end = blank.end() if blank else len(text)
        found = WORD.findall(text[at:end])
        yield np.fromiter(map(numbers.__getitem__, found), "u8", len(found))
        at = end


# --- blocks ------------------------------------------------------------------

def pack(values: np.ndarray) -> bytes:
    """64-bit numbers, compressed with their bytes of equal weight side by side."""
    planes = np.ascontiguousarray(values.astype("<i8").view("u1").reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), "u1")
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").reshape(n)


def _put(folder: str, **columns: np.ndarray) -> int:
    """Write the columns as one file and return its number. It is this attempt's own: a task run twice harms nothing."""
    number = uuid.uuid4().int >> 65
    files, path = open_store(f"{folder}/{number:016x}")
    with files.open_output_stream(path) as f:
        parquet.write_table(pa.table({name: [pack(c)] for name, c in columns.items()}), f, compression="none")
    return number


def _get(folder: str, number: int) -> dict[str, np.ndarray]:
    files, path = open_store(f"{folder}/{number:016x}")
    with files.open_input_file(path) as f:
        return {name: unpack(data) for name, data in parquet.read_table(f).to_pylist()[0].items()}


class Writer:
    """Collects pieces of texts and writes them as a block."""

    def __init__(self, folder: str):
        self.folder = folder
        self._new()

    def _new(self) -> None:
        self.rows: list[int] = []
        self.keys: list = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, row: int, key, before: int, part: np.ndarray) -> None:
        """A piece: the word before it, then its words."""
        self.rows.append(row)
        self.keys.append(key)
        self.parts.append(np.append(np.array([before], "u8"), part))
        self.size += len(part) + 1

    def close(self, schema: pa.Schema) -> pa.RecordBatch:
        """Write, and report each piece. Frequent words have small numbers inside the block."""
        known, group, n = np.unique(np.concatenate(self.parts), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(known), "i8")
        place[order] = np.arange(len(known))
        lengths = np.array([len(p) - 1 for p in self.parts])
        block = _put(self.folder, words=known[order], stream=place[group], lengths=lengths, rows=np.array(self.rows))
        pieces = len(self.rows)
        columns = [self.rows, self.keys, np.full(pieces, block), np.arange(pieces), lengths]
        self._new()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class Block:
    """Reads a block: its words, and its distinct pairs in the order of their numbers."""

    def __init__(self, folder: str, number: int):
        held = _get(folder, number)
        self.words, self.rows, lengths = held["words"].view("u8"), held["rows"], held["lengths"]
        self.pieces = len(lengths)
        inside = np.ones(len(held["stream"]), bool)
        inside[np.cumsum(lengths + 1) - lengths - 1] = False
        at = np.flatnonzero(inside)
        self.before, self.word = held["stream"][at - 1], held["stream"][at]
        #: The piece each word is in.
        self.piece = np.repeat(np.arange(self.pieces), lengths)
        self.pairs, first, self.group, self.n = np.unique(
            mixed(self.words[self.before], self.words[self.word]), return_index=True, return_inverse=True, return_counts=True)
        self.pair_before, self.pair_word = self.before[first], self.word[first]

    def sums(self, of: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Number or weight of each of the block's words, ``of`` telling the word."""
        return np.bincount(of, weights, len(self.words)).astype("i8")


def mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Pairs as 64-bit numbers."""
    prime = np.uint64(0x9E3779B97F4A7C15)
    x = before * prime
    return (x ^ (x >> np.uint64(29)) ^ word) * prime


def write_blocks(docs: DataFrame, folder: str) -> DataFrame:
    """(row, key, block, at, n) of rows (key, text): a piece's row, its block, its place there and its words.

    A text is one piece up to ``SLICE`` characters; a piece without words is
    reported too. Only blocks that the table names count.
    """
    block, piece = BLOCK, SLICE
    files, path = open_store(folder)
    files.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, writer, schema = Numbers(), Writer(folder), None
        for batch in batches:
            schema = schema or pa.schema([("row", pa.int64()), ("key", batch.column(1).type), ("block", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])
            for row, key, text in zip(*batch.columns):
                row, key, before, text = row.as_py(), key.as_py(), START, text.as_py()
                for part in words(text, numbers, piece):
                    if len(part):
                        writer.add(row, key, before, part)
                        before = int(part[-1])
                    if writer.size >= block:
                        yield writer.close(schema)
                if before == START:
                    writer.add(row, key, START, np.zeros(0, "u8"))
        if writer.size:
            yield writer.close(schema)
        settle()

    read = docs.select(F.monotonically_increasing_id().alias("row"), "key", "text")
    numbered = [StructField(c, LongType()) for c in ("row", "block", "at", "n")]
    return read.mapInArrow(run, StructType([numbered[0], read.schema["key"], *numbered[1:]]))


# --- totals over all blocks --------------------------------------------------

#: What a block asks of a part: how often it has which numbers. ``carried`` comes back as it is.
REQUEST = "block long, part int, keys binary, sums binary, carried long"
#: Sums over all blocks in the order asked; then which keys no other row of the part counts; of the part, each once: totals, keys above zero.
ANSWER = "block long, part int, sums binary, carried long, total array<long>, kinds array<long>"


def ask(block: int, keys: np.ndarray, columns: list[np.ndarray], parts: int, carried: int) -> pa.Table:
    """Rows of ``REQUEST``: ascending keys, cut into parts of the number range."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    here, first = np.unique(part, return_index=True)
    spans = list(zip(first, np.append(first[1:], len(keys))))
    return pa.table({
        "block": pa.array([block] * len(here), pa.int64()), "part": pa.array(here.astype("i4")),
        "keys": pa.array([pack(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in spans], pa.binary()),
        "sums": pa.array([pack(np.concatenate([c[a:b] for c in columns])) for a, b in spans], pa.binary()),
        "carried": pa.array([carried] * len(here), pa.int64()),
    })


def answer(asked: pa.Table) -> pa.Table:
    """Rows of ``ANSWER`` for all that is asked of a part."""
    keys = [np.cumsum(unpack(k.as_py()).view("u8"), dtype="u8") for k in asked["keys"]]
    sums = [unpack(s.as_py()).reshape(-1, len(k)) for s, k in zip(asked["sums"], keys)]
    edges = np.cumsum([0, *map(len, keys)])
    known, first, group = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    own = np.zeros(edges[-1], "i8")
    own[first] = 1
    # Whole numbers below 2 ** 53 stay exact.
    added = [np.bincount(group, np.concatenate(c), len(known)).astype("i8") for c in zip(*sums)]
    back = [pack(np.concatenate([*(c[group[a:b]] for c in added), own[a:b]])) for a, b in zip(edges, edges[1:])]
    rest = [None] * (len(back) - 1)
    return pa.table({
        "block": asked["block"], "part": asked["part"], "sums": pa.array(back, pa.binary()), "carried": asked["carried"],
        "total": pa.array([[int(c.sum()) for c in added], *rest], pa.list_(pa.int64())),
        "kinds": pa.array([[int((c > 0).sum()) for c in added], *rest], pa.list_(pa.int64())),
    })


def answered(rows: pa.Table, columns: int) -> list[np.ndarray]:
    """The columns of a block's answers, parts in order; the last tells the keys that this block counts for all."""
    order = np.argsort(rows["part"].to_numpy())
    parts = [unpack(rows["sums"][int(i)].as_py()).reshape(columns + 1, -1) for i in order]
    return list(np.concatenate(parts, axis=1))


def _each(rows: DataFrame, by: str, n: int, make, schema: str) -> DataFrame:
    """``make`` of the rows of each ``by``. The number of tasks is given: the rows' bytes say little about the work."""

    def run(group: pa.Table) -> pa.Table:
        try:
            return make(group)
        finally:
            settle()

    return rows.repartition(max(n, 1), by).groupBy(by).applyInArrow(run, schema)


def _loss(n: np.ndarray, single: np.ndarray, total: np.ndarray, kinds: np.ndarray, words_in_all: int, total_n: int, total_kinds: int) -> np.ndarray:
    """-log p(word | before), Witten-Bell; below the single words stand even chances over the shared vocabulary."""
    k = max(total_kinds, 1)
    p1 = (single + k / max(words_in_all, 1)) / (total_n + k)
    return -np.log(np.where(total > 0, (n + kinds * p1) / np.maximum(total + kinds, 1), p1))


def word_totals(marked: DataFrame, folder: str, blocks: int, parts: int) -> DataFrame:
    """Rows of ``ANSWER`` for the words of each block of rows (block, at, good).

    Columns: the word's number in all and in good texts; what it has beyond
    that as a word before; kinds of words after it, in all and in good texts.
    What is carried names the file with the totals of the block's pairs.
    """

    def of_pairs(rows: pa.Table) -> pa.Table:
        number = rows["block"][0].as_py()
        block, good = Block(folder, number), np.zeros(len(rows), "i8")
        good[rows["at"].to_numpy()] = rows["good"].to_numpy()
        in_good = np.bincount(block.group, good[block.piece], len(block.pairs)).astype("i8")
        marks = _put(folder, good=good)
        return ask(number, block.pairs, [block.n, in_good], parts, marks)

    def of_words(rows: pa.Table) -> pa.Table:
        number = rows["block"][0].as_py()
        block = Block(folder, number)
        good = _get(folder, rows["carried"][0].as_py())["good"][block.piece]
        n, in_good, own = answered(rows, 2)
        word_n, word_good = block.sums(block.word), block.sums(block.word, good)
        columns = [
            word_n, word_good, block.sums(block.before) - word_n, block.sums(block.before, good) - word_good,
            block.sums(block.pair_before, own), block.sums(block.pair_before, own * (in_good > 0)),
        ]
        order = np.argsort(block.words)
        return ask(number, block.words[order], [c[order] for c in columns], parts, _put(folder, n=n, good=in_good))

    pairs = _each(_each(marked, "block", blocks, of_pairs, REQUEST), "part", parts, answer, ANSWER)
    return _each(_each(pairs, "block", blocks, of_words, REQUEST), "part", parts, answer, ANSWER)


def row_losses(totals: DataFrame, folder: str, blocks: int) -> DataFrame:
    """(row, target, background): losses of the words of each row, added up."""
    # Four numbers: the vocabulary both models share, and the sizes of the two.
    vocabulary, total, good, good_kinds = (x or 0 for x in totals.agg(
        F.sum(F.col("kinds")[0]), F.sum(F.col("total")[0]), F.sum(F.col("total")[1]), F.sum(F.col("kinds")[1])).first())

    def losses(rows: pa.Table) -> pa.Table:
        block = Block(folder, rows["block"][0].as_py())
        pair = _get(folder, rows["carried"][0].as_py())
        columns = np.empty((6, len(block.words)), "i8")
        columns[:, np.argsort(block.words)] = answered(rows, 6)[:6]
        word_n, word_good, more_n, more_good, kinds, in_good = columns
        before, word = block.pair_before, block.pair_word
        target = _loss(pair["good"], word_good[word], (word_good + more_good)[before], in_good[before], vocabulary, good, good_kinds)
        background = _loss(pair["n"], word_n[word], (word_n + more_n)[before], kinds[before], vocabulary, total, vocabulary)
        of_piece = [np.bincount(block.piece, x[block.group], block.pieces) for x in (target, background)]
        return pa.table({"row": block.rows, "target": of_piece[0], "background": of_piece[1]})

    found = _each(totals, "block", blocks, losses, "row long, target double, background double")
    return found.groupBy("row").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def cross_entropy_difference(docs: DataFrame, good: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, target_loss, background_loss, score): texts by models of those whose key is in ``good`` and of all.

    Matched models: bigrams of words, Witten-Bell, over one vocabulary, all words
    of all texts. Tokens are words as written: case counts, marks are words of
    their own, and so is each character of scripts without blanks. Nothing is
    cut or sampled; words and pairs are told apart by 64-bit hashes.

    Losses are means per token, in nats; ``score`` is target minus background:
    the lower, the more the text is like the target. A text without words has
    no tokens and null losses. If no text is in ``good``, the target model gives
    every word the same chance. Repeated rows and null keys come back as they
    are; other columns are ignored; an empty table gives an empty table.

    Neither model passes through the driver or lies in one task. A task holds
    one block of texts, or what all blocks ask of one part; both are bounded.
    A block's pairs are counted before they move. What is shuffled and written
    grows with the texts.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "word-blocks")
    keys = good.select(F.col(key).alias("key")).filter("key IS NOT NULL").distinct().withColumn("good", F.lit(1).cast("long"))
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pieces, _ = store(write_blocks(spread(texts, "key"), folder), "pieces")
    size, blocks = pieces.agg(F.sum("n"), F.countDistinct("block")).first()
    parts = max(spark.sparkContext.defaultParallelism, -(-(size or 0) // PART))
    marked = pieces.join(keys.hint("shuffle_hash"), "key", "left").select("block", "at", F.coalesce("good", F.lit(0)).cast("long").alias("good"))
    totals, totals_path = store(word_totals(marked, folder, blocks, parts), "word-totals")
    sums, _ = store(row_losses(totals, folder, blocks), "text-losses")
    remove(spark, folder)
    remove(spark, totals_path)
    rows = pieces.groupBy("row").agg(F.first("key").alias("key"), F.sum("n").alias("n"))
    target, background = F.col("target") / F.col("n"), F.col("background") / F.col("n")
    return rows.join(sums.hint("shuffle_hash"), "row", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_tokens"),
        F.when(F.col("n") > 0, target).alias("target_loss"), F.when(F.col("n") > 0, background).alias("background_loss"),
        F.when(F.col("n") > 0, target - background).alias("score"),
    )
