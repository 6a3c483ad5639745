"""Benchmark decontamination: item-sized windows, compared by SimHash and then by their weighted shingles."""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from textmeter.llm.common import keeps_names, settle, store

WORD = re.compile(r"\w+")
WIDTH = 5
SIMILARITY = 0.8
BITS = 64
#: Fingerprints of windows and items may differ in so many bits; see ``test_radius``.
RADIUS = 23
#: Windows whose bit sums are held at a time.
BLOCK = 1 << 12
#: Bytes of benchmark text that one broadcast holds; a larger benchmark is searched in parts.
PART_BYTES = 16 << 20


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words in lower case, and their places in the text."""
    found = list(WORD.finditer(text))
    return [m.group().lower() for m in found], [m.span() for m in found]


def shingles(words: list[str]) -> list[tuple[str, ...]]:
    """Runs of WIDTH words; fewer words are one shingle."""
    return [tuple(words[i:i + WIDTH]) for i in range(len(words) - WIDTH + 1)] or [tuple(words)] * bool(words)


def shingle_bits(shingle: tuple[str, ...]) -> np.ndarray:
    """1 or -1 for each bit of the shingle's hash."""
    digest = xxhash.xxh64_digest(" ".join(shingle).encode("utf-8", "surrogatepass"))
    return np.unpackbits(np.frombuffer(digest, "u1")).astype("i8") * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of bit sums."""
    return np.packbits(sums > 0, axis=1).view(">u8").ravel().astype("u8")


class HammingIndex:
    """Fingerprints within a radius, found through blocks of bits.

    The bits are dealt into radius + 1 blocks: two fingerprints that differ in
    ``radius`` bits or fewer agree in one block at least. Each block has the
    fingerprints sorted by its value.
    """

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, BITS, radius + 2).astype(int)
        self.blocks, self.tables = [], []
        for a, b in zip(edges, edges[1:]):
            shift, mask = np.uint64(a), np.uint64((1 << int(b - a)) - 1)
            values = (prints >> shift) & mask
            order = np.argsort(values, kind="stable")
            self.blocks.append((shift, mask))
            self.tables.append((order, values[order]))

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, fingerprint) positions of all pairs within the radius, each once."""
        found = []
        for (shift, mask), (order, held) in zip(self.blocks, self.tables):
            values = (queries >> shift) & mask
            first = np.searchsorted(held, values, "left")
            n = np.searchsorted(held, values, "right") - first
            query = np.repeat(np.arange(len(queries)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            item = order[place]
            close = np.bitwise_count(queries[query] ^ self.prints[item]) <= self.radius
            found.append(query[close] * len(self.prints) + item[close])
        pair = np.unique(np.concatenate(found))
        return pair // len(self.prints), pair % len(self.prints)


class Benchmark:
    """The items: their shingles, weights and fingerprints, ready to search documents.

    A shingle weighs the number of its characters, as often as it occurs: what a
    window and an item share counts by its length, whatever other items there
    are. Fingerprints and similarities use the same weights, whole numbers.
    """

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS, similarity: float = SIMILARITY):
        self.similarity = similarity
        parsed = [(i, words_of(t)[0]) for i, t in items]
        self.items = [(i, w, Counter(shingles(w))) for i, w in parsed if w]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, words, _ in self.items for w in words}))}
        #: By shingle length: shingles as numbers of their words' numbers, and the sizes of the items that have them.
        self.keys: dict[int, tuple[np.ndarray, list[set[int]]]] = {}
        sizes_of: dict[int, dict[int, set[int]]] = {}
        for _, words, bag in self.items:
            for s in bag:
                key = self._key(self.vocabulary[w] for w in s)
                sizes_of.setdefault(len(s), {}).setdefault(key, set()).add(len(words))
        for n, found in sizes_of.items():
            self.keys[n] = np.array(sorted(found), "u8"), [found[k] for k in sorted(found)]
        self.by_size: dict[int, tuple[list[int], HammingIndex]] = {}
        #: The weight of the lightest item of each size.
        self.lightest: dict[int, int] = {}
        sizes: dict[int, list[int]] = {}
        for at, (_, words, _) in enumerate(self.items):
            sizes.setdefault(len(words), []).append(at)
        for size, at in sizes.items():
            prints = packed(np.stack([self._sums(self.items[i][2].elements()) for i in at]))
            self.by_size[size] = at, HammingIndex(prints, radius)
            self.lightest[size] = min(sum(map(self.weight, self.items[i][2].elements())) for i in at)

    @staticmethod
    def _key(numbers) -> int:
        key = 0
        for n in numbers:
            key = (key * 1_000_003 + int(n) + 1) % 2**64
        return key

    @staticmethod
    def weight(shingle: tuple[str, ...]) -> int:
        return sum(map(len, shingle))

    def _sums(self, bag) -> np.ndarray:
        return sum((self.weight(s) * shingle_bits(s) for s in bag), np.zeros(BITS, "i8"))

    def similar(self, a: Counter, b: Counter) -> float:
        """Weighted Jaccard similarity of two bags of shingles."""
        every = a.keys() | b.keys()
        common = sum(self.weight(s) * min(a[s], b[s]) for s in every)
        return common / sum(self.weight(s) * max(a[s], b[s]) for s in every)

    def anchors(self, words: list[str]) -> dict[int, list[int]]:
        """{size: places where a shingle of an item of that size (or one that hashes like it) begins}."""
        numbers = np.fromiter(map(self.vocabulary.get, words, itertools.repeat(-1)), "i8", len(words))
        out: dict[int, list[int]] = {}
        for n, (keys, sizes) in self.keys.items():
            at = np.arange(max(0, len(numbers) - n + 1))
            # A word that no item has ends the matter early for most places.
            for i in range(n):
                at = at[numbers[at + i] >= 0]
            key = np.zeros(len(at), "u8")
            for i in range(n):
                key = key * np.uint64(1_000_003) + (numbers[at + i] + 1).astype("u8")
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[place] == key
            for begin, k in zip(at[hit].tolist(), place[hit].tolist()):
                for size in sizes[k]:
                    out.setdefault(size, []).append(begin)
        return out

    @staticmethod
    def windows(anchors: list[int], size: int, words: int) -> np.ndarray:
        """First words of all windows of a size that hold an anchor."""
        n, at = min(size, WIDTH), np.array(anchors)
        mark = np.zeros(words + 2, "i8")
        np.add.at(mark, np.maximum(at - (size - n), 0), 1)
        np.add.at(mark, np.minimum(at, words - size) + 1, -1)
        return np.flatnonzero(np.cumsum(mark[:words - size + 1]) > 0)

    def search(self, text: str) -> Iterator[tuple[int, int, int, float, int]]:
        """(item, start, end, similarity, differing bits) of each item's best window, places in characters.

        All windows of an item's size are compared, except those without a
        shingle of any item of that size: their similarity to these items is
        zero. A text of fewer words than the item is its one window, unless it
        weighs too little for the similarity. SimHash proposes, the shingles
        decide. Among equal windows the first one counts.
        """
        anchors = self.anchors(list(map(str.lower, WORD.findall(text))))
        if not anchors:
            return
        words, places = words_of(text)
        bits = functools.cache(lambda s: self.weight(s) * shingle_bits(s))
        whole = sum(map(self.weight, shingles(words)))
        for size in sorted(anchors):
            # What is shared weighs no more than the text, and all together no less than the item.
            if len(words) < size and whole / self.lightest[size] < self.similarity:
                continue
            items, index = self.by_size[size]
            span = min(size, len(words))
            starts = self.windows(anchors[size], span, len(words))
            n = min(size, WIDTH)
            best: dict[int, tuple] = {}
            # Stretches of adjacent windows share their sums; a long one is taken in blocks.
            cuts = np.flatnonzero((np.diff(starts) > 1) | (np.arange(1, len(starts)) % BLOCK == 0)) + 1
            for stretch in np.split(starts, cuts) if len(starts) else ():
                first, last = int(stretch[0]), int(stretch[-1])
                each = [tuple(words[i:i + n]) for i in range(first, last + span - n + 1)]
                total = np.concatenate((np.zeros((1, BITS), "i8"), np.cumsum([bits(s) for s in each], axis=0)))
                held = span - n + 1
                prints = packed(total[held:] - total[:-held])
                for window, at in zip(*index.near(prints)):
                    item = items[at]
                    bag = Counter(each[window:window + held])
                    similarity = self.similar(bag, self.items[item][2])
                    if similarity >= self.similarity:
                        far = int(np.bitwise_count(prints[window] ^ index.prints[at]))
                        rank = (-similarity, first + int(window))
                        best[item] = min(best.get(item, (rank, far)), (rank, far))
            for item, ((similarity, start), far) in best.items():
                yield self.items[item][0], places[start][0], places[start + span - 1][1], -similarity, far


MATCH = "item_id long, start int, end int, similarity double, distance int"


def find_items(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
               item_text: str = "text", radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """(key, item_id, start, end, similarity, distance): each document's best window for each item it holds.

    Words are runs of letters, digits and underscores in lower case; shingles
    have five words (an item with fewer is one shingle). A window has as many
    words as the item; a text with fewer is one window. Its fingerprint may differ from the item's in ``radius``
    bits, which a multi-index finds without exception; then the similarity of
    weighted shingles must reach ``similarity``. Offsets are characters.

    Documents are read in place and never shuffled. The benchmark is a stated
    query set: it is broadcast in parts of at most about ``PART_BYTES``, as many
    as it takes.

    Null or wordless texts hold no item and are in none; items with a null id are
    searched and reported as null. Repeated documents are reported each;
    repeated items with one id count as items of their own. Empty tables give an
    empty table. Other columns are ignored.
    """
    spark = docs.sparkSession
    asked, _ = store(
        benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")).filter(F.col("text").rlike(r"\w")), "items"
    )
    total = asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = -(-total // PART_BYTES)
    read = docs.select(F.col(key), F.col(text).alias("__text")).filter(F.col(text).isNotNull())
    empty = docs.select(key).limit(0).selectExpr("*", *(f"CAST(NULL AS {t}) AS {c}" for c, t in (x.rsplit(" ", 1) for x in MATCH.split(", "))))
    out = empty
    for part in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).collect()
        shipped = spark.sparkContext.broadcast([tuple(r) for r in sorted(rows, key=lambda r: (r.item is None, r.item, r.text))])

        @F.pandas_udf(f"array<struct<{', '.join(f'{c}:{t}' for c, t in (x.rsplit(' ', 1) for x in MATCH.split(', ')))}>>")
        def matches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            held = Benchmark(shipped.value, radius, similarity)
            names = [x.rsplit(" ", 1)[0] for x in MATCH.split(", ")]
            for texts in batches:
                yield pd.Series([[dict(zip(names, m)) for m in held.search(t)] for t in texts])
            settle()

        found = read.withColumn("__match", F.explode(matches("__text"))).select(key, "__match.*")
        out = found if out is empty else out.union(found)
    return out


@keeps_names
def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` without the rows whose text holds an item of the benchmark; all their columns.

    A text decides for itself, so equal keys with different texts are told apart
    by the text's hash. Texts without a match stay, also null ones.
    """
    marked = docs.withColumn("__row", F.struct(F.col(key), F.xxhash64(text)))
    found = find_items(marked, benchmark, "__row", text, **settings).select("__row").distinct()
    found, _ = store(found, "contaminated")
    # The few contaminated rows are hashed; texts are shuffled once and not sorted.
    return marked.join(found.hint("shuffle_hash"), marked["__row"].eqNullSafe(found["__row"]), "left_anti").drop("__row")
