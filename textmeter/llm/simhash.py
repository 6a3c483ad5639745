"""Near-duplicates by SimHash: fingerprints, and a binary trie joined with itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from textmeter.llm.common import LAST_ID, connected_components, keeps_names, ranked_id, settle, store
from textmeter.session import remove

BITS = 64
SEED = 42
#: Shingles hashed and counted at once: bounds memory for very long texts.
HASHED_AT_ONCE = 1 << 16
#: Fingerprints that one task's pair of subtrees may hold together.
SUBTREE = 1 << 16
#: Levels of the trie that one Spark round descends.
STEP = 4
#: Node pairs a task expands at once.
EXPANDED_AT_ONCE = 1 << 18


# --- fingerprints ------------------------------------------------------------

def shingle_hashes(text: str, width: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``width`` words, joined by one blank, in blocks.

    A-Z is lowered; words are split at blank and the control characters 9 to 13,
    which is what splitting bytes does. A text with fewer words is one shingle,
    a text without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        yield np.array([digest(b" ".join(words), SEED)], "u8")
        return
    for first in range(0, len(words) - width + 1, HASHED_AT_ONCE):
        part = words[first:first + HASHED_AT_ONCE + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width))))
        yield np.fromiter((digest(s, SEED) for s in shingles), "u8", len(part) - width + 1)


def fingerprint(text: str, width: int) -> int:
    """The 64 bits set in more than half of the shingles' hashes; no words: zero."""
    ones, total = np.zeros(BITS, "i8"), 0
    for hashes in shingle_hashes(text, width):
        # Big-endian bytes: unpacked, bit 63 comes first.
        ones += np.unpackbits(hashes.astype(">u8").view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="i8")
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def fingerprint_column(text: Column, width: int) -> Column:
    """Fingerprint of a text column as a long; a null text counts as one without words."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, width) for t in texts], dtype="int64")
        settle()

    return of(F.coalesce(text, F.lit("")))


def hex_digits(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


# --- the trie's top: Spark rounds --------------------------------------------

def _nodes(prints: DataFrame, depth: int) -> DataFrame:
    """Prefixes of ``depth`` bits with their number of fingerprints."""
    prefix = F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")
    return prints.groupBy(prefix.alias("node")).agg(F.count("*").alias("n"))


def subtree_pairs(prints: DataFrame, distance: int, subtree: int = SUBTREE) -> tuple[DataFrame, list[int]]:
    """Pairs of trie nodes within the error budget, small enough for one task each.

    Starts at (root, root) and descends ``STEP`` levels a round: both nodes are
    replaced with their descendants, the bits in which these differ are added to
    the pair's errors, pairs over the budget go. A pair of at most ``subtree``
    fingerprints stops, so dense regions are cut deeper than sparse ones. The
    first round is made at any size: a small table is spread like a large one.
    Returns (depth, a, b, errors) and the depths that occur.
    """
    open_pairs = prints.sparkSession.sql("SELECT 0L AS a, 0L AS b, 0 AS errors")
    done, depth, depths = None, 0, []
    kids = 1 << STEP
    while depth < BITS:
        depth += STEP
        nodes = _nodes(prints, depth)
        below = open_pairs.withColumn("kid", F.explode(F.sequence(F.lit(0), F.lit(kids * kids - 1)))).select(
            (F.shiftleft("a", STEP) + F.shiftright("kid", STEP)).alias("a"),
            (F.shiftleft("b", STEP) + F.col("kid") % kids).alias("b"),
            (F.col("errors") + F.bit_count(F.shiftright("kid", STEP).bitwiseXOR(F.col("kid") % kids))).cast("int").alias("errors"),
            (F.col("a") == F.col("b")).alias("same"),
        )
        below = below.filter((F.col("errors") <= distance) & (~F.col("same") | F.expr("a <= b"))).drop("same")
        pairs = (
            below.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a")
            .join(nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")
        )
        pairs, _ = store(pairs, "node-pairs")
        small = (F.col("n_a") + F.col("n_b") <= subtree) | F.lit(depth == BITS)
        ready = pairs.filter(small).select(F.lit(depth).alias("depth"), "a", "b", "errors")
        done = ready if done is None else done.union(ready)
        depths.append(depth)
        open_pairs = pairs.filter(~small).select("a", "b", "errors")
        if open_pairs.isEmpty():
            break
    return done, depths


# --- the trie's subtrees: inside a task --------------------------------------

class _Trie:
    """A sorted array of distinct fingerprints, read as a binary trie: a node is a range."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.ones: dict[int, np.ndarray] = {}

    def split(self, depth: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the bit after ``depth`` bits turns to one, in each range."""
        if depth not in self.ones:
            bit = (self.prints >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            self.ones[depth] = np.concatenate(([0], np.cumsum(bit))).astype("i4")
        ones = self.ones[depth]
        return high - (ones[high] - ones[low])


def trie_links(a: np.ndarray, b: np.ndarray, depth: int, errors: int, distance: int, same: bool) -> Iterator[np.ndarray]:
    """Index pairs (i, j) with popcount(a[i] ^ b[j]) <= distance, in blocks.

    ``a`` and ``b`` are sorted, distinct and share their first ``depth`` bits
    each, which differ in ``errors`` places. Node pairs descend together, bit by
    bit; a pair goes as soon as its errors exceed the distance, and is compared
    at once when both nodes hold a single fingerprint. With ``same``, b is a and
    each pair is met once.
    """
    left, right = _Trie(a), _Trie(b)
    root = np.array([[0], [len(a)], [0], [len(b)], [errors]], "i4")
    stack = [(depth, root)]
    while stack:
        level, nodes = stack.pop()
        if nodes.shape[1] > EXPANDED_AT_ONCE:
            half = nodes.shape[1] // 2
            stack += [(level, nodes[:, :half]), (level, nodes[:, half:])]
            continue
        al, ah, bl, bh, e = nodes
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            i, j = al[single], bl[single]
            near = np.bitwise_count(a[i] ^ b[j]) <= distance
            if same:
                near &= i != j
            if near.any():
                yield np.stack((i[near], j[near]))
            al, ah, bl, bh, e = nodes[:, ~single]
        if not len(al):
            continue
        am, bm = left.split(level, al, ah), right.split(level, bl, bh)
        # The mirror image of a node paired with itself is skipped.
        own = (al == bl) & (ah == bh) if same else np.zeros(len(al), bool)
        below = []
        for x, (l1, h1) in enumerate(((al, am), (am, ah))):
            for y, (l2, h2) in enumerate(((bl, bm), (bm, bh))):
                keep = (l1 < h1) & (l2 < h2) & (e + (x != y) <= distance)
                if x > y:
                    keep &= ~own
                below.append(np.stack((l1[keep], h1[keep], l2[keep], h2[keep], e[keep] + np.int32(x != y))))
        stack.append((level + 1, np.concatenate(below, axis=1).astype("i4")))


def _union(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the sets of i and j pairwise; a set's root is its smallest member."""
    def roots(x):
        r = parent[x]
        while True:
            up = parent[r]
            if np.array_equal(up, r):
                return r
            r = up

    while True:
        ri, rj = roots(i), roots(j)
        open_ = ri != rj
        if not open_.any():
            return
        i, j, ri, rj = i[open_], j[open_], ri[open_], rj[open_]
        np.minimum.at(parent, np.maximum(ri, rj), np.minimum(ri, rj))


def subtree_links(rows: pd.DataFrame, distance: int) -> pd.DataFrame:
    """The links between two subtrees (or within one) as a forest: (fp, below)."""
    depth, errors = int(rows["depth"].iat[0]), int(rows["errors"].iat[0])
    values, second = rows["fp"].to_numpy("i8").view("u8"), rows["second"].to_numpy(bool)
    a, b = np.sort(values[~second]), np.sort(values[second])
    same = bool(rows["same"].iat[0])
    if same:
        b, everything, shift = a, a, 0
    else:
        everything, shift = np.concatenate((a, b)), len(a)
    parent = np.arange(len(everything))
    if len(a) and len(b):
        for i, j in trie_links(a, b, depth, errors, distance, same):
            _union(parent, i.astype("i8"), j.astype("i8") + shift)
    while not np.array_equal(parent[parent], parent):
        parent = parent[parent]
    child = parent != np.arange(len(parent))
    return pd.DataFrame({"fp": everything[child].view("i8"), "below": everything[parent[child]].view("i8")})


def hamming_links(prints: DataFrame, distance: int, subtree: int = SUBTREE) -> DataFrame:
    """Links (fp, below) whose components are those of all pairs within ``distance`` bits.

    ``prints`` holds distinct fingerprints in a column ``fp``, written. A
    fingerprint has at most 64 * 65 / 2 others within two bits, so the work is
    linear in the number of distinct fingerprints even in the densest groups;
    each task returns a forest, never all pairs.
    """
    pairs, depths = subtree_pairs(prints, distance, subtree)
    pairs = pairs.select("*", F.struct("depth", "a", "b").alias("pair"))
    at = [F.struct(F.lit(d).alias("depth"), (F.shiftrightunsigned("fp", BITS - d) if d else F.lit(0).cast("long")).alias("node")) for d in depths]
    placed = prints.select("fp", F.explode(F.array(*at)).alias("at")).select("fp", "at.depth", "at.node")
    same = F.col("a") == F.col("b")
    ends = pairs.select(
        "pair", "errors", "depth", same.alias("same"),
        F.explode(F.when(same, F.array(F.struct(F.col("a").alias("node"), F.lit(False).alias("second")))).otherwise(
            F.array(F.struct(F.col("a").alias("node"), F.lit(False).alias("second")),
                    F.struct(F.col("b").alias("node"), F.lit(True).alias("second"))))).alias("end"),
    ).select("pair", "errors", "depth", "same", "end.node", "end.second")
    members = ends.join(placed, ["depth", "node"])
    return members.groupBy("pair").applyInPandas(lambda rows: subtree_links(rows, distance), "fp long, below long")


# --- the operator ------------------------------------------------------------

def _identity(key: str, text: str) -> Column:
    """What names a row: its key, null last, and a hash of its text."""
    return F.struct(
        ranked_id(F.col(key)).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text")
    )


def _classes(docs: DataFrame, width: int, distance: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(row, fp) of each row, and (fp, first) with the first row of the fingerprint's class."""
    spark = docs.sparkSession
    printed, _ = store(
        docs.select(_identity(key, text).alias("row"), fingerprint_column(F.col(text), width).alias("fp")), "fingerprints"
    )
    first, _ = store(printed.groupBy("fp").agg(F.min("row").alias("first")), "distinct-fingerprints")
    links, path = store(hamming_links(first.select("fp"), distance), "links")
    member = connected_components(links, "fp", "below")
    classed, _ = store(
        first.join(member, first["fp"] == member["node"], "left").select(
            "fp", "first", F.coalesce("component", "fp").alias("class")
        ),
        "classes",
    )
    remove(spark, path)
    # Written tables again: large classes and frequent fingerprints can be split where they are joined.
    smallest, _ = store(classed.groupBy("class").agg(F.min("first").alias("first")), "smallest")
    labels, _ = store(classed.select("fp", "class").join(smallest, "class").select("fp", "first"), "labels")
    return printed, labels


def _known(ranked: Column) -> Column:
    return F.when(ranked != LAST_ID, ranked)


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) for each row: SimHash classes of whole texts.

    ``fingerprint`` is 16 hex digits, ``component_id`` the smallest key in the
    class (fingerprints linked, directly or through others, at ``distance`` bits
    or fewer). Copies share a fingerprint, so they are grouped before any
    comparison, however many they are.

    A null or empty text has fingerprint zero and is linked like any other. A
    null key stays null and is never the smallest, unless a class has no other;
    then ``component_id`` is null. Repeated rows come back as often as they are
    there. An empty table gives an empty table. Other columns are ignored.
    """
    printed, classes = _classes(docs, width, distance, key, text)
    return printed.join(classes, "fp").select(
        _known(F.col("row.key")).alias(key),
        hex_digits(F.col("fp")).alias("fingerprint"),
        _known(F.col("first.key")).alias("component_id"),
    )


@keeps_names
def representatives(docs: DataFrame, width: int = 3, distance: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest key (then text hash), null keys last.

    Rows equal in key and text count as repeats of one row: one of them stays.
    """
    printed, classes = _classes(docs, width, distance, key, text)
    kept = classes.select("first").distinct()
    rows = docs.withColumn("__row", _identity(key, text))
    # The narrow side is hashed, so texts are shuffled but not sorted.
    left = rows.join(kept.withColumnRenamed("first", "__row").hint("shuffle_hash"), "__row", "left_semi")
    repeats = printed.groupBy("row").count().filter("count > 1")
    if not repeats.isEmpty():
        left = left.dropDuplicates(["__row"])
    return left.drop("__row")
