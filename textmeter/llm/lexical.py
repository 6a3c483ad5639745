"""Ranked lexical search: documents grouped by the terms they share with an item, best groups first."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from textmeter.llm.common import LAST_ID, ranked_id, remove, store

#: Bytes that separate terms become blanks, A-Z become a-z; digits and all bytes of characters beyond ASCII stay.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: The constants of the score: 1000 * tf + MASS * m, where m is 100 - SLOPE for a text without length.
UNIT, MASS, SLOPE = 1_000_000_000, 20, 50
#: Bytes of items that one pass over the documents searches for.
PART_BYTES = 16 << 20
#: (document, term) pairs a task holds at a time.
BLOCK_PAIRS = 1 << 20
#: Documents whose scores are worked out first; twice as many each further time.
FIRST_DOCS = 256
#: Groups that the tasks' results are ranked in before those of an item come together.
SALTS = 256


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def weight(documents: int, holding: int) -> int:
    """Of a term: a thousand times the logarithm of how rare it is."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def pairs(docs: DataFrame, vocabulary: list[bytes], key: str, text: str) -> DataFrame:
    """(id, n, terms, counts) of each document with a term: its length, and which of the vocabulary's terms it holds how often."""
    shipped = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shipped.value.get
        for batch in batches:
            ids, lengths, terms, counts = [], [], [], []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(data.as_py())
                if not words:
                    continue
                held = Counter(map(number, words))
                held.pop(None, None)
                ids.append(i), lengths.append(len(words))
                terms.append(list(held)), counts.append(list(held.values()))
            lists = [pa.array(c, pa.list_(pa.int32())) for c in (terms, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), *lists], ["id", "n", "terms", "counts"])

    given = docs.filter(F.col(text).isNotNull()).select(ranked_id(F.col(key)).alias("id"), F.col(text).cast("binary").alias("text"))
    return given.mapInArrow(read, "id long, n long, terms array<int>, counts array<int>")


class Block:
    """Some documents: for each term the documents that hold it, and what it adds to their scores."""

    def __init__(self, ids: np.ndarray, mass: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        place = np.empty(len(order), "i8")
        place[order] = np.arange(len(order))
        adds = weights[term] * ((UNIT * tf) // (1000 * tf + MASS * mass[doc]))
        doc = place[doc]
        by_term = np.lexsort((doc, term))
        self.docs, self.adds, term = doc[by_term], adds[by_term], term[by_term]
        first = np.flatnonzero(np.concatenate(([True], np.diff(term) != 0))) if len(term) else np.zeros(0, "i8")
        most = np.maximum.reduceat(self.adds, first) if len(first) else np.zeros(0, "i8")
        edges = np.append(first, len(term)).tolist()
        #: term: (first pair, end of pairs, most it adds to a score)
        self.terms = {t: (a, b, m) for t, a, b, m in zip(term[first].tolist(), edges, edges[1:], most.tolist()) if m > 0}

    def masks(self, terms: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """(group of each document, highest possible score of each group), groups by that score, descending.

        A document's mask has a bit for each of the terms it holds; documents of
        one mask are one group. Masks of more than 64 terms are joined word by word.
        """
        code, bound = np.zeros(len(self.ids), "i8"), np.zeros(1, "i8")
        for low in range(0, len(terms), 64):
            mask = np.zeros(len(self.ids), "u8")
            for bit, (a, b, _) in enumerate(terms[low:low + 64]):
                mask[self.docs[a:b]] |= np.uint64(1 << bit)
            values, group = np.unique(mask, return_inverse=True)
            most = np.zeros(len(values), "i8")
            for bit, (_, _, m) in enumerate(terms[low:low + 64]):
                most += ((values >> np.uint64(bit)) & np.uint64(1)).astype("i8") * m
            both, code = np.unique(code * len(values) + group, return_inverse=True)
            bound = bound[both // len(values)] + most[both % len(values)]
        order = np.argsort(-bound, kind="stable")
        rank = np.empty(len(order), "i8")
        rank[order] = np.arange(len(order))
        return rank[code], bound[order]

    def scores(self, terms: list[tuple[int, int, int]], docs: np.ndarray) -> np.ndarray:
        """Exact scores of the documents (ascending)."""
        total = np.zeros(len(docs), "i8")
        for a, b, _ in terms:
            at = np.minimum(np.searchsorted(self.docs[a:b], docs), b - a - 1)
            total += np.where(self.docs[a:b][at] == docs, self.adds[a:b][at], 0)
        return total

    def best(self, item: list[int], k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best of those given and this block's; equal scores by ascending id.

        Groups are taken by their highest possible score. Once k documents score
        more than the next group can, no other document can be among the best.
        """
        terms = [self.terms[t] for t in item if t in self.terms]
        if not terms or (len(scores) == k and sum(m for _, _, m in terms) < scores[-1]):
            return scores, ids
        group, bound = self.masks(terms)
        order = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=len(bound)))
        done, step = 0, FIRST_DOCS
        while done < len(bound) and bound[done] > 0 and not (len(scores) == k and bound[done] < scores[-1]):
            first = ends[done - 1] if done else 0
            until = min(int(np.searchsorted(ends, first + step)) + 1, len(bound))
            docs = np.sort(order[first:ends[until - 1]])
            scores, ids = np.concatenate((scores, self.scores(terms, docs))), np.concatenate((ids, self.ids[docs]))
            top = np.lexsort((ids, -scores))[:k]
            top = top[scores[top] > 0]
            scores, ids, done, step = scores[top], ids[top], until, 2 * step
        return scores, ids


def _blocks(batches: Iterator[pa.RecordBatch], weights: np.ndarray, documents: int, total: int) -> Iterator[Block]:
    """Blocks of documents, each of about ``BLOCK_PAIRS`` pairs; a document is in one block."""
    held, size = [], 0

    def block() -> Block:
        columns = [np.concatenate(c) for c in zip(*held)]
        ids, n, sizes, term, tf = columns
        return Block(ids, 100 - SLOPE + SLOPE * n * documents // total, np.repeat(np.arange(len(ids)), sizes), term, tf.astype("i8"), weights)

    for batch in batches:
        for first in range(0, batch.num_rows, 1024):
            part = batch.slice(first, 1024)
            lists = part.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), sizes, lists.flatten().to_numpy(), part.column(3).flatten().to_numpy()))
            size += int(sizes.sum())
            if size >= BLOCK_PAIRS:
                yield block()
                held, size = [], 0
    if held:
        yield block()


def _best(docs: DataFrame, items: list[list[int]], weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """(number, score, id): of each item's best documents, those that each task found."""
    shipped = docs.sparkSession.sparkContext.broadcast((items, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shipped.value
        found = [(np.zeros(0, "i8"), np.zeros(0, "i8"))] * len(items)
        for block in _blocks(batches, weights, documents, total):
            found = [block.best(item, k, *kept) for item, kept in zip(items, found)]
        sizes = [len(s) for s, _ in found]
        if sum(sizes):
            columns = np.repeat(np.arange(len(items)), sizes), *(np.concatenate(c) for c in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["number", "score", "id"])

    return docs.select("id", "n", "terms", "counts").mapInArrow(search, "number long, score long, id long")


def _ranked(found: DataFrame, k: int, *by: str | Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("number", *by).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def best_documents(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text",
                   item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of the highest score above 0, equal scores by ascending doc_id.

    Terms are runs of ASCII letters and digits and of all characters beyond
    ASCII; only A-Z are lower-cased. A document's score sums, over the item's
    distinct terms, ``weight`` times a part that grows with the occurrences and
    falls with the document's length; counts are over all documents.

    The items are a stated query set: they are searched for in parts of at most
    about ``PART_BYTES``, as many as it takes. Per part the documents are read
    once and written as (length, terms, counts) of the part's terms; statistics
    come from that table, which is then searched in blocks. A task keeps k
    documents per item; the tasks' results are ranked in ``SALTS`` groups per item
    before the item's own, so no group grows with the documents. Nothing is
    shuffled by term or document, so a frequent term is no group either.

    Null or termless texts are no documents and no items: they count nowhere and
    have no rows. Repeated rows are documents (items) of their own; null ids rank
    last and stay null. Empty tables give an empty table. Other columns are
    ignored, and may have any names.
    """
    spark = docs.sparkSession
    given = items.select(F.col(item).cast("long").alias("item"), F.col(item_text).cast("binary").alias("data")).filter(F.col("data").isNotNull())
    asked, _ = store(given, "items")
    size = asked.agg(F.sum(F.octet_length("data") + 16)).first()[0] or 0
    parts, out = -(-size // PART_BYTES), None
    for part in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("data"), F.lit(parts)) == part).collect()
        held = [(r.item, sorted(set(terms_of(bytes(r.data))))) for r in rows]
        vocabulary = sorted({t for _, terms in held for t in terms})
        number = {t: i for i, t in enumerate(vocabulary)}
        written, path = store(pairs(docs, vocabulary, key, text), "pairs")
        documents, total = written.agg(F.count("*"), F.sum("n")).first()
        if not documents or not vocabulary:
            remove(spark, path)
            continue
        # One row per term of this part's items: bounded by PART_BYTES.
        holding = dict(written.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = np.array([weight(documents, holding.get(i, 0)) for i in range(len(vocabulary))], "i8")
        found = _best(written, [[number[t] for t in terms] for _, terms in held], weights, documents, total, k)
        found, _ = store(_ranked(found.withColumn("salt", F.spark_partition_id() % SALTS), k, "salt").select("number", "score", "id"), "found")
        remove(spark, path)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(held)], "number long, item long")
        one = _ranked(found, k).join(names, "number")
        out = one if out is None else out.unionAll(one)
    if out is None:
        out = spark.createDataFrame([], "item long, rank int, id long, score long")
    doc = F.when(F.col("id") != LAST_ID, F.col("id"))
    return out.select(F.col("item").alias("item_id"), "rank", doc.alias("doc_id"), "score")
