"""Repeated lines or paragraphs: the first occurrence in the corpus stays, the others are cut out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textmeter.llm.common import keeps_names, ranked_id, settle, store

LINE = re.compile(r"[^\n]+")
#: A paragraph ends at an empty line.
PARAGRAPH = re.compile(r"[^\n]+(?:\n[^\n]+)*")
UNITS = {"line": LINE, "paragraph": PARAGRAPH}
WORD = re.compile(r"\w+")
#: What ends a sentence, and stays with it.
SENTENCE = re.compile(r"[^.!?…。！？]*[.!?…。！？]+|[^.!?…。！？]+")
#: Units with fewer words are left alone: they recur in unrelated texts.
MIN_WORDS = 5
UNIT_ROWS = 1 << 16


def digest(words: list[str]) -> bytes:
    """Of the words in lower case: case, punctuation and spacing don't count."""
    return blake2b(" ".join(words).lower().encode("utf-8", "surrogatepass"), digest_size=16).digest()


def units(text: str, unit: str = "line", min_words: int = MIN_WORDS, sentence_words: int | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of each unit of ``min_words`` words or more.

    With ``sentence_words``, a unit's sentences of so many words are units, too,
    unless the sentence has all the words of the unit.
    """
    for m in UNITS[unit].finditer(text):
        whole = m.group()
        words = WORD.findall(whole)
        if len(words) >= min_words:
            yield m.start(), m.end(), digest(words)
        if sentence_words and len(words) > sentence_words:
            for part in SENTENCE.finditer(whole):
                held = WORD.findall(part.group())
                if sentence_words <= len(held) < len(words):
                    yield m.start() + part.start(), m.start() + part.end(), digest(held)


def outermost(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that lie in no other one, ascending; of units only a sentence can lie in another."""
    kept: list[tuple[int, int]] = []
    for start, end in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not kept or end > kept[-1][1]:
            kept.append((start, end))
    return kept


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans (ascending, apart).

    What is a whole line, or several, goes with the line break after it, or the
    one before it at the end.
    """
    joined: list[list[int]] = []
    for start, end in spans:
        if joined and joined[-1][1] == start:
            joined[-1][1] = end
        else:
            joined.append([start, end])
    kept, at, whole = [], 0, False
    for start, end in joined:
        kept.append(text[at:start])
        whole = (start == 0 or text[start - 1] == "\n") and text[end:end + 1] in ("", "\n")
        at = end + 1 if whole and end < len(text) else end
    kept.append(text[at:])
    left = "".join(kept)
    return left.removesuffix("\n") if whole and joined[-1][1] == len(text) else left


def unit_table(rows: DataFrame, unit: str, min_words: int, sentence_words: int | None = None) -> DataFrame:
    """(key, text_hash, start, end, high, low) of each unit of rows (key, text_hash, text)."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes, spans, digests = [], [], [], []
            for key, text_hash, text in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2)):
                for start, end, digest in units(text.as_py(), unit, min_words, sentence_words):
                    keys.append(key), hashes.append(text_hash), spans.append((start, end)), digests.append(digest)
                if len(keys) >= UNIT_ROWS:
                    yield pack(keys, hashes, spans, digests)
                    keys, hashes, spans, digests = [], [], [], []
            yield pack(keys, hashes, spans, digests)
        settle()

    def pack(keys, hashes, spans, digests):
        at = np.array(spans, "i4").reshape(-1, 2)
        parts = np.frombuffer(b"".join(digests), ">i8").astype("i8").reshape(-1, 2)
        columns = [np.array(keys, "i8"), np.array(hashes, "i8"), at[:, 0], at[:, 1], parts[:, 0], parts[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["key", "text_hash", "start", "end", "high", "low"])

    return rows.mapInArrow(explode, "key long, text_hash long, start int, end int, high long, low long")


def repeated_units(rows: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, sentence_words: int | None = None) -> DataFrame:
    """(key, text_hash, spans): in each text, the units that occur earlier in the corpus.

    Occurrences are ranked by key, text hash and offset. A unit's first
    occurrence is a pre-aggregated minimum, so a line that a third of all texts
    hold is no group anywhere; only units that do recur are joined back, and
    that join is one adaptive execution can split.
    """
    found, _ = store(unit_table(rows, unit, min_words, sentence_words), "units")
    rank = F.struct("key", "text_hash", "start")
    # Written, so that the join below is a plain one: a frequent line's rows can be split.
    first, _ = store(
        found.groupBy("high", "low").agg(F.min(rank).alias("first"), F.max(rank).alias("last"))
        .filter("first != last").select("high", "low", "first"),
        "repeated-units",
    )
    later = found.join(first, ["high", "low"]).filter(rank != F.col("first"))
    # A text has few units: the list is bounded by the text itself.
    spans = F.sort_array(F.collect_set(F.struct("start", "end")))
    return later.groupBy("key", "text_hash").agg(spans.alias("spans"))


@keeps_names
def drop_repeated_units(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text",
                        sentence_words: int | None = None) -> DataFrame:
    """``docs`` with each text cut, and ``removed``: array of (start, end), offsets in characters of the original text.

    Units are lines, or paragraphs between empty lines. They are compared whole
    by their words, in lower case; those of fewer than ``min_words`` words stay.
    With ``sentence_words``, sentences of so many words inside a unit are compared
    as well: a passage inside a longer line goes, but for the sentences that it
    shares with the text around it.
    The occurrence in the row with the smallest key stays (then the smallest text
    hash, then the smallest offset), also within one text; all others go. What is
    left of a text, and where it came from, follows from ``removed``.

    A null text stays null and an empty one empty, with nothing removed. Null
    keys rank last. Rows equal in key and text are one occurrence and come back
    alike, as often as they are there. A column ``removed`` is replaced; other
    columns pass through. An empty table gives an empty table.
    """
    rows = docs.withColumn("__key", ranked_id(F.col(key))).withColumn("__hash", F.xxhash64(F.coalesce(text, F.lit(""))))
    given = rows.filter(F.col(text) != "").select("__key", "__hash", text)
    spans = repeated_units(given, unit, min_words, sentence_words).select(
        F.col("key").alias("__key"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans")
    )

    @F.pandas_udf("left string, removed array<struct<start:int,end:int>>")
    def without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            removed = [outermost([(x["start"], x["end"]) for x in s]) if s is not None else [] for s in spans]
            left = [cut(t, r) if r else t for t, r in zip(texts, removed)]
            yield pd.DataFrame({"left": left, "removed": [[{"start": a, "end": b} for a, b in r] for r in removed]})
        settle()

    # The narrow side is hashed, so texts are shuffled once and not sorted.
    joined = rows.join(spans.hint("shuffle_hash"), ["__key", "__hash"], "left").drop("__key", "__hash")
    joined = joined.withColumn("__cut", without(F.col(text), F.col("__spans"))).drop("__spans")
    return joined.withColumn(text, F.col("__cut.left")).withColumn("removed", F.col("__cut.removed")).drop("__cut")


def kept_spans(length: int, removed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the original text that were not removed."""
    edges = [0, *(x for span in removed for x in span), length]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2]) if a < b]
