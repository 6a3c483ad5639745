"""Joining many tokens with a word table of unknown size."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: What a task may be sent: bytes of a whole word table.
BROADCAST_BYTES = 32 << 20


def _bytes(field: T.StructField) -> Column:
    value = F.col(field.name)
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        stored = F.octet_length(value)
    elif isinstance(field.dataType, VectorUDT):
        stored = 12 * F.size(F.unwrap_udt(value).getField("values"))
    elif isinstance(field.dataType, T.ArrayType):
        stored = 8 * F.size(value)
    else:
        stored = F.lit(8)
    return F.greatest(F.coalesce(stored, F.lit(0)), F.lit(0)) + 16


def fits_broadcast(words: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the table is small enough, in bytes, to send to every task. One aggregation over the table."""
    sizes = [_bytes(f) for f in words.schema.fields]
    total = sizes[0]
    for s in sizes[1:]:
        total = total + s
    return (words.agg(F.sum(total)).first()[0] or 0) <= limit


def join_words(tokens: DataFrame, words: DataFrame, on: str, small: bool, how: str = "left") -> DataFrame:
    """Join exploded tokens with a table that has one row per word.

    A table found small (``fits_broadcast``) is broadcast, so the many tokens
    stay where they are. Otherwise both sides shuffle by word in a plain join,
    in which adaptive execution splits the partitions of frequent words.
    """
    return tokens.join(F.broadcast(words) if small else words, on, how)
