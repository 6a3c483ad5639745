"""What several corpus operators share: written tables and connected components."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from textmeter.session import fresh_path, remove

#: Stands for a missing id wherever rows are ranked by id: such rows come last.
LAST_ID = 2**63 - 1


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write the table to the shared folder; the table read from there, and its path."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def keeps_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator for tables whose own columns may begin with ``__``, as its temporary ones do: they pass through."""
    @functools.wraps(operator)
    def run(docs: DataFrame, *given, **settings) -> DataFrame:
        aside = {c: f"own {i} of the table" for i, c in enumerate(docs.columns) if c.startswith("__")}
        if not aside:
            return operator(docs, *given, **settings)
        now = lambda x: aside.get(x, x) if isinstance(x, str) else x
        found = operator(docs.withColumnsRenamed(aside), *map(now, given), **{k: now(v) for k, v in settings.items()})
        return found.withColumnsRenamed({v: k for k, v in aside.items()})
    return run


def ranked_id(key: Column) -> Column:
    """An id that can be ordered and joined: null counts as the last one."""
    return F.coalesce(key.cast("long"), F.lit(LAST_ID))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settle() -> None:
    """At the end of a task: free memory goes back to the machine, as the worker lives on and serves other stages."""
    pa.default_memory_pool().release_unused()
    # Only the C library of Linux keeps freed pages until asked.
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Bytes of texts that are worked on before the results made of them leave the worker.
TEXT_BYTES = 4 << 20


def derive(docs: DataFrame, text: str, fields: StructType, types: list[pa.DataType], make: Callable[[str], tuple]) -> DataFrame:
    """``docs`` without its text column, with the columns ``fields`` that ``make`` returns for each text.

    ``types`` are their Arrow types. A null text counts as empty. Columns named
    like an added one are replaced; the others pass through as they are.
    """
    names = [f.name for f in fields]
    kept = [f for f in docs.schema.fields if f.name not in (text, *names)]
    read = docs.select(*(F.col(f"`{f.name}`") for f in kept), F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(batch, first, rows):
            made = [pa.array(column, t) for column, t in zip(zip(*rows), types)]
            held = [batch.column(i).slice(first, len(rows)) for i in range(len(kept))]
            return pa.RecordBatch.from_arrays(held + made, [f.name for f in kept] + names)

        for batch in batches:
            texts, rows, first, size = batch.column(len(kept)), [], 0, 0
            for at, given in enumerate(texts):
                value = given.as_py()
                rows.append(make(value))
                size += len(value)
                if size >= TEXT_BYTES:
                    yield part(batch, first, rows)
                    rows, first, size = [], at + 1, 0
            if rows:
                yield part(batch, first, rows)

    return read.mapInArrow(run, StructType(kept + list(fields)))


def _state(pairs: DataFrame) -> tuple:
    # Sums of hashes as decimals: no overflow, and independent of the order of rows.
    row = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _lowest(pairs: DataFrame) -> DataFrame:
    """The smallest node each node hangs below. Written before it is joined: only a plain join splits a hub's rows."""
    return pairs.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("low"))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of each node with an edge to another one; component = smallest node reachable.

    Alternates large-star and small-star steps. A pair (u, v), u > v, hangs u
    below v. The large star moves u to the smallest node v hangs below; the
    small star hangs everything u hangs below under the smallest of it. Each
    step is one pre-aggregated minimum per node and one join, which adaptive
    execution splits for hubs; no node's neighbours are gathered. Rounds grow
    with the logarithm of the longest path. Each round is a written table, so
    lineage stays short and a lost executor repeats one round at most.

    Edges with a null end and loops are ignored; repeated edges count once. No
    edges: no rows.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    # greatest and least skip nulls: a null end shows as u = v.
    pairs, path = store(pairs.filter("u != v").distinct(), "edges")
    before = _state(pairs)
    while before[0]:
        lowest, low_path = store(_lowest(pairs), "lowest")
        moved = pairs.join(lowest, F.col("v") == F.col("at"), "left").select("u", F.coalesce("low", "v").alias("v")).distinct()
        moved, moved_path = store(moved, "large-star")
        remove(spark, path)
        remove(spark, low_path)
        lowest, low_path = store(_lowest(moved), "lowest")
        under = moved.join(lowest, F.col("u") == F.col("at"))
        stars = under.select("u", F.col("low").alias("v")).union(
            under.filter("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        )
        pairs, path = store(stars.distinct(), "small-star")
        remove(spark, moved_path)
        remove(spark, low_path)
        after = _state(pairs)
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
