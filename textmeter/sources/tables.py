"""Reading and writing review tables."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from textmeter.operators.quality import realism_gate
from textmeter.operators.splits import seeded_shuffle
from textmeter.session import fresh_path
from textmeter.sources import versions

REVIEWS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("review", T.StringType()),
    T.StructField("sentiment", T.IntegerType()),
])

# CSV settings under which any text comes back as it was
# written, with empty and null kept apart.
CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "nullValue": "\\N",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_csv(df: DataFrame, path: str) -> str:
    """Write all columns with a header and no index; texts may hold quotes and line breaks."""
    df.write.mode("overwrite").options(**CSV_OPTIONS, quoteAll=True, lineSep="\n").csv(path)
    return path


def _header(spark: SparkSession, path: str) -> list[str] | None:
    """Column names in the file's first line; None if there is no readable file."""
    try:
        first = spark.read.text(path).first()
    except (AnalysisException, SparkRuntimeException, Py4JJavaError):
        return None
    return next(csv.reader([first.value])) if first else None


def read_csv(spark: SparkSession, path: str, schema: T.StructType = REVIEWS) -> DataFrame | None:
    """The table at ``path`` with the columns of ``schema``, or None when no readable file is there.

    Columns are found by their names in the header, in any order; a header with
    other names is an error, and so is, when it is read, a row that does not fit.
    Where only ``id`` is missing, rows are numbered: unique, not consecutive.

    A file of any size is read by many tasks, also where texts hold line breaks
    (``csv_records``). A file with an odd number of quotes, where quotes do not
    only enclose fields, is read by one task as before.
    """
    names = _header(spark, path)
    if names is None:
        return None
    missing = [f.name for f in schema.fields if f.name not in names]
    if missing not in ([], ["id"]):
        raise ValueError(f"{path}: missing columns: {', '.join(missing)}")
    stored = T.StructType([schema[n] if n in schema.names else T.StructField(n, T.StringType()) for n in names])
    records = csv_records(spark, path)
    if records is None:
        rows = spark.read.schema(stored).options(**CSV_OPTIONS, multiLine=True, mode="FAILFAST").csv(path)
    else:
        options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in CSV_OPTIONS.items() if k != "header"}
        columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in stored.fields)
        rows = records.select(F.from_csv("record", columns, {**options, "mode": "FAILFAST"}).alias("row")).select("row.*")
    if missing:
        rows = rows.withColumn("id", F.monotonically_increasing_id())
    return rows.select(*schema.names)


#: Of a byte range's records: complete, continued from before, or going on behind it.
WHOLE, HEAD, TAIL = 0, 1, 2


def csv_records(spark: SparkSession, path: str) -> DataFrame | None:
    """(record) of each record but the header of each file; None where quotes are odd in number.

    Files are read as lines, in byte ranges as Spark splits them. Quotes are
    counted per range; the parity of those before it says whether a range begins
    inside a quoted field. Each range then cuts its lines at the record ends
    outside of quotes. The ends left over, two a range at most, are put together
    in order. Empty records are skipped, as is a carriage return at an end.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.input_file_name().alias("file"), F.input_file_block_start().alias("first"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "first").agg(F.sum(quotes).alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("first")) - F.col("n")
    ranges = counted.select("file", "first", (before % 2 == 1).alias("inside"), "n")
    ranges_path = fresh_path(spark, "ranges")
    ranges.write.parquet(ranges_path)
    ranges = spark.read.schema(ranges.schema).parquet(ranges_path)
    odd = ranges.groupBy("file").agg((F.sum("n") % 2).alias("odd")).filter("odd = 1").limit(1).count()
    if odd:
        return None
    # One row per byte range of a file; the lines stay in their order.
    placed = lines.join(F.broadcast(ranges.drop("n")), ["file", "first"])
    fragments_path = fresh_path(spark, "fragments")
    cut = placed.select("value", "file", "first", "inside").mapInArrow(_cut_records, "kind int, file string, first long, record string")
    cut.write.partitionBy("kind").parquet(fragments_path)
    parts = spark.read.schema("file string, first long, record string, kind int").parquet(fragments_path)
    # A record that reaches over ranges: its beginning, and all that continues it.
    order = W.partitionBy("file").orderBy("first", "kind")
    ends = parts.filter(F.col("kind") != WHOLE).withColumn("number", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    pieces = F.array_sort(F.collect_list(F.struct("first", "kind", "record")))
    joined = ends.groupBy("file", "number").agg(F.array_join(pieces["record"], "\n").alias("record"))
    records = parts.filter(F.col("kind") == WHOLE).select("record").unionAll(joined.select("record"))
    return records.select(F.regexp_replace("record", "\r$", "").alias("record")).filter("record <> ''")


def _cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, file, first, record) of the lines (value, file, first, inside) of whole byte ranges, in order."""
    out: list[tuple] = []
    at, held, kind, inside = None, [], WHOLE, False

    def end(last: int) -> None:
        # The header is the record that begins a file.
        if held and not (kind == WHOLE and at[1] == 0 and held[0][0]):
            out.append((last, *at, "\n".join(v for _, v in held)))

    for batch in batches:
        values, files, firsts, starts = (batch.column(i).to_pylist() for i in range(4))
        for value, file, first, start in zip(values, files, firsts, starts):
            new = (file, first) != at
            if new:
                if at is not None:
                    end(kind if kind == HEAD else TAIL if inside else WHOLE)
                at, held, inside = (file, first), [], start
                kind = HEAD if start else WHOLE
            elif not inside:
                end(kind)
                held, kind = [], WHOLE
            held.append((new and not start, value))
            inside ^= value.count('"') % 2 == 1
        if out:
            yield _record_batch(out)
            out.clear()
    if at is not None:
        end(kind if kind == HEAD else TAIL if inside else WHOLE)
    if out:
        yield _record_batch(out)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["kind", "file", "first", "record"])


def union_splits(*parts: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Stored partitions as one table of ``review`` and integer ``sentiment``."""
    renamed = [
        p.select("id", F.col(text).alias("review"), F.col(label).cast("int").alias("sentiment")) for p in parts
    ]
    whole = renamed[0]
    for part in renamed[1:]:
        whole = whole.unionByName(part)
    return whole


def load_reviews(spark: SparkSession, path: str, *parts: DataFrame, **gates) -> DataFrame:
    """The stored review table if it passes the realism gate, else the shuffled union of ``parts``, stored.

    ``gates`` are the gate's limits. Without ``parts``, a table that is not
    there or does not pass is an error.
    """
    stored = read_csv(spark, path)
    if stored is not None:
        verdict = realism_gate(stored, **gates).first()
        if verdict.passed:
            return stored
    if not parts:
        raise ValueError(f"{path}: " + ("no table" if stored is None else f"the realism gate fails at {verdict.reason}"))
    shuffled = seeded_shuffle(union_splits(*parts)).select(F.col("position").alias("id"), "review", "sentiment")
    write_csv(shuffled, path)
    return read_csv(spark, path)


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row (n_rows, fingerprint) that changes with the rows' content, not with their order.

    Hashes are summed, so repeated rows count too. All columns, unless named.
    """
    columns = sorted(columns or df.columns)
    # A null moves the hash of what follows: names and null flags go in.
    row = F.xxhash64(*[F.lit(c) for c in columns], *[F.col(c).isNull() for c in columns], *columns)
    return df.agg(F.count("*").alias("n_rows"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def _settings_key(settings: dict) -> str:
    """Settings as text; a table stands for its content."""
    shown = {k: tuple(fingerprint(v).first()) if isinstance(v, DataFrame) else v for k, v in settings.items()}
    return repr(sorted(shown.items(), key=lambda kv: kv[0]))


def cleaned_cache(df: DataFrame, path: str, clean, **settings) -> DataFrame:
    """The stored table of ``clean(df, **settings)``, made if it is not there yet.

    The folder under ``path`` is named by the content of every column of ``df``
    and by the cleaning function and its settings, so a table made from other
    labels or by other rules is another one. What is stored is compared again
    before it is used. A table counts once it is committed (``versions``): a run
    that fails half-way leaves none behind, and two writers do not meet.
    """
    spark = df.sparkSession
    now = fingerprint(df).first()
    rules = f"{getattr(clean, '__module__', '')}.{getattr(clean, '__qualname__', repr(clean))} {_settings_key(settings)}"
    folder = f"{path}/{sha256(f'{tuple(now)} {sorted(df.dtypes)} {rules}'.encode()).hexdigest()[:32]}"
    _, whole = versions.current(spark, folder)
    if whole is not None:
        stored = spark.read.parquet(whole)
        if {"cleaned_review", *df.columns} <= {*stored.columns} and fingerprint(stored, df.columns).first() == now:
            return stored
    return spark.read.parquet(versions.commit(spark, folder, lambda _, new: clean(df, **settings).write.parquet(new)))


def upsert_result(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """Results with the rows of the new row's model replaced."""
    if existing is None:
        return new
    kept = existing.join(new.select("Model").distinct(), "Model", "left_anti")
    return kept.select(*existing.columns).unionByName(new)


def store_results(path: str, new: DataFrame) -> DataFrame:
    """Upsert into the results stored under ``path``, as a new version of them; all results, read back.

    Writers at once do not lose each other's rows: the later one is added to
    what the earlier one committed.
    """
    spark = new.sparkSession

    def write(before: str | None, folder: str) -> None:
        write_csv(upsert_result(before and read_csv(spark, before, new.schema), new), folder)

    return read_csv(spark, versions.commit(spark, path, write), new.schema)
