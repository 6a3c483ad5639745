"""Shards that all have the mixture of the whole: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from textmeter.llm.common import keeps_names, store
from textmeter.session import fresh_path

#: Rows that one window partition sorts, on average.
BUCKET_ROWS = 2_000
#: At most 2^18 buckets a stratum: what is summed up in order stays small, buckets of huge tables are larger.
BUCKET_BITS = 18
#: Bits of the shuffle key: 15 hex digits of an md5.
KEY_BITS = 60
#: Bits of the row's number within its task, in Spark's increasing ids.
ROW_BITS = 33


def shuffle_key(key: Column, seed: int) -> Column:
    """Seeded order of rows: the first 60 bits of md5('seed|key')."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


@keeps_names
def interleave(docs: DataFrame, shards: int, key: str = "doc_id", stratum: str = "source", seed: int = 42) -> DataFrame:
    """Deal rows into ``shards`` shards; adds ``shard`` (from 0) and ``slot`` (gapless from 0 within the shard).

    Rows are put in a seeded order within their stratum; the row of rank r of n
    has the fraction (r - 1/2) / n. All rows are ordered by fraction, and the
    order is cut into shards whose row counts differ by one at most. Each
    stretch of the order then holds every stratum in proportion.

    Ranks are exact without sorting a stratum, or the table, in one task: the
    shuffle key's leading bits cut each stratum into buckets of about
    ``BUCKET_ROWS`` rows, whose counts give the ranks at which they begin. The
    final order is a sort by ranges of the whole key (fraction, stratum, shuffle
    key), so neither a stratum with a third of all rows nor any number of small
    ones, whose rows all have like fractions, comes into one task.

    ``docs`` must be cheap to read again (a written, narrow table). A null
    stratum is one of its own, a null key is ordered like the text 'null'; rows
    equal in key are ordered by their other columns' hash, and rows equal
    throughout are interchangeable. An empty table gives an empty table. Other
    columns pass through; columns named ``shard`` or ``slot`` are replaced.
    """
    total = docs.count()
    bits = min(BUCKET_BITS, (total // BUCKET_ROWS).bit_length())
    rest = [c for c in docs.columns if c != key]
    rows = docs.select(
        F.struct("*").alias("__row"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null")).alias("__stratum"),
        shuffle_key(F.col(key), seed).alias("__order"),
        F.col(key).cast("string").alias("__key"),
        (F.xxhash64(*rest) if rest else F.lit(0)).alias("__tie"),
    ).withColumn("__bucket", F.shiftright("__order", KEY_BITS - bits))

    counts = rows.groupBy("__stratum", "__bucket").agg(F.count("*").alias("__n"))
    by_stratum = W.partitionBy("__stratum")
    begins = counts.select(
        "__stratum", "__bucket",
        (F.sum("__n").over(by_stratum.orderBy("__bucket")) - F.col("__n")).alias("__before"),
        F.sum("__n").over(by_stratum).alias("__size"),
    )
    inside = W.partitionBy("__stratum", "__bucket").orderBy("__order", "__key", "__tie")
    ranked = rows.withColumn("__in", F.row_number().over(inside)).join(begins, ["__stratum", "__bucket"])
    fraction = (F.col("__before") + F.col("__in") - F.lit(0.5)) / F.col("__size")
    ordered, _ = store(
        ranked.withColumn("__fraction", fraction).orderBy("__fraction", "__stratum", "__order", "__key", "__tie")
        # The number of the sort's task, and the row's number in it.
        .select("__row", F.monotonically_increasing_id().alias("__at")),
        "ordered",
    )
    task, row = F.shiftright("__at", ROW_BITS), F.col("__at").bitwiseAND((1 << ROW_BITS) - 1)
    # Proven bound: one row per task of the sort.
    tasks = ordered.groupBy(task.alias("__task")).agg(F.count("*").alias("__n"))
    begins = tasks.select("__task", (F.sum("__n").over(W.orderBy("__task")) - F.col("__n")).alias("__before"))
    placed = ordered.join(F.broadcast(begins), task == F.col("__task")).select(
        "__row.*", (F.col("__before") + row).alias("__position"))
    shard = F.expr(f"(__position * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return (
        placed.withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col("__position") - first).cast("long"))
        .drop("__position")
    )


def write_shards(sharded: DataFrame, path: str | None = None) -> str:
    """Write one folder ``shard=<n>`` per shard, rows in slot order; the folder."""
    path = path or fresh_path(sharded.sparkSession, "shards")
    n = sharded.sparkSession.conf.get("spark.sql.shuffle.partitions")
    sharded.repartitionByRange(int(n), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 42) -> DataFrame:
    """The dealt rows, narrow: id, size and checksum of the text, law, shard, slot.

    Texts are read once and never shuffled. A null text is empty: size 16,
    checksum 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow, _ = store(
        docs.select(
            "doc_id", "source",
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ),
        "sizes",
    )
    dealt = interleave(narrow, shards, seed=seed)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
