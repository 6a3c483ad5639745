"""Seeded row order, exact ranks and exact prefixes without a global sort.

Rows are ordered by ``(md5(id|seed), id)``. Because md5 spreads ids evenly, its
first hex digits cut the order into buckets of equal expected size, whatever
the class sizes are. The number of rows per class and bucket, at most
``2 * BUCKETS`` small rows however large the table, tells where any rank lies:

* ``ranks`` sorts inside small buckets and adds each bucket's offset, instead
  of sorting a whole class (or table) in one task;
* ``first_rows`` sorts only the one bucket per class that holds the cut. It
  looks up that one key per class when called; flagging rows is then a
  comparison with a constant, a projection however often it is reused.

``id`` must be unique. Labels are binary. Rows without an id, or without a label
of 0 or 1 where one counts, have no rank, belong to no prefix and no remainder.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from textmeter import resources as R

HEX_DIGITS = 4
BUCKETS = 16 ** HEX_DIGITS
CLASSES = (0, 1)


def hash_key(id_col: Column, seed: int = R.SEED) -> Column:
    return F.md5(F.concat(id_col.cast("string"), F.lit(f"|{seed}")).cast("binary"))


def _stratum(label: str | None) -> Column:
    return F.lit(0) if label is None else F.col(label).cast("int")


def rankable(id_col: str, label: str | None) -> Column:
    """Whether a row has an id and, if one is asked for, a label 0 or 1. Other rows have no rank and no side."""
    known = F.col(id_col).isNotNull()
    return known if label is None else known & F.coalesce(F.col(label).isin(*CLASSES), F.lit(False))


def _keyed(df: DataFrame, id_col: str, label: str | None, seed: int) -> DataFrame:
    """Narrow view of the rows that can be ranked: class, key, id and bucket of each."""
    df = df.filter(rankable(id_col, label))
    key = hash_key(F.col(id_col), seed)
    return df.select(
        _stratum(label).alias("_class"),
        key.alias("_key"),
        F.col(id_col).alias("_id"),
        F.conv(F.substring(key, 1, HEX_DIGITS), 16, 10).cast("int").alias("_bucket"),
    )


def _per_bucket(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("_class", "_bucket").agg(F.count("*").alias("_n"))


def ranks(df: DataFrame, out: str, id_col: str = "id", label: str | None = None, seed: int = R.SEED) -> DataFrame:
    """Add the 1-based rank of each row in hash order, per class if ``label`` is given.

    Rows that cannot be ranked (see ``rankable``) keep a null rank.
    """
    earlier = W.partitionBy("_class").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = _per_bucket(_keyed(df, id_col, label, seed))
    # Proven bound: one row per class and bucket.
    offsets = F.broadcast(
        counts.select("_class", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    known = rankable(id_col, label)
    bucket = F.conv(F.substring("_key", 1, HEX_DIGITS), 16, 10).cast("int")
    # Rows without a rank stay spread: they are no group.
    bucketed = df.withColumn("_key", hash_key(F.col(id_col), seed)).withColumn(
        "_class", F.when(known, _stratum(label)).otherwise(-1)
    ).withColumn("_bucket", F.coalesce(bucket, F.spark_partition_id()))
    inside = W.partitionBy("_class", "_bucket").orderBy("_key", id_col)
    return (
        bucketed.withColumn("_in", F.row_number().over(inside))
        .join(offsets, ["_class", "_bucket"], "left")
        .withColumn(out, (F.col("_in") + F.col("_before")).cast("bigint"))
        .drop("_class", "_bucket", "_key", "_in", "_before")
    )


class HashOrder:
    """The hash order of one table: its class sizes, and prefixes of it.

    Building it counts rows per class and bucket, reading id and label only.
    """

    def __init__(self, df: DataFrame, id_col: str = "id", label: str | None = None, seed: int = R.SEED):
        self.df, self.id_col, self.label, self.seed = df, id_col, label, seed
        self._rows = _keyed(df, id_col, label, seed)
        # Proven bound: 2 * BUCKETS rows of three integers.
        self._buckets = sorted(tuple(r) for r in _per_bucket(self._rows).collect())

    def size(self, stratum: int = 0) -> int:
        return sum(n for c, _, n in self._buckets if c == stratum)

    @property
    def total(self) -> int:
        return sum(n for _, _, n in self._buckets)

    def _edges(self, quotas: Mapping[int, int]) -> list[tuple[int, int, int]]:
        """(class, bucket, place inside the bucket) of the last row of each prefix."""
        edges, seen = [], dict.fromkeys(quotas, 0)
        wanted = {c: min(k, self.size(c)) for c, k in quotas.items()}
        for c, bucket, n in self._buckets:
            if c in wanted and seen[c] < wanted[c] <= seen[c] + n:
                edges.append((c, bucket, wanted[c] - seen[c]))
            if c in seen:
                seen[c] += n
        return edges

    def first_rows(self, quotas: Mapping[int, int], flag: str) -> DataFrame:
        """Flag the first ``quotas[c]`` rows of each class ``c`` (class 0 without a label); null for rows without a rank."""
        edges = self._edges(quotas)
        chosen = F.lit(False)
        if edges:
            here = [(F.col("_class") == c) & (F.col("_bucket") == b) for c, b, _ in edges]
            place = [at & (F.col("_in") == k) for at, (_, _, k) in zip(here, edges)]
            inside = W.partitionBy("_class", "_bucket").orderBy("_key", "_id")
            held = self._rows.filter(_any(here)).withColumn("_in", F.row_number().over(inside))
            # Proven bound: one row per class.
            for cut in held.filter(_any(place)).select("_class", "_key", "_id").collect():
                chosen = chosen | self._upto(cut)
        return self.df.withColumn(flag, F.when(rankable(self.id_col, self.label), chosen))

    def _upto(self, cut) -> Column:
        here = F.struct(hash_key(F.col(self.id_col), self.seed).alias("_key"), F.col(self.id_col).alias("_id"))
        reached = here <= F.struct(F.lit(cut["_key"]).alias("_key"), F.lit(cut["_id"]).alias("_id"))
        return reached if self.label is None else (F.col(self.label) == cut["_class"]) & reached


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
