"""Exact, seeded splits and samples.

Sizes are exact (``randomSplit`` and ``sampleBy`` are not) and rows are chosen
by hash order, so every engine and every run picks the same ones. Except for
folds and resampling, which need each row's rank, a split never moves rows: it
compares each row's key with one cut per class.

One rule for rows without an id, or without a label of 0 or 1 where the label
counts: they are on no side. Splits and folds leave them in the table with a
null ``split``, ``fold`` or ``position``; samples leave them out.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from textmeter import resources as R
from textmeter.operators.hash_order import CLASSES, HashOrder, rankable, ranks


def proportional_quotas(sizes: dict[int, int], total: int) -> dict[int, int]:
    """``total`` rows shared out in proportion to the class sizes, by largest remainder (low class first)."""
    n = sum(sizes.values())
    if n == 0:
        return dict.fromkeys(sizes, 0)
    quotas = {c: size * total // n for c, size in sizes.items()}
    by_remainder = sorted(sizes, key=lambda c: (-(sizes[c] * total % n), c))
    for c in by_remainder[: total - sum(quotas.values())]:
        quotas[c] += 1
    return quotas


def _class_sizes(order: HashOrder) -> dict[int, int]:
    return {c: order.size(c) for c in CLASSES}


def _sides(flagged: DataFrame, first: str, rest: str) -> DataFrame:
    """``split`` from the flag ``_first``; null stays null."""
    side = F.when(F.col("_first"), first).when(~F.col("_first"), rest)
    return flagged.withColumn("split", side).drop("_first")


def _split(df, held_out, side, rest, id_col, label, seed):
    """Rows outside a stratified prefix of n - held_out(n) rows are the held-out side."""
    order = HashOrder(df, id_col, label, seed)
    quotas = proportional_quotas(_class_sizes(order), order.total - held_out(order.total))
    flagged = order.first_rows(quotas, "_first")
    return _sides(flagged, rest, side)


def stratified_split(df: DataFrame, share: float = R.TEST_SHARE, label: str = "sentiment",
                     id_col: str = "id", seed: int = R.SEED) -> DataFrame:
    """Add ``split`` = train/test with exact class proportions; test holds ceil(share * n) rows."""
    return _split(df, lambda n: math.ceil(share * n), "test", "train", id_col, label, seed)


def split_balance(df: DataFrame, label: str = "sentiment") -> DataFrame:
    """Positive and negative rows per split."""
    return df.groupBy("split").agg(
        F.count_if(F.col(label) == 1).cast("bigint").alias("pos"),
        F.count_if(F.col(label) == 0).cast("bigint").alias("neg"),
    )


def balanced_sample(df: DataFrame, n: int | None, label: str = "sentiment",
                    id_col: str = "id", seed: int = R.SEED) -> DataFrame:
    """n // 2 positives (or all of them), negatives for the rest; every labelled row if n covers them or is None."""
    if n is None:
        return df.filter(rankable(id_col, label))
    order = HashOrder(df, id_col, label, seed)
    if n >= order.total:
        return df.filter(rankable(id_col, label))
    positives = min(n // 2, order.size(1))
    quotas = {1: positives, 0: n - positives}
    return order.first_rows(quotas, "_in").filter("_in").drop("_in")


def proportional_sample(df: DataFrame, n: int | None, label: str = "sentiment",
                        id_col: str = "id", seed: int = R.SEED) -> DataFrame:
    """n rows in class proportion: the held-out side of a split of absolute size; every labelled row if n is None."""
    if n is None:
        return df.filter(rankable(id_col, label))
    split = _split(df, lambda total: min(n, total), "test", "train", id_col, label, seed)
    return split.filter("split = 'test'").drop("split")


def _validation_size(n: int, share: float, floor: int) -> int:
    return min(max(floor, int(n * share)), n)


def tail_validation_split(df: DataFrame, share: float = 0.1, floor: int = 50,
                          id_col: str = "id", seed: int = R.SEED + 1) -> DataFrame:
    """Add ``split`` = train/val; val is the last max(floor, share * n) rows of the shuffled order.

    The order must not be the one a sample was drawn by: in that one a class
    that was thinned out more ends earlier. Hence another seed than there.
    """
    order = HashOrder(df, id_col, None, seed)
    kept = order.total - _validation_size(order.total, share, floor)
    flagged = order.first_rows({0: kept}, "_first")
    return _sides(flagged, "train", "val")


def stratified_validation_split(df: DataFrame, share: float = 0.1, floor: int = 50, label: str = "sentiment",
                                id_col: str = "id", seed: int = R.SEED) -> DataFrame:
    """Add ``split`` = train/val; val holds max(floor, share * n) rows in class proportion."""
    return _split(df, lambda n: _validation_size(n, share, floor), "val", "train", id_col, label, seed)


def uniform_sample(df: DataFrame, n: int, id_col: str = "id", seed: int = R.SEED) -> DataFrame:
    """Exactly min(n, rows) rows, each equally likely."""
    order = HashOrder(df, id_col, None, seed)
    return order.first_rows({0: n}, "_in").filter("_in").drop("_in")


def seeded_shuffle(df: DataFrame, id_col: str = "id", seed: int = R.SEED) -> DataFrame:
    """Add ``position``, each row's place in the shuffled order."""
    return ranks(df, "position", id_col, None, seed)


def stratified_kfold(df: DataFrame, folds: int = 5, label: str = "sentiment",
                     id_col: str = "id", seed: int = R.SEED) -> DataFrame:
    """Add ``fold`` 0..folds-1, dealt round-robin inside each class: sizes differ by at most one."""
    ranked = ranks(df, "_rank", id_col, label, seed)
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")


def bootstrap_resample(df: DataFrame, n: int = 10_000, replace: bool = True, label: str = "sentiment",
                       id_col: str = "id", seed: int = R.SEED) -> DataFrame:
    """n rows in class proportion, drawn from the labelled rows.

    With replacement, draw ``i`` of a class takes the row whose rank is
    ``hash(class, i, seed) mod class size``; ``draw`` numbers the draws. Without,
    at most every row is drawn, once, as ``draw`` 1.
    """
    order = HashOrder(df, id_col, label, seed)
    sizes = _class_sizes(order)
    if not replace:
        quotas = proportional_quotas(sizes, min(n, order.total))
        return order.first_rows(quotas, "_in").filter("_in").drop("_in").withColumn("draw", F.lit(1).cast("bigint"))
    quotas = proportional_quotas(sizes, n)
    # Draws are a range: made where they are needed, however many they are.
    of_one = F.col("id") < quotas[0]
    draws = df.sparkSession.range(sum(quotas.values())).select(
        F.when(of_one, 0).otherwise(1).alias("_class"),
        F.when(of_one, F.col("id")).otherwise(F.col("id") - quotas[0]).alias("draw"),
        F.when(of_one, F.lit(sizes[0])).otherwise(F.lit(sizes[1])).cast("bigint").alias("size"),
    ).withColumn("draw", F.col("draw") + 1)
    tag = F.concat_ws("|", F.col("_class").cast("string"), F.col("draw").cast("string"), F.lit(str(seed)))
    number = F.conv(F.substring(F.md5(tag.cast("binary")), 1, 15), 16, 10).cast("bigint")
    draws = draws.select("_class", "draw", (number % F.col("size") + 1).alias("_rank"))
    ranked = ranks(df.select(id_col, label), "_rank", id_col, label, seed)
    picked = ranked.withColumn("_class", F.col(label).cast("int")).join(draws, ["_class", "_rank"])
    return df.join(picked.select(id_col, "draw"), id_col)
