import hashlib

import pytest
from pyspark.sql import functions as F

from textmeter.catalog.queries import reviews
from textmeter.operators import splits as S
from textmeter.operators.hash_order import HashOrder, ranks

from conftest import DATA


def key(i, seed=42):
    return hashlib.md5(f"{i}|{seed}".encode()).hexdigest(), i


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, 1 if i % 3 else 0) for i in range(1000)]
    return spark.createDataFrame(rows, "id long, sentiment int").cache()


def test_golden_split(spark):
    split = S.stratified_split(reviews(spark, f"{DATA}/sf0.01"))
    sums = {(r.sentiment, r.split): (r.n, r.s) for r in split.groupBy("sentiment", "split").agg(
        F.count("*").alias("n"), F.sum("id").alias("s")).collect()}
    assert sums == {(0, "train"): (46, 26375), (0, "test"): (12, 5889), (1, "train"): (273, 132046), (1, "test"): (68, 32145)}


def test_published_sizes():
    sizes = {0: 24_698, 1: 24_884}
    n = sum(sizes.values())
    assert S.proportional_quotas(sizes, n - 9_917) == {0: 19_758, 1: 19_907}
    assert S._validation_size(39_665, 0.1, 50) == 3_966
    assert S.proportional_quotas({0: 5, 1: 5}, 5) == {0: 3, 1: 2}
    # Exact where doubles are not.
    assert sum(S.proportional_quotas({0: 10**17 + 1, 1: 10**17 + 3}, 10**17 + 7).values()) == 10**17 + 7


def test_prefix_equals_sorting(labelled):
    ids = sorted((i for i in range(1000) if i % 3), key=key)
    got = HashOrder(labelled, label="sentiment").first_rows({0: 0, 1: 123}, "f").filter("f").select("id").collect()
    assert {r.id for r in got} == set(ids[:123])


def test_prefix_beyond_the_class_takes_all_of_it(labelled):
    assert HashOrder(labelled, label="sentiment").first_rows({0: 10**9}, "f").filter("f").count() == 334


def test_ranks_equal_sorting(labelled):
    got = {r.id: r.k for r in ranks(labelled, "k").collect()}
    assert got == {i: n for n, i in enumerate(sorted(range(1000), key=key), 1)}
    by_class = {r.id: r.k for r in ranks(labelled, "k", label="sentiment").collect()}
    assert by_class[sorted((i for i in range(0, 1000, 3)), key=key)[0]] == 1


@pytest.mark.parametrize("n, pos, neg, expected", [(5, 4, 4, (2, 3)), (6, 1, 9, (1, 5)), (None, 2, 3, (2, 3)), (99, 2, 3, (2, 3))])
def test_balanced_sample(table, n, pos, neg, expected):
    df = table([(i, int(i < pos)) for i in range(pos + neg)], "id long, sentiment int")
    rows = S.balanced_sample(df, n).collect()
    assert (sum(r.sentiment for r in rows), sum(1 - r.sentiment for r in rows)) == expected


def test_proportional_and_uniform_sizes(labelled):
    assert {r.sentiment: r["count"] for r in S.proportional_sample(labelled, 101).groupBy("sentiment").count().collect()} == {0: 34, 1: 67}
    assert S.uniform_sample(labelled, 77).count() == 77
    assert S.uniform_sample(labelled, 7700).count() == 1000


def test_tail_is_the_end_of_the_shuffle(labelled):
    position = {r.id: r.position for r in S.seeded_shuffle(labelled, seed=43).collect()}
    val = [r.id for r in S.tail_validation_split(labelled).filter("split = 'val'").collect()]
    assert len(val) == 100 and min(position[i] for i in val) == 901


def test_stratified_validation(labelled):
    counts = {(r.split, r.sentiment): r["count"] for r in S.stratified_validation_split(labelled).groupBy("split", "sentiment").count().collect()}
    assert counts == {("train", 0): 301, ("train", 1): 599, ("val", 0): 33, ("val", 1): 67}


def test_folds_are_even(labelled):
    counts = S.stratified_kfold(labelled).groupBy("sentiment", "fold").count().collect()
    for c in (0, 1):
        sizes = [r["count"] for r in counts if r.sentiment == c]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_bootstrap(labelled):
    drawn = S.bootstrap_resample(labelled, 300)
    assert {r.sentiment: r["count"] for r in drawn.groupBy("sentiment").count().collect()} == {0: 100, 1: 200}
    assert drawn.select("id").distinct().count() < 300
    assert S.bootstrap_resample(labelled, 300, replace=False).select("id").distinct().count() == 300
    # The size of the table decides nothing: asked for more rows than there are, it draws them.
    larger = S.bootstrap_resample(labelled, 5000)
    assert larger.count() == 5000 and larger.select("id").distinct().count() <= 1000
    assert S.bootstrap_resample(labelled, 5000, replace=False).count() == 1000


@pytest.fixture(scope="module")
def partly(spark):
    """60 labelled rows, 30 without a usable label, 10 without an id."""
    rows = [(i, i % 2) for i in range(60)] + [(100 + i, (None, 2, -1)[i % 3]) for i in range(30)] + [(None, i % 2) for i in range(10)]
    return spark.createDataFrame(rows, "id long, sentiment int").repartition(4).cache()


def sides(df, column="split"):
    return {r[0]: r[1] for r in df.groupBy(column).count().collect()}


def test_rows_without_label_or_id_are_on_no_side(partly):
    assert sides(S.stratified_split(partly)) == {"train": 48, "test": 12, None: 40}
    assert sides(S.stratified_validation_split(partly, floor=10)) == {"train": 50, "val": 10, None: 40}
    # No label is needed here, an id is.
    assert sides(S.tail_validation_split(partly, floor=10)) == {"train": 80, "val": 10, None: 10}
    assert sides(S.stratified_kfold(partly), "fold") == {0: 12, 1: 12, 2: 12, 3: 12, 4: 12, None: 40}
    shuffled = [r.position for r in S.seeded_shuffle(partly).collect()]
    assert sorted(p for p in shuffled if p) == list(range(1, 91)) and shuffled.count(None) == 10


def test_samples_leave_them_out(partly):
    for n, size in ((20, 20), (1000, 60), (None, 60)):
        assert S.balanced_sample(partly, n).filter("sentiment IN (0, 1) AND id < 60").count() == size == S.balanced_sample(partly, n).count()
        assert S.proportional_sample(partly, n).filter("sentiment IN (0, 1) AND id < 60").count() == size == S.proportional_sample(partly, n).count()
    assert S.uniform_sample(partly, 1000).count() == 90
    assert S.bootstrap_resample(partly, 200).filter("id < 60").count() == 200
    assert S.bootstrap_resample(partly, 200, replace=False).count() == 60


def test_runs_agree(labelled):
    once, again = (S.stratified_split(labelled).orderBy("id").collect() for _ in range(2))
    assert once == again
    spread = S.stratified_split(labelled.repartition(7)).orderBy("id").collect()
    assert spread == once


def test_tail_of_a_balanced_sample_is_mixed(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)], "id long, sentiment int")
    val = S.tail_validation_split(S.balanced_sample(df, 300)).filter("split = 'val'")
    counts = {r.sentiment: r["count"] for r in val.groupBy("sentiment").count().collect()}
    assert sum(counts.values()) == 50 and min(counts.values()) >= 15
