import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from textmeter.operators import cleaning as C, models as M
from textmeter.session import fresh_path, materialize, remove, shared_folder, spread
from textmeter.sources import models as model_files, tables as T

TEXTS = ['a "q", \n b\\', "", None, "  lead trail  \r\n x", '"', "plain", "\\N", "tab\t, comma", "\n", "ü é"]


def test_csv_round_trip_is_exact(spark, table):
    df = table([(i, t, i % 2) for i, t in enumerate(TEXTS)], T.REVIEWS).coalesce(1)
    back = T.read_csv(spark, T.write_csv(df, fresh_path(spark, "csv")))
    got = {r.id: r.review for r in back.collect()}
    expected = dict(enumerate(TEXTS))
    # The null marker itself is the one text that cannot be told from null.
    expected[TEXTS.index("\\N")] = None
    assert got == expected


def test_absent_file_and_broken_row(spark, tmp_path):
    assert T.read_csv(spark, str(tmp_path / "none.csv")) is None
    bad = tmp_path / "bad.csv"
    bad.write_text("id,review,sentiment\n1,x,notanumber\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        T.read_csv(spark, str(bad)).collect()


def test_load_shuffles_once(spark, table, tmp_path):
    parts = [table([(i, f"t{i}", str(i % 2)) for i in r], "id long, text string, label string") for r in (range(5), range(5, 9))]
    path = str(tmp_path / "reviews")
    first = T.load_reviews(spark, path, *parts).orderBy("id").collect()
    assert [r.id for r in first] == list(range(1, 10)) and {r.review for r in first} == {f"t{i}" for i in range(9)}
    assert all(r.sentiment == int(r.review[1:]) % 2 for r in first)
    loose = {"min_rows": 9, "min_avg_words": 1, "min_vocabulary": 1}
    assert T.load_reviews(spark, path, **loose).orderBy("id").collect() == first
    with pytest.raises(ValueError, match="rows"):
        T.load_reviews(spark, path)
    with pytest.raises(ValueError, match="no table"):
        T.load_reviews(spark, str(tmp_path / "none"))


def test_columns_are_found_by_name(spark, tmp_path):
    swapped = tmp_path / "swapped.csv"
    swapped.write_text("sentiment,review,id\n1,x,7\n")
    assert [tuple(r) for r in T.read_csv(spark, str(swapped)).collect()] == [(7, "x", 1)]
    two = tmp_path / "two.csv"
    two.write_text("review,sentiment\nx,1\ny,0\n")
    got = T.read_csv(spark, str(two)).collect()
    assert [(r.review, r.sentiment) for r in got] == [("x", 1), ("y", 0)] and len({r.id for r in got}) == 2
    other = tmp_path / "other.csv"
    other.write_text("id,sentiment_x,review\n1,1,x\n")
    with pytest.raises(ValueError, match="sentiment"):
        T.read_csv(spark, str(other))


def test_an_unreadable_file_counts_as_absent(spark, tmp_path):
    (tmp_path / "broken.csv.gz").write_bytes(b"this is no archive")
    assert T.read_csv(spark, str(tmp_path / "broken.csv.gz")) is None
    (tmp_path / "empty.csv").write_text("")
    assert T.read_csv(spark, str(tmp_path / "empty.csv")) is None


def test_cache_is_reused_and_refreshed(spark, table):
    calls = []

    def clean(df, **settings):
        calls.append(1)
        return C.clean_text(df, **settings)

    path = fresh_path(spark, "cache")
    df = table([(1, "One text"), (2, "two texts")], "id long, review string")
    first = T.cleaned_cache(df, path, clean).orderBy("id").collect()
    assert T.cleaned_cache(df.repartition(3), path, clean).orderBy("id").collect() == first and len(calls) == 1
    changed = table([(1, "One text"), (2, "other words")], "id long, review string")
    assert T.cleaned_cache(changed, path, clean).filter("id = 2").first().cleaned_review == "words" and len(calls) == 2


def test_cache_tells_labels_and_settings_apart(spark, table):
    path, schema = fresh_path(spark, "cache"), "id long, review string, sentiment int"
    df = table([(1, "One of the texts", 0), (2, "two texts", 1)], schema)
    T.cleaned_cache(df, path, C.clean_text)
    swapped = table([(1, "One of the texts", 1), (2, "two texts", 0)], schema)
    assert {r.id: r.sentiment for r in T.cleaned_cache(swapped, path, C.clean_text).collect()} == {1: 1, 2: 0}
    longer = T.cleaned_cache(df, path, C.clean_text, min_length=4, stop_words=())
    assert {r.cleaned_review for r in longer.collect()} == {"texts"}
    lemmas = table([("texts", "text")], "form string, lemma string")
    assert {r.cleaned_review for r in T.cleaned_cache(df, path, C.clean_text, lemmas=lemmas).collect()} == {"one text", "two text"}


def test_upsert_replaces_the_models_rows(spark, table):
    schema = "Model string, Features string, Accuracy double"
    old = table([("a", "x", 0.1), ("b", "x", 0.2), ("b", "y", 0.3)], schema)
    new = table([("b", "z", 0.9)], schema)
    path = fresh_path(spark, "results")
    T.store_results(path, old)
    assert {tuple(r) for r in T.store_results(path, new).collect()} == {("a", "x", 0.1), ("b", "z", 0.9)}
    assert T.upsert_result(None, new).collect() == new.collect()


def test_model_store(spark, table):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql import types as S
    schema = S.StructType([S.StructField("id", S.LongType()), S.StructField("sentiment", S.IntegerType()), S.StructField("v", VectorUDT())])
    df = table([(i, i % 2, Vectors.dense([i % 2 + i / 100, 1.0])) for i in range(40)], schema)
    model, before = M.train_and_predict(M.logistic_regression, df, df, "v")
    again = M.predict(model_files.load_model(model_files.save_model(model, fresh_path(spark, "model"))), df)
    assert [r.y_pred for r in before.orderBy("id").collect()] == [r.y_pred for r in again.orderBy("id").collect()]
    assert before.filter("y_true = y_pred").count() == 40
    scored = M.argmax_prediction(M.scores(model, df))
    assert scored.filter("y_true = y_pred").count() == 40


def session_with(**settings):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: settings.get(key, default)))


def test_shared_folder_is_the_configured_one():
    named = session_with(**{"spark.checkpoint.dir": "hdfs://x/y/", "spark.master": "yarn"})
    assert shared_folder(named) == "hdfs://x/y"
    assert fresh_path(named, "t").startswith("hdfs://x/y/t-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session_with(**{"spark.master": "yarn"}))


def test_written_tables_are_read_back(spark):
    df = materialize(spark.range(3), "r")
    assert df.count() == 3 and shared_folder(spark) in df.inputFiles()[0]


def test_written_tables_are_removed(spark, tmp_path):
    df, path = spark.range(3), fresh_path(spark, "gone")
    df.write.parquet(path)
    remove(spark, path)
    assert T.read_csv(spark, path) is None


def test_spread_only_when_needed(spark):
    few, many = materialize(spark.range(100, numPartitions=1), "few"), materialize(spark.range(100, numPartitions=16), "many")
    assert spread(many, "id") is many
    assert spread(few, "id").agg(F.sum("id")).first()[0] == 4950


def test_building_a_role_runs_no_job(spark):
    from textmeter.catalog import queries as C
    tracker, group = spark.sparkContext.statusTracker(), "roles"
    spark.sparkContext.setJobGroup(group, group)
    tables = [spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels", "pages")]
    assert tables
    footers = len(tracker.getJobIdsForGroup(group))
    for role in (C.reviews, C.documents, C.pages):
        role(spark, "/root/testdata/sf0.001")
    # One footer job per table read; nothing else.
    assert len(tracker.getJobIdsForGroup(group)) - footers <= 4
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = C.reviews(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2


@pytest.mark.parametrize("split", [64, 300, 5000])
def test_one_file_is_read_in_ranges(spark, tmp_path, split):
    # Line breaks, quotes and both inside texts; texts longer than a range; blank lines; Windows line ends.
    rng = random.Random(split)
    words = ["plain", 'a "quoted" word', "two\nlines", '"\n"', ",", "", " ", "é x", "\n\n\n", "end\r\nhere", "x" * 200, '""', "\n" * 90]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))), i % 2) for i in range(150)] + [(900, None, 1), (901, "", 0)]
    def field(x):
        return "\\N" if x is None else '"' + str(x).replace('"', '""') + '"'
    def text(part, newline):
        return newline.join(["id,review,sentiment", *(f"{i},{field(t)},{s}" + (newline if i % 7 == 0 else "") for i, t, s in part)]) + newline
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.csv").write_bytes(text(rows[:140], "\n").encode())
    (tmp_path / "one" / "b.csv").write_bytes(text(rows[140:], "\n").encode()[:-1])
    folder = str(tmp_path / "one")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.text(f"{folder}/a.csv").rdd.getNumPartitions() > 1
        got = T.read_csv(spark, folder).collect()
        plain = spark.read.schema(T.REVIEWS).options(**T.CSV_OPTIONS, multiLine=True, mode="FAILFAST").csv(folder).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, plain), key=repr)
    assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)


def test_windows_line_ends_and_stray_quotes(spark, tmp_path):
    win = tmp_path / "win.csv"
    win.write_bytes(b'id,review,sentiment\r\n1,"a\nb",0\r\n2,c,1\r\n')
    assert sorted(map(tuple, T.read_csv(spark, str(win)).collect())) == [(1, "a\nb", 0), (2, "c", 1)]
    stray = tmp_path / "stray.csv"
    stray.write_text('id,review,sentiment\n1,five " inches,0\n2,c,1\n')
    assert T.csv_records(spark, str(stray)) is None
    assert sorted(map(tuple, T.read_csv(spark, str(stray)).collect())) == [(1, 'five " inches', 0), (2, "c", 1)]
