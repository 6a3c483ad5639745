"""The corpus pipeline: each stage against its operator's promise, on the stage's own input."""

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textmeter.llm import decontaminate, line_dedup, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "12 34 !!", None, None, 8), (9004, docs.first().text, "en", "s", 1)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    out = [docs.cache()]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_names(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "simhash", "lines", "benchmark", "tokens"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_language_drops_texts_without_letters(steps):
    before = {r.doc_id: r.text for r in steps[0].collect()}
    assert ids(steps[1]) == sorted(k for k, t in before.items() if t and any(map(str.isalpha, t)))


def test_one_document_of_each_class(steps):
    classes = simhash.near_duplicates(steps[1]).collect()
    assert ids(steps[2]) == sorted({r.component_id for r in classes})


def test_lines_are_unique_afterwards(steps):
    seen = set()
    for r in sorted(steps[3].collect(), key=lambda r: r.doc_id):
        digests = [d for _, _, d in line_dedup.units(r.text)]
        assert not seen & set(digests) and len(set(digests)) == len(digests)
        assert r.n_chars == len(r.text)
        seen |= set(digests)


def test_short_lines_are_unique_too(spark):
    clause = "这是一个没有空格的长句子，它有四个分句，每一句都重复，所以应当删除"
    rows = [(1, f"theand thble reingwh\n{clause}\nown one", "en", "s", 0), (2, f"{clause}\nTheand, thble reingwh!\nown two\n--", "en", "s", 0), (3, "Own two.", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_lines(spark, docs, SF).collect()}
    assert got == {1: rows[0][1], 2: "own two\n--"}


def test_no_item_is_left(steps, spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    benchmark = decontaminate.Benchmark(items)
    assert ids(steps[4]) == [r.doc_id for r in steps[3].orderBy("doc_id").collect() if not list(benchmark.search(r.text))]


def test_tokens_are_lossless(steps):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    rows = steps[5].collect()
    assert sorted(texts) == sorted(r.doc_id for r in rows)
    assert all(r.lossless and r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in rows)


def test_hard_rows_and_empty_tables(spark):
    """Null ids, repeated rows, ties, a very long text, own columns named like an operator's; then no rows at all."""
    long = " ".join(f"word{i}" for i in range(40_000))
    rows = [(None, "no id here at all", "en", "s", 17), (5, long, "en", "s", len(long)), (1, "the same text twice", "en", "s", 19),
            (1, "the same text twice", "en", "s", 19), (2, "the same text twice", None, None, None), (3, None, "en", "s", None), (4, "", "xx", "s", 0)]
    own = ["removed", "lang_pred", "score", "__row", "__key", "ids", "item_id", "given"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(0)).cast("string")) for c in own})
    for given, ids in ((docs, [None, 1, 5]), (docs.limit(0), [])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            given = stage(spark, given, SF)
            assert given.columns == docs.columns, name
            got = given.collect()
            assert all(r[c] == f"{c}{r.doc_id or 0}" for r in got for c in own), name
            given = spark.createDataFrame(got, given.schema)
        assert sorted((r.doc_id for r in got), key=lambda i: i or 0) == ids
        last = corpus_pipeline.STAGES[-1][1](spark, given, SF).collect()
        assert len(last) == len(ids) and all(r.lossless for r in last)


def test_run_is_the_stages_in_order(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "lossless"] and got.filter("NOT lossless").count() == 0
