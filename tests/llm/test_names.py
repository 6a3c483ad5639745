"""Tables whose own columns are named like an operator's temporary ones: they come back as they were."""

import pytest
from pyspark.sql import functions as F

from textmeter.llm import decontaminate, language, line_dedup, sharding, simhash

OWN = ["__key", "__hash", "__spans", "__cut", "__row", "__found", "__at", "__tie", "own 0 of the table"]

OPERATORS = {
    "lines": lambda docs: line_dedup.drop_repeated_units(docs, min_words=1),
    "simhash": simhash.representatives,
    "benchmark": lambda docs: decontaminate.drop_contaminated(docs, docs.limit(0).withColumnRenamed("doc_id", "item_id")),
    "language": lambda docs: language.identify(docs, {"languages": [], "machines": {}}),
    "shards": lambda docs: sharding.interleave(docs, 3),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_own_columns_pass_through(spark, name):
    docs = spark.createDataFrame([(1, "a b c d", "s"), (None, None, "s"), (3, "e f g h i", None)], "doc_id long, text string, source string")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in OWN})
    got = OPERATORS[name](docs)
    assert [c for c in got.columns if c in OWN] == OWN
    rows = got.collect()
    assert len(rows) == 3
    assert all(r[c] == c + ("" if r.doc_id is None else str(r.doc_id)) for r in rows for c in OWN)


def test_a_column_named_by_the_caller_is_used(spark):
    docs = spark.createDataFrame([(1, "same text here"), (2, "same text here")], "__key long, __row string")
    assert [tuple(r) for r in simhash.representatives(docs, key="__key", text="__row").collect()] == [(1, "same text here")]
