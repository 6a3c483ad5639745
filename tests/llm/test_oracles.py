"""Corpus queries against their SQL counterparts, on the smallest tables and on hard rows."""

import duckdb
import pytest

from textmeter.llm import oracles, queries

SF = "/root/testdata/sf0.001"


def compare(spark, con, name, folder):
    df = queries.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(repr(r[c]) for c in columns) for r in df.collect())
    rel = con.sql(oracles.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(repr(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    compare(spark, con, name, SF)


HARD_PAGES = [
    (1, "http://o.org/1", '<link href="http://x.net/es/bad" REL=canonical>'), (2, "http://o.org/2#top", "<meta content='0; URL=/1' http-equiv='refresh'>"),
    (3, "http://o.org/d/3", '<link rel="canonical" href="//X.net/es/bad">'), (4, "http://o.org/d/4", '<link rel="canonical" href="3">'),
    (5, "HTTP://A.com/6", '<link rel="canonical" href="http://o.org/9?a&amp;b">'), (6, "http://o.org/9?a&b", None), (7, None, "canonical"),
    (8, "no scheme", '<link rel="canonical" href="/x">'), (9, "http://www.example.com/en/", ""), (10, "http://m.example.com/en/#x", "refresh"),
    (11, "http://q.org/a/b/11", '<link rel="shortlink canonical" href="../../es/./x/.."><link rel="canonical" href="/two">'), (12, "http://q.org/es/", None),
    (13, "http://q.org/two?a/../b", "<meta http-equiv=refresh content='0;url=../../../t/.'><meta http-equiv=refresh content='0;url=http://x.net/es/bad'>"),
    (14, "http://q.org/t/", "<link rel='not-here' href='http://x.net/fr/'>"), (15, "http://q.org/z/../two", None), (16, "http://q.org/..", None),
]
HARD_TEXTS = [
    (1, "one two three four five\n\nshort\nOne, two three four FIVE!", "a"), (2, None, None), (3, "", "a"), (5, "\n", "b"),
    (4, "é ü one two three\none two three four five\n", "a"), (6, "É Ü one two three\nown words here and there", None),
    (7, "In front. A passage of six words here! Behind it.\n--", "a"), (8, "Some. a passage of six words here? other\nshort", "a"),
    (9, "!! a passage of six words here.\none two three four five. A passage of six words here.\n\nend. of it", "b"),
]


@pytest.mark.parametrize(("name", "table", "rows", "schema"), [
    ("op9_url_equivalence", "pages", HARD_PAGES, "page_id long, url string, html string"),
    ("op4_line_dedup", "documents", HARD_TEXTS, "doc_id long, text string, source string"),
    ("op3_stratified_shards", "documents", HARD_TEXTS, "doc_id long, text string, source string"),
])
def test_hard_rows(spark, tmp_path, name, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    compare(spark, con, name, str(tmp_path))
