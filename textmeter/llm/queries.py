"""Registered queries of the corpus operators: thin readings of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from textmeter.llm import ann, bpe, decontaminate, language, lexical, line_dedup, main_text, sharding, simhash, token_store, url_filter, word_lm, word_runs
from textmeter.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_pruned_graph(spark, sf):
    return ann.nearest(table(spark, sf, "embeddings"), k=10, every=100)


@query
def op2_simhash_trie(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"), width=3, distance=2)


@query
def op3_stratified_shards(spark, sf):
    return sharding.shard_rows(table(spark, sf, "documents"), shards=40)


@query
def op4_line_dedup(spark, sf):
    """``removed``: offsets of what was cut, as 'start-end' joined by commas."""
    cut = line_dedup.drop_repeated_units(table(spark, sf, "documents"), min_words=1, sentence_words=5)
    spans = F.transform("removed", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return cut.select("doc_id", "text", F.array_join(spans, ",").alias("removed"))


@query
def op5_cross_entropy(spark, sf):
    good = table(spark, sf, "labels").filter("quality = 1")
    return word_lm.cross_entropy_difference(table(spark, sf, "documents"), good)


@query
def op6_simhash_windows(spark, sf):
    return decontaminate.find_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op7_token_store(spark, sf):
    tokenizer = bpe.tokenizer_json(public_tokenizers.path("byte_bpe_50k.json"))
    manifest, folder = token_store.write_ids(table(spark, sf, "documents"), tokenizer, end_id=2)
    return token_store.checksums(manifest, folder)


@query
def op8_byte_bpe(spark, sf):
    tokenizer = bpe.tokenizer_json(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(table(spark, sf, "documents"), tokenizer)


#: Hosts and paths of the url contract.
URL_RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]


@query
def op9_url_equivalence(spark, sf):
    return url_filter.judge(table(spark, sf, "pages"), URL_RULES)


@query
def op10_language_families(spark, sf):
    docs = table(spark, sf, "documents")
    found = language.identify(docs, language.learn(docs))
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query
def op11_line_blocks(spark, sf):
    return main_text.extract(table(spark, sf, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def with_repeated_tail(docs: DataFrame) -> DataFrame:
    """The texts that the run contract asks about: in a tenth of them the words repeat from some word on."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    given = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    sized = given.select("*", F.size("words").alias("n"), F.floor(F.col("h") / 10).alias("g"))
    begun = sized.select("*", (F.col("g") % F.col("n")).cast("int").alias("a")).select(
        "*", (F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1).cast("int").alias("p"))
    left = F.col("n") - F.col("a")
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    again = F.slice(F.flatten(F.array_repeat(period, F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    repeated = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), again), " ")
    return begun.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


@query
def op12_word_runs(spark, sf):
    found = word_runs.find_runs(with_repeated_tail(table(spark, sf, "documents")))
    longest = word_runs.longest_run(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "longest.*", F.expr("1000 * longest.length div longest.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


@query
def op13_presence_masks(spark, sf):
    return lexical.best_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=50)
