"""Versioned commits: writers at once lose nothing, and what is half-written is never read."""

from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

import pytest

from textmeter.session import fresh_path
from textmeter.sources import models, tables as T, versions

SCHEMA = "Model string, Features string, Accuracy double"


def test_two_writers_at_once_lose_nothing(spark, monkeypatch):
    path, both, published = fresh_path(spark, "results"), Barrier(2), []
    publish = versions._publish

    def together(spark, root, version, folder):
        # Both have written version 1 when either tries to commit it.
        if version == 1:
            both.wait(60)
        published.append((version, publish(spark, root, version, folder)))
        return published[-1][1]

    monkeypatch.setattr(versions, "_publish", together)
    with ThreadPoolExecutor(2) as pool:
        rows = [spark.createDataFrame([(m, "x", 0.5)], SCHEMA) for m in "ab"]
        list(pool.map(lambda r: T.store_results(path, r), rows))
    assert sorted(published) == [(1, False), (1, True), (2, True)]
    version, folder = versions.current(spark, path)
    assert version == 2 and {r.Model for r in T.read_csv(spark, folder, rows[0].schema).collect()} == {"a", "b"}


def test_a_stopped_writer_leaves_nothing_that_is_read(spark):
    path = fresh_path(spark, "results")
    assert versions.current(spark, path) == (0, None)

    def stops(before, folder):
        spark.range(3).write.parquet(folder)
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        versions.commit(spark, path, stops)
    assert versions.current(spark, path) == (0, None)
    first = versions.commit(spark, path, lambda before, folder: spark.range(1).write.parquet(folder))
    with pytest.raises(RuntimeError):
        versions.commit(spark, path, stops)
    assert versions.current(spark, path) == (1, first) and spark.read.parquet(first).count() == 1


def test_no_model(spark):
    with pytest.raises(FileNotFoundError):
        models.load_model(fresh_path(spark, "model"))
