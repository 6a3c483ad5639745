"""Nearest neighbours: recall and exact scores against brute force, and odd vectors."""

import numpy as np

from textmeter.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(rows, k):
    """{query: [(id, distance)]} over rows that can take part."""
    ok = {i: np.array(v, "f8") for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v))}
    out = {}
    for q in (i for i in ok if i % 100 == 0):
        near = sorted((float(np.sqrt(((ok[i] - ok[q]) ** 2).sum())), i) for i in ok if i != q and len(ok[i]) == len(ok[q]))
        out[q] = [(i, d) for d, i in near[:k]]
    return out


def answers(df, **settings):
    out = {}
    for r in df.sparkSession.createDataFrame(ann.nearest(df, **settings).collect(), "query_id long, rank int, vec_id long, score double").orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def vectors(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 50, dim))
    return [(i, (centres[i % len(centres)] + 0.4 * rng.normal(size=dim)).astype("f4").tolist()) for i in range(n)]


def test_recall_and_scores(spark, monkeypatch):
    rows = vectors(3000)
    rows += [(5000 + i, rows[7][1]) for i in range(400)]  # many copies of one vector
    want = exact(rows, 10)
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(4)
    index = ann.build_index(ann.usable(df, "vec_id", "embedding"), 10, shard_rows=600)
    assert index.select("shard").distinct().count() > 3
    monkeypatch.setattr(ann, "SHARD_ROWS", 600)
    got = answers(df)
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    at = dict(rows)
    for q, found in got.items():
        assert [r for r, *_ in found] == list(range(1, 11))
        assert found == sorted(found, key=lambda x: (x[2], x[1]))
        for _, i, s in found:
            assert s == np.sqrt(((np.array(at[i], "f4").astype("f8") - np.array(at[q], "f4")) ** 2).sum())
    # The answer for a copied vector is other copies, smallest ids first.
    copies = [i for i, v in rows if v == rows[7][1]]
    assert [i for _, i, _ in got[5000]] == [i for i in copies if i != 5000][:10]


def test_few_candidates_come_back_all(spark):
    rows = [(i * 50, [float(i), 1.0]) for i in range(7)]
    got = answers(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA))
    assert {q: [(i, s) for _, i, s in f] for q, f in got.items()} == exact(rows, 10)


def test_small_graphs_reach_every_node():
    for n in (1, 2, 5, 40, 300):
        points = np.random.default_rng(n).normal(size=(n, 3)).astype("f4")
        points[: n // 2] *= 1e-3
        graph, entries = ann.build_graph(points, degree=4)
        assert not len(ann._unreached(graph, entries))
        assert all(i not in row for i, row in enumerate(graph.tolist()))


def test_pruning_keeps_near_and_diverse():
    line = np.array([[0.0], [1.0], [1.1], [-1.0], [5.0]], "f4")
    kept = ann.robust_prune(line, np.array([0]), np.array([[1, 2, 3, 4, -1, 0]]), 3, 1.2)
    assert kept.tolist() == [[1, 3, -1]]


def test_odd_rows_take_no_part(spark):
    rows = [
        (0, [1.0, 0.0]), (100, [0.0, 0.0]), (200, None), (300, [1.0, None]), (400, [float("nan"), 1.0]), (500, [float("inf"), 1.0]),
        (600, []), (None, [1.0, 1.0]), (700, [1.0, 2.0, 3.0]), (701, [1.0, 2.0, 4.0]), (1, [1.0, -0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]),
    ]
    got = answers(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA))
    assert {q: [(i, s) for _, i, s in f] for q, f in got.items()} == {0: [(1, 0.0), (2, 1.0)], 700: [(701, 1.0)]}
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
