"""Ward merges: small samples in one task take the same rounds as the tables."""

import numpy as np

from spotlattice.operators import cluster


def test_ties_have_the_hash_of_the_tables(spark):
    rows = [(0, 1), (5, 2**40), (-3, 7), (2**62, 2**63 - 1)]
    got = spark.createDataFrame(rows, "a long, b long").selectExpr("xxhash64(a, b) AS h").collect()
    a, b = np.array(rows, np.int64).T
    assert [r.h for r in got] == cluster._pair_hash(a, b).tolist()


def test_few_clusters_merge_in_one_task(spark, monkeypatch):
    r = np.random.default_rng(5)
    # values with ties, a sample on a line, one with fewer spots than clusters
    rows = [("a", i, [float(v)], float(i % 8), float(i // 8)) for i, v in enumerate(r.integers(0, 6, 48))] + [("b", i, [float(i % 5)], float(i), 0.0) for i in range(20)] + [("c", i, [0.0], float(i), 0.0) for i in range(2)]
    p = spark.createDataFrame(rows, "sample_id string, spot long, f array<double>, x double, y double")
    pairs = [("a", i, i + d) for i in range(48) for d in (1, 8) if i + d < 48 and (d == 8 or i % 8 < 7)] + [("b", i, i + 1) for i in range(19)]
    edges = spark.createDataFrame(pairs, "sample_id string, a long, b long")
    rounds, one = [], cluster.ward_round
    monkeypatch.setattr(cluster, "ward_round", lambda *args, **kw: rounds.append(1) or one(*args, **kw))
    label = lambda: {(q.sample_id, q.spot): q.label for q in cluster.ward_fit(p, edges, 3, 1).collect()}
    in_task = label()
    assert not rounds and len(in_task) == 70
    assert [len({v for (s, _), v in in_task.items() if s == name}) for name in "abc"] == [3, 3, 2]
    monkeypatch.setattr(cluster, "_SMALL", 0)
    assert label() == in_task and rounds
