"""Ties between the parts of a graph: a spanning forest by brute force, equal places, many isolated spots."""

import random

from pyspark.sql import functions as F

from spotlattice.operators import cluster, graph


def spanning(points, edges):
    """Total length of the ties that a shortest spanning forest adds to the edges."""
    root = {p[0]: p[0] for p in points}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        root[find(a)] = find(b)
    ties = sorted(((x - u) ** 2 + (y - v) ** 2, i, j) for i, x, y in points for j, u, v in points if i < j)
    out = []
    for d2, i, j in ties:
        if find(i) != find(j):
            root[find(i)] = find(j)
            out.append(d2)
    return out


def test_ties_are_the_shortest(spark):
    r = random.Random(6)
    samples = {
        "blobs": [(i, r.gauss(50 * (i % 3), 4), r.gauss(20 * (i % 2), 4)) for i in range(150)],
        "places": [(i, float(i // 4 % 3), float(i // 12)) for i in range(48)],  # four spots at each place
        "far": [(0, 0.0, 0.0), (1, 1e-9, 0.0), (2, 1e6, 1e6), (3, 1e6, 1e6 + 1e-3)],
        "one": [(0, 5.0, 5.0)],
    }
    links = {"blobs": [(i, i + 6) for i in range(144) if i % 5], "places": [(0, 1)], "far": [], "one": []}
    spots = spark.createDataFrame([(s, *p) for s, ps in samples.items() for p in ps], "sample_id string, spot long, x double, y double")
    edges = spark.createDataFrame([(s, a, b) for s, es in links.items() for a, b in es], "sample_id string, a long, b long")
    got = {s: [] for s in samples}
    for q in graph.connect(spots, edges).collect():
        got[q.sample_id].append((q.a, q.b))
    for s, points in samples.items():
        assert spanning(points, got[s]) == []  # one piece
        at = {i: (x, y) for i, x, y in points}
        added = sorted((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2 for a, b in set(got[s]) - set(links[s]))
        want = spanning(points, links[s])
        if s == "places":  # ties of length zero may close a ring of equal places
            assert sum(added) == sum(want)
        else:
            assert added == want


def test_isolated_spots_need_no_pairs(spark):
    """Thousands of spots without an edge: the rows of every step stay in proportion to the spots."""
    r = random.Random(1)
    n = 5000
    spots = spark.createDataFrame([("s", i, r.random() * 1000, r.random() * 1000) for i in range(n)], "sample_id string, spot long, x double, y double").withColumn("comp", F.col("spot"))
    made, write = [], graph.cut

    def counted(df):
        out = write(df)
        made.append(out.count())
        return out

    graph.cut = counted
    try:
        ties = graph._shortest_ties(spots)
        assert ties.count() == n
    finally:
        graph.cut = write
    assert max(made) < 100 * n


def test_ward_joins_parts_without_edges(spark):
    rows = [("s", i, float((0, 90, 400, 490)[i // 5] + i % 5), 0.0) for i in range(20)]
    points = spark.createDataFrame(rows, "sample_id string, spot long, x double, y double").withColumn("f", F.array("x", "y"))
    inner = spark.createDataFrame([("s", i, i + 1) for i in range(19) if i % 5 < 4], "sample_id string, a long, b long")
    two = {}
    for q in cluster.ward_fit(points, inner, 2, 2).collect():
        two.setdefault(q.label, set()).add(q.spot // 5)
    assert sorted(map(sorted, two.values())) == [[0, 1], [2, 3]]
    assert cluster.ward_fit(points, inner.limit(0), 4, 2).select("label").distinct().count() == 4
