"""Queries over the whole tables against brute force."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlattice import catalog
from spotlattice.operators import cluster, graph, normalize, stats
from spotlattice.plans.views import view

DIR = "/root/testdata/sf0.001"


def run(spark, name):
    return catalog.queries()[name](spark, DIR).collect()


def test_library_size_counts_all_genes(spark):
    want = {(r.sample_id, r.spot): 1 for r in view(spark, DIR, "spots").collect()}
    counts = view(spark, DIR, "counts").collect()
    assert max(r.gene for r in counts) > 20
    for at in want:
        want[at] = sum(r.n for r in counts if (r.sample_id, r.spot) == at) or 1
    assert {(r.sample_id, r.spot): r.size for r in run(spark, "library_size_whole")} == want


def test_feasibility_of_all_rows(spark):
    want = {r.ingest_seq: "laptop" if r.peak_rss_mb * 2 < 6000 else "cloud" for r in view(spark, DIR, "ledger").collect()}
    assert {r.ingest_seq: r.recommendation for r in run(spark, "feasibility_flags_whole")} == want


def test_resolution_select_of_all_candidates(spark):
    rows = {}
    for r in spark.read.parquet(f"{DIR}/customer.parquet").collect():
        rows.setdefault(str(r.c_nationkey % 5), []).append((r.c_custkey / 100, r.c_custkey % 23 + 2, r.c_custkey))
    want = {s: min(c, key=lambda x: (abs(x[1] - 6), x[2] if x[1] == 6 else 0, x[0]))[:2] for s, c in rows.items()}
    assert {r.sample_id: (r.gamma, r.n_labels) for r in run(spark, "resolution_select_whole")} == want


def test_patches_of_all_spots(spark):
    gray = {(r.px, r.py): float(r.gray) for r in view(spark, DIR, "pixels").collect()}
    mx, my = max(x for x, _ in gray), max(y for _, y in gray)
    got = {(r.sample_id, r.spot): r for r in run(spark, "patch_features_whole")}
    n = 0
    for r in view(spark, DIR, "spots").collect():
        cx, cy = round((float(r.x) + 1000) / 250), round(r.y / 100)
        patch = {p: g for p, g in gray.items() if abs(p[0] - cx) <= 24 and abs(p[1] - cy) <= 24}
        if not (0 <= cx <= mx and 0 <= cy <= my) or len(patch) < 25:
            continue
        n += 1
        one = got[r.sample_id, r.spot]
        steps = []
        for x, y in patch:
            ends = [patch.get(p) for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1))]
            if None not in ends:
                steps.append(math.hypot(ends[0] - ends[1], ends[2] - ends[3]))
        assert one.n_pixels == len(patch)
        assert one.gray_mean == pytest.approx(statistics.fmean(patch.values()), abs=2e-6) and one.gray_sd == pytest.approx(statistics.pstdev(patch.values()), abs=2e-6)
        assert one.grad_mean == (pytest.approx(statistics.fmean(steps), abs=2e-6) if steps else None)
    assert n == len(got)


def vectors(spark):
    known = {r.vec_id: ([float(v) for v in r.embedding], r.label) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()}
    out = {}
    for r in view(spark, DIR, "spots").collect():
        if r.spot in known:
            out.setdefault(r.sample_id, []).append((r.spot, *known[r.spot]))
    return out


def test_assignment_uses_whole_vectors(spark):
    want = {}
    for s, rows in vectors(spark).items():
        means = {k: np.mean([f for _, f, l in rows if l == k], axis=0) for k in sorted({l for *_, l in rows}) if k < 4}
        for spot, f, _ in rows:
            want[s, spot] = min((float(((np.array(f) - m) ** 2).sum()), k) for k, m in means.items())
    got = {(r.sample_id, r.spot): (r.d2, r.label) for r in run(spark, "kmeans_assign_whole")}
    assert got.keys() == want.keys() and all(len(f) == 64 for rows in vectors(spark).values() for _, f, _ in rows)
    assert all(got[k][0] == pytest.approx(want[k][0], abs=2e-6) and got[k][1] == want[k][1] for k in want)


def test_kmeans_tells_whether_it_converged(spark):
    p = spark.createDataFrame([("s", i, [float(i**2 % 37), float(i)]) for i in range(40)], "sample_id string, spot long, f array<double>")
    plan = spark.createDataFrame([(3, 11)], "K int, seed int")
    assert cluster.kmeans_fit(p, plan, 2, inits=1, rounds=1)[1].first().converged is False
    labels, best = cluster.kmeans_fit(p, plan, 2, inits=2)
    assert best.first().converged is True
    rows = labels.join(p, ["sample_id", "spot"]).collect()
    means = {k: np.mean([r.f for r in rows if r.label == k], axis=0) for k in {r.label for r in rows}}
    assert all(r.label == min(means, key=lambda k: ((np.array(r.f) - means[k]) ** 2).sum()) for r in rows)


def test_pca_converges_to_the_whole_spectrum(spark):
    x = np.random.default_rng(3).random((60, 50))
    e = spark.createDataFrame([("s", i, j, float(x[i, j])) for i in range(60) for j in range(50)], "sample_id string, spot long, gene long, v double")
    _, variance = normalize.pca(e, e.select("sample_id", "spot").distinct())
    rows = variance.orderBy("part").collect()
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:20]
    assert all(r.converged for r in rows) and [r.variance for r in rows] == pytest.approx(want.tolist(), rel=1e-6)


def test_resamples_are_whole(spark):
    deltas = spark.createDataFrame([("g", i, float(i * i % 17)) for i in range(12)], "baseline string, sample_id int, delta double")
    a, b = (stats.bootstrap_ci(deltas, ("baseline",), "delta", "sample_id", *n).first() for n in ((), (5000,)))
    assert tuple(a) == tuple(b)
    assert {r.baseline for r in run(spark, "bootstrap_ci_whole")} <= {"M5", "M0", "M1", "M2", "M3"} and len(run(spark, "hvg_select_whole")) > 5 * 25


def test_ward_merges_a_plateau_down_to_k(spark):
    # every spot equal, in a chain with skips: the lowest id is each spot's first partner
    p = spark.createDataFrame([("s", i, [0.0]) for i in range(320)], "sample_id string, spot long, f array<double>")
    edges = spark.createDataFrame([("s", i, i + j) for i in range(320) for j in (1, 2) if i + j < 320], "sample_id string, a long, b long")
    every = edges.withColumn("cost", F.lit(0.0))
    assert cluster.ward_round(every).count() == 1 and cluster.ward_round(every, spread=True).count() > 32
    out = cluster.ward_fit(p, edges, 4, 1)
    assert out.count() == 320 and out.select("label").distinct().count() == 4


def test_communities_end_where_no_level_moves(spark):
    # a ring of 81 nodes wants levels of merging
    e = spark.createDataFrame([("s", i, (i + 1) % 81, 1.0) for i in range(81)], "sample_id string, src long, dst long, w double").select("sample_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
    q = lambda out: cluster.rb_modularity(e, out.select("sample_id", "spot", "label"), 1.0).first().modularity
    short, whole = cluster.community_fit(e, [1.0], 1, 2), cluster.community_fit(e, [1.0])
    assert q(whole) > q(short)
    # nothing is left: joining any two neighbouring communities does not raise it
    label = {r.spot: r.label for r in whole.collect()}
    for a, b in {(label[i], label[(i + 1) % 81]) for i in range(81)}:
        if a != b:
            na, nb = (sum(v == c for v in label.values()) for c in (a, b))
            between = sum({label[i], label[(i + 1) % 81]} == {a, b} for i in range(81))
            assert between - (2 * na) * (2 * nb) / (2 * 81) <= 1e-9


def test_resolution_search_narrows_to_exact_k(spark):
    edges = spark.createDataFrame([(s, i, i + 1, 1.0) for s in ("near", "between", "jump", "low") for i in range(12)], "sample_id string, src long, dst long, w double")
    asked = []

    def fit(e, grid):
        """So many labels as the resolution says: 6 only in a narrow range, never, or below the candidates."""
        asked.append({r.sample_id: r["count"] for r in grid.groupBy("sample_id").count().collect()})
        g = F.col("gamma")
        n = F.when(F.col("sample_id") == "near", F.when(g < 0.3, 2).when(g < 0.9, 5).when(g < 3, 6).otherwise(9))
        n = n.when(F.col("sample_id") == "between", F.when(g < 0.7321, 3).when(g < 0.7322, 6).otherwise(12)).when(F.col("sample_id") == "jump", F.when(g < 0.3, 4).otherwise(8))
        n = n.otherwise(F.when(g < 0.006, 6).otherwise(9))
        spots = e.select("sample_id", F.col("src").alias("spot")).distinct()
        return spots.join(grid, "sample_id").select("sample_id", "gamma", "spot", (F.col("spot") % n).alias("label"))

    choice, labels = cluster.resolution_search(edges, 6, fit)
    rows = {r.sample_id: r for r in choice.collect()}
    assert rows["near"].gamma == 1.0 and rows["near"].exact and asked[0]["near"] == 10 and all("near" not in a for a in asked[1:])
    assert rows["between"].exact and 0.7321 <= rows["between"].gamma < 0.7322
    assert rows["low"].exact and rows["low"].gamma < 0.006 and asked[1]["low"] == 90
    assert not rows["jump"].exact and rows["jump"].n_labels == 4 and asked[-1] == {"jump": 60} and len(asked) == 8
    got = {r.sample_id: (r.n, r.spots) for r in labels.groupBy("sample_id").agg(F.countDistinct("label").alias("n"), F.count("*").alias("spots")).collect()}
    assert got == {s: (r.n_labels, 12) for s, r in rows.items()}


def test_resolution_search_over_communities(spark):
    e = spark.createDataFrame([("s", a, b, 1.0) for a, b in ((0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3))], "sample_id string, src long, dst long, w double")
    choice, labels = cluster.resolution_search(e, 2)
    r = choice.first()
    assert r.exact and r.n_labels == 2 and labels.count() == 6 and labels.select("label").distinct().count() == 2


def test_bandwidth_is_found_outside_the_first_bounds(spark):
    r = np.random.default_rng(2)
    places = {
        # two tight clumps far apart, spots on one line, and spots too far apart for any length
        "clumps": [tuple(c + r.random(2) * 0.5) for c in (0.0, 9000.0) for _ in range(20)],
        "line": [(3.0 * i, 5.0) for i in range(30)],
        "far": [(50000.0 * i, 70000.0 * (i % 3)) for i in range(12)],
    }
    rows = [(s, i, float(x), float(y)) for s, ps in places.items() for i, (x, y) in enumerate(ps)]
    got = {q.sample_id: q for q in graph.bandwidth_search(spark.createDataFrame(rows, "sample_id string, spot long, x double, y double"), 0.5).collect()}
    for s, ps in places.items():
        p = np.array(ps)
        d2 = ((p[:, None] - p[None]) ** 2).sum(-1)
        if s == "far":
            assert got[s].l == pytest.approx(np.quantile(np.sqrt(d2[d2 > 0]), 0.05))
        else:
            assert np.exp(-d2 / (2 * got[s].l ** 2)).sum() / len(p) - 1 == pytest.approx(0.5, abs=0.01)
