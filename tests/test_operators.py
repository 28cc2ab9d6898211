"""Hand fixtures with literal answers, invariants, and the streaming sink."""

import math

import pytest
from pyspark.sql import functions as F

from spotlattice.functions.expr import erfc, normal_tail
from spotlattice.functions.parse import config, first_integer, noted_count
from spotlattice.operators import claims, cluster, compare, graph, ledger, metrics, normalize, stats
from spotlattice.sources import io
from spotlattice.streaming import ledger_sink

SPOTS = [(0, 0, 0), (1, 1, 0), (2, 2.1, 0), (3, 3.3, 0), (4, 0, 1.4), (5, 1, 1.5), (6, 2.1, 1.6), (7, 3.3, 1.7), (8, 0, 3.1), (9, 1, 3.3)]
LABELS = [1, 1, 2, 2, 1, 1, 2, 2, 3, 3]


@pytest.fixture(scope="module")
def spots(spark):
    return spark.createDataFrame([("s", i, float(x), float(y)) for i, x, y in SPOTS], "sample_id string, spot long, x double, y double")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([("s", i, k) for i, k in enumerate(LABELS)], "sample_id string, spot long, label int")


@pytest.fixture(scope="module")
def counts(spark):
    dense = [[5, 0, 5], [0, 0, 0], [1, 3, 0], [0, 10, 0]]
    return spark.createDataFrame([("s", i, g, n) for i, row in enumerate(dense) for g, n in enumerate(row) if n], "sample_id string, spot long, gene long, n long")


def test_normal_tail(spark):
    z = [0.0, 0.3, 1.0, 1.99, 2.0, 2.5, 4.0, 6.0, 9.0]
    rows = spark.createDataFrame([(x,) for x in z], "z double").select("z", erfc(F.col("z")).alias("e"), normal_tail(-F.col("z")).alias("t")).collect()
    for r in rows:
        assert r.e == pytest.approx(math.erfc(r.z), rel=1e-12)
        assert r.t == pytest.approx(1 - math.erfc(r.z / math.sqrt(2)) / 2, rel=1e-12)


def test_normalisation(spark, counts):
    four = spark.createDataFrame([("s", i) for i in range(4)], "sample_id string, spot long")
    sizes = {r.spot: r.size for r in normalize.library_size(counts, four).collect()}
    assert sizes == {0: 10, 1: 1, 2: 4, 3: 10}
    v = {(r.spot, r.gene): r.v for r in normalize.lognorm(counts).collect()}
    assert v[0, 0] == pytest.approx(8.517393, abs=1e-6) and v[2, 1] == pytest.approx(8.922792, abs=1e-6) and v[3, 1] == pytest.approx(9.210440, abs=1e-6)
    top = normalize.hvg_select(normalize.lognorm(counts), four, 3).orderBy("rank").collect()
    assert [r.gene for r in top] == [1, 0, 2]
    assert [r.variance for r in top] == pytest.approx([20.561224, 16.751004, 13.602372], abs=1e-5)


def test_pca_against_numpy(spark):
    import numpy as np

    x = np.random.default_rng(3).random((30, 6)) * np.array([5, 3, 2, 1, 1, 1])
    e = spark.createDataFrame([("s", i, j, float(x[i, j])) for i in range(30) for j in range(6)], "sample_id string, spot long, gene long, v double")
    _, variance = normalize.pca(e, e.select("sample_id", "spot").distinct(), parts=2, rounds=12)
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:2]
    assert sorted((r.variance for r in variance.collect()), reverse=True) == pytest.approx(want.tolist(), rel=1e-3)


def test_graphs(spots, labels):
    near = graph.knn(spots, 7).filter("spot = 0").orderBy("rank").collect()
    assert [r.other for r in near] == [1, 4, 5, 2, 6, 8, 3]
    ring = graph.coherence_neighbours(spots)
    assert metrics.agreement(ring, labels).first().coherence == pytest.approx(0.30)
    one = graph.knn(spots, 6).select("sample_id", F.col("spot").alias("src"), F.col("other").alias("dst"))
    assert metrics.agreement(one, labels).first().coherence == pytest.approx(0.4333, abs=1e-4)
    assert graph.undirected(ring).count() == 37
    edge = metrics.boundary(graph.knn(spots, 2), labels).filter("is_boundary = 1")
    assert {r.spot for r in edge.collect()} == {1, 2, 5, 6, 8, 9}


def test_knn_equals_brute_force_at_any_partitioning(spark):
    import random

    r = random.Random(5)
    rows = [("a", i, r.random() ** 3 * 100, r.random() * 10) for i in range(300)] + [("b", 1000 + i, float(i % 5), float(i // 5)) for i in range(40)] + [("c", 5000, 0.0, 0.0), ("c", 5001, 9.0, 9.0)]
    want = set()
    for s, i, x, y in rows:
        others = sorted(((x - u) * (x - u) + (y - v) * (y - v), j) for t, j, u, v in rows if t == s and j != i)[:5]
        want |= {(s, i, j, k + 1) for k, (_, j) in enumerate(others)}
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "sample_id string, spot long, x double, y double").repartition(parts)
        assert {(q.sample_id, q.spot, q.other, q.rank) for q in graph.knn(df, 5).collect()} == want


def test_rand_index(spark):
    def ari(a, b):
        df = spark.createDataFrame([("s", x, y) for x, y in zip(a, b)], "sample_id string, la int, lb int")
        return metrics.ari_of(df, ("sample_id",)).first().ari

    assert ari([0, 0, 1, 1], [0, 0, 1, 2]) == pytest.approx(0.5714285714)
    assert ari([0, 0, 1, 1, 2, 2], [0, 0, 1, 2, 2, 2]) == pytest.approx(0.4444444444)
    assert ari([0, 0, 1, 1], [1, 1, 0, 0]) == 1.0
    assert ari([0, 0], [1, 1]) == 1.0


def test_rank_tests(spark):
    d = spark.createDataFrame([("g", x) for x in (0.1, 0.2, -0.05, 0.3, 0.15, 0.0, 0.2)], "g string, delta double")
    r = stats.wilcoxon(d, ("g",)).first()
    assert (r.v, r.z, r.p) == pytest.approx((20, 1.8921179924, 0.0584752616), abs=1e-9)
    d = spark.createDataFrame([("g", x) for x in (0.7, 0.65, 0.5, 0.8, 0.6, 0.72)], "g string, delta double")
    r = stats.wilcoxon(d, ("g",), "delta", "greater", 0.6).first()
    assert (r.v, r.p) == pytest.approx((12.5, 0.1114004956), abs=1e-9)
    b, a = (1, 2, 2, 5, 6, 7, 8, 9, 9, 10), (0, 0, 1, 2, 3, 3, 4, 4, 5, 2)
    d = spark.createDataFrame([("g", True, float(x)) for x in b] + [("g", False, float(x)) for x in a], "g string, side boolean, v double")
    r = stats.mann_whitney(d, ("g",), "side", "v").first()
    assert (r.u, r.z, r.p) == pytest.approx((80, 2.2435261168, 0.0248629076), abs=1e-9)


def test_false_discovery(spark):
    d = spark.createDataFrame([("f", i, p) for i, p in enumerate((0.01, 0.04, 0.03, 0.005))], "f string, id int, p double")
    assert [r.q for r in stats.bh_fdr(d, ("f",), "p", "id").orderBy("id").collect()] == pytest.approx([0.02, 0.04, 0.04, 0.02])


def test_gradient(spark):
    g = [[0, 0, 0, 0], [0, 10, 20, 0], [0, 30, 50, 0], [0, 0, 0, 0]]
    px = spark.createDataFrame([(x, y, float(v)) for y, row in enumerate(g) for x, v in enumerate(row)], "px long, py long, gray double")
    got = {(r.py, r.px): r.grad for r in compare.image_gradient(px).collect()}
    assert [got[1, 1], got[1, 2], got[2, 1], got[2, 2]] == pytest.approx([18.027756, 25.495098, 25.495098, 18.027756], abs=1e-6)


def test_modularity_and_communities(spark):
    e = spark.createDataFrame([("s", a, b, 1.0) for a, b in ((0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3))], "sample_id string, src long, dst long, w double")
    l = spark.createDataFrame([("s", i, i // 3) for i in range(6)], "sample_id string, spot long, label int")  # noqa: E741
    assert cluster.rb_modularity(e, l, 1.0).first().modularity == pytest.approx(2.5)
    found = cluster.community_fit(e, [1.0], levels=2, rounds=6)
    assert found.count() == 6
    # every node alone gives -1.75 and one community for all gives 0
    assert cluster.rb_modularity(e, found.select("sample_id", "spot", "label"), 1.0).first().modularity > 1.0


def test_ward_and_kmeans_give_k_labels(spark, spots):
    p = spots.withColumn("f", F.array("x", "y"))
    out = cluster.ward_fit(p, graph.undirected(graph.symmetric_graph(graph.knn(p, 3), p)), 3, 2)
    assert out.select("label").distinct().count() == 3 and out.count() == 10
    plan = spark.createDataFrame([(2, 11)], "K int, seed int")
    labels, best = cluster.kmeans_fit(p, plan, 2, inits=2, rounds=5)
    assert labels.count() == 10 and best.first().n_labels == 2


def test_readers(spark, tmp_path):
    lines = ["%%MatrixMarket matrix coordinate integer general", "%meta", "3 2 3", "1 1 5", "3 1 2", "2 2 7"]
    (tmp_path / "m.mtx").write_text("\n".join(lines) + "\n")
    triplets, sizes = io.read_mtx(spark, f"file://{tmp_path}/m.mtx")
    assert {(r.gene, r.spot, r.n) for r in triplets.collect()} == {(0, 0, 5), (2, 0, 2), (1, 1, 7)}
    assert sizes.first()[1:] == (3, 2, 3)
    csc = spark.createDataFrame([("s", [5, 2, 7], [0, 2, 1], [0, 2, 3])], "sample_id string, data array<int>, indices array<int>, indptr array<bigint>")
    assert {(r.gene, r.spot, r.n) for r in io.csc_to_triplets(csc).collect()} == {(0, 0, 5), (2, 0, 2), (1, 1, 7)}
    (tmp_path / "t.tsv").write_text("a\tb\n1\tNA\nnan\tx\n\t2\n")
    assert [tuple(r) for r in io.read_tsv(spark, f"file://{tmp_path}/t.tsv").collect()] == [("1", None), (None, "x"), (None, "2")]
    (tmp_path / "p.csv").write_text("barcode,in_tissue,array_row,array_col,pxl_row_in_fullres,pxl_col_in_fullres\nA,1,0,0,5.5,6.5\nB,0,1,1,7,8\n")
    p = io.read_positions(spark, f"file://{tmp_path}/p.csv")
    spots = io.align(p, spark.createDataFrame([("A", 0), ("B", 1)], "barcode string, spot_idx int")).collect()
    assert [(r.barcode, r.spot_idx, r.x, r.y) for r in spots] == [("A", 0, 6.5, 5.5)]


def test_selection(spark):
    found = spark.createDataFrame([("b",), ("a",), ("c",)], "sample_id string")
    chosen, missing = io.select_samples(found, ["c", "x", "a"])
    assert [r.sample_id for r in chosen.collect()] == ["c", "a"] and [r.sample_id for r in missing.collect()] == ["x"]
    assert [r.sample_id for r in io.select_samples(found, most=2)[0].collect()] == ["a", "b"]


def test_parsers(spark):
    df = spark.createDataFrame([("run -12 of 3", "x n=4 n_samples=9", "spagcn_p0.45"), ("none", "n_sample_k=7", "stagate_d30_e500")], "a string, b string, c string")
    out = df.select(first_integer(F.col("a")), noted_count(F.col("b")), *config(F.col("c")).values()).collect()
    assert tuple(out[0]) == (-12, 9, "spagcn", None, None, 0.45) and tuple(out[1]) == (None, 7, "stagate", 30, 500, None)


def test_ledger_stream_adds_each_row_once(spark, tmp_path):
    base, source = f"file://{tmp_path}/ledger", f"file://{tmp_path}/in"
    spark.createDataFrame([("a", 1)], "k string, v long").write.parquet(base)
    spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), ("c", None)], "k string, v long").write.parquet(source)
    for i in range(2):
        stream = spark.readStream.schema("k string, v long").parquet(source)
        ledger_sink.start(stream, base, f"file://{tmp_path}/check{i}").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(base).collect()), key=str) == [("a", 1), ("b", 2), ("c", None)]


def test_missing_baseline_fails_all_gates(spark):
    units = spark.createDataFrame([("n1", "focal", 4, 1.0), ("n1", "M5", 4, 0.5), ("n2", "focal", 4, 1.0), ("n2", "M5", 4, 0.25)], "sample_id string, method_id string, K int, coherence double")
    families = spark.createDataFrame([("M5", "F1"), ("M2", "F1_ext")], "baseline string, family string")
    rows = {r.baseline: r for r in claims.gate_c1(units, "focal", families, "coherence", 20).collect()}
    assert rows["M2"].effect_median is None and not rows["M2"].gate_overall and rows["M2"].tier == "not supported"
    assert rows["M5"].effect_median == pytest.approx(0.625) and rows["M5"].coverage == 1.0


def test_lock_prefers_seeds_then_later_rows(spark):
    rows = [("d", "s", "m", 4, n, note, i) for i, (n, note) in enumerate([(2, "rigor-backfill"), (3, "draft"), (2, "stage3a-full-replication x"), (1, "rigor-backfill")])]
    df = spark.createDataFrame(rows, "dataset_id string, sample_id string, method_id string, K int, seed_count int, notes string, ingest_seq long")
    assert [r.ingest_seq for r in ledger.lock_rows(df).collect()] == [2]
