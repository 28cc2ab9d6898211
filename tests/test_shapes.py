"""Published numbers of the gate, and shapes of input on which a plan could go wrong."""

import itertools
import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlattice.functions.expr import erfc, normal_tail
from spotlattice.operators import claims, graph, metrics, normalize, stats
from spotlattice.sources import io

# Published paired differences of 13 samples, averaged over both numbers of clusters.
DELTAS = {
    ("M5", "coherence"): [-0.008185951, 0.096686409, 0.075603402, 0.113128265, 0.109449777, 0.044041317, 0.057668760, 0.081736656, 0.025253469, 0.069336925, 0.039291230, 0.039364318, 0.012545697],
    ("M5", "marker"): [0.521661497, 0.606368916, 0.410090879, 0.400870001, 0.186818101, 0.036459340, 0.174239210, 0.260212524, 0.150241940, 0.799405991, 0.078218389, -0.004218027, -0.326885273],
    ("M0", "coherence"): [0.093129049, 0.251048409, 0.228676402, 0.299678265, 0.320288277, 0.132496817, 0.148977760, 0.299453156, 0.150097469, 0.200976425, 0.126571730, 0.126423818, 0.080632697],
    ("M0", "marker"): [0.560330997, 0.534735916, 0.422186379, 0.352942001, 0.181901601, -0.007087660, 0.157974710, 0.191987024, 0.144404940, 0.678214991, -0.020532111, -0.070458527, -0.336951273],
    ("M1", "coherence"): [0.093164049, 0.250275409, 0.226660402, 0.300588765, 0.317329777, 0.132597817, 0.147972260, 0.298574656, 0.149741469, 0.201169925, 0.126844230, 0.126423318, 0.080614197],
    ("M1", "marker"): [0.559802497, 0.533713416, 0.422321879, 0.352401501, 0.180051101, -0.008545160, 0.155666710, 0.188971524, 0.144681440, 0.678516491, -0.020735111, -0.071057027, -0.337129773],
}
# The published p value, q value within the family, median, direction and tier of each.
GATE = {
    ("M5", "coherence"): (0.00210524537077069, 0.00421049074154137, 0.057668760, 12 / 13, "supported"),
    ("M5", "marker"): (0.0118734386660867, 0.0118734386660867, 0.186818101, 11 / 13, "supported"),
    ("M0", "coherence"): (0.00166169445798351, 0.00332338891596702, 0.150097469, 1.0, "supported"),
    ("M0", "marker"): (0.0302764098686474, 0.0302764098686474, 0.181901601, 9 / 13, "not supported"),
    ("M1", "coherence"): (0.00166169445798351, 0.00332338891596702, 0.149741469, 1.0, "supported"),
    ("M1", "marker"): (0.0302764098686474, 0.0302764098686474, 0.180051101, 9 / 13, "not supported"),
}


def test_published_gate(spark):
    """Two endpoints make a family of two tests, with two baselines of four."""
    rows = [(b, m, i, v) for (b, m), vs in DELTAS.items() for i, v in enumerate(vs)]
    deltas = spark.createDataFrame(rows, "baseline string, metric string, sample_id int, delta double")
    families = claims.families_table(spark).filter(F.col("baseline").isin("M5", "M0", "M1", "M4")).withColumn("metric", F.explode(F.array(F.lit("coherence"), F.lit("marker"))))
    got = {(r.baseline, r.metric): r for r in claims.gate_deltas(deltas, families, spark.createDataFrame([(13,)], "n_target long"), rounds=200).collect()}
    for at, (p, q, median, direction, tier) in GATE.items():
        r = got[at]
        assert (r.p_value, r.q_value, r.effect_median, r.direction_consistency, r.coverage) == pytest.approx((p, q, median, direction, 1.0), rel=1e-6)
        assert r.tier == tier and r.decision == ("pass" if tier == "supported" else "fail") and r.ci_low <= r.effect_median <= r.ci_high
    assert got["M4", "marker"].tier == "not supported" and got["M4", "marker"].n_samples is None and len(got) == 8


def test_pca_with_spots_without_counts_and_few_genes(spark):
    r = np.random.default_rng(5)
    for spots, genes, empty in ((30, 6, 10), (8, 40, 3), (12, 2, 0)):
        x = r.random((spots, genes))
        x[:empty] = 0
        e = spark.createDataFrame([("s", i, j, float(x[i, j])) for i in range(spots) for j in range(genes) if x[i, j]], "sample_id string, spot long, gene long, v double")
        every = spark.createDataFrame([("s", i) for i in range(spots)], "sample_id string, spot long")
        scores, variance = normalize.pca(e, every)
        most = max(2, min(20, spots - 1, genes - 1))
        want = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:most]
        got = [q.variance for q in variance.orderBy("part").collect()]
        assert got == pytest.approx(want.tolist(), rel=1e-5, abs=1e-9) and scores.count() == spots
        f = np.array([q.f for q in scores.orderBy("spot").collect()])
        assert f.shape == (spots, most) and f.mean(axis=0) == pytest.approx(np.zeros(most), abs=1e-9)
        assert (f**2).sum(axis=1)[:empty] == pytest.approx([(f[0] ** 2).sum()] * empty)


def test_knn_with_an_outlier_equal_points_and_clumps(spark, monkeypatch):
    r = np.random.default_rng(0)
    places = {
        "far": [*map(tuple, r.uniform(0, 1, (1500, 2)).tolist()), (1e7, 1e7)],
        "equal": [(5.0, 5.0)] * 5000 + [(float(i), 7.0) for i in range(20)],
        "clumps": [tuple(p) for c in (0.0, 1000.0, 1010.0) for p in (r.normal(0, 1e-3, (300, 2)) + c).tolist()],
        "line": [(float(i * i), 3.0) for i in range(100)],
        "two": [(1.0, 1.0), (2.0, 2.0)],
    }
    rows = [(s, i, *p) for s, ps in places.items() for i, p in enumerate(ps)]
    spots = spark.createDataFrame(rows, "sample_id string, spot long, x double, y double").repartition(5)
    searched = []
    plain = graph._nearest
    monkeypatch.setattr(graph, "_nearest", lambda q, cells, k: searched.append(q.join(cells.groupBy("sample_id", "c", "cx", "cy").agg(F.sum(F.size("ids")).alias("n")).withColumnsRenamed({"cx": "px", "cy": "py"}), ["sample_id", "c"]).filter("abs(px - floor(x / c)) <= 1 AND abs(py - floor(y / c)) <= 1").agg(F.sum("n")).first()[0] or 0) or plain(q, cells, k))
    got = {}
    for q in graph.knn(spots, 5).orderBy("rank").collect():
        got.setdefault((q.sample_id, q.spot), []).append(q.other)
    for s, ps in places.items():
        p = np.array(ps)
        for i in range(0, len(p), 37):
            d2 = ((p - p[i]) ** 2).sum(axis=1)
            want = [int(j) for j in np.lexsort((np.arange(len(p)), d2)) if j != i][:5]
            assert got.get((s, i), []) == want, (s, i)
    assert sum(searched) < 150 * len(rows)  # pairs looked at; 5,000 equal points alone would give 25 million


def test_normal_tail_is_exact_and_generates_code(spark):
    import math

    z = [0.0, 0.3, 0.46875, 0.5, 1.0, 1.9, 2.5, 3.9, 4.0, 4.1, 6.0, 12.0, 25.0]
    df = spark.createDataFrame([(x,) for x in z], "z double")
    got = [r.e for r in df.select(erfc(F.col("z")).alias("e")).collect()]
    assert got == pytest.approx([math.erfc(x) for x in z], rel=2e-14)
    tail = [r.t for r in df.select(normal_tail(-F.col("z")).alias("t")).collect()]
    assert tail == pytest.approx([1 - math.erfc(x / math.sqrt(2)) / 2 for x in z], rel=1e-12)
    rows = df.select(F.lit("g").alias("g"), F.col("z").alias("delta"), (F.col("z") > 1).alias("side"))
    spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert stats.wilcoxon(rows, ("g",)).first().p < 0.01 and stats.mann_whitney(rows, ("g",), "side", "delta").first().p < 0.01
    finally:
        spark.conf.unset("spark.sql.codegen.factoryMode")
        spark.conf.unset("spark.sql.codegen.fallback")


def test_alignment_of_nine_labels(spark, monkeypatch):
    r = np.random.default_rng(4)
    k, spots = 9, 400
    ref = r.integers(0, k, spots)
    turned = r.permutation(k)
    cur = np.where(r.random(spots) < 0.6, turned[ref], r.integers(0, k, spots))
    rows = [("s", i, seed, int(x)) for seed, v in ((11, ref), (23, cur)) for i, x in enumerate(v)]
    labels = spark.createDataFrame(rows, "sample_id string, spot long, seed int, label int")
    got = {q.cur: q.ref for q in metrics.align(labels, 11, k).collect()}
    assert got == {int(c): i for i, c in enumerate(turned)}
    kept = [(a, b) for a, b in zip(ref, cur) if a < 4 and b < 4]
    best = min(itertools.permutations(range(4)), key=lambda p: (-sum(p[b] == a for a, b in kept), p))
    assert sorted((q.cur, q.ref) for q in metrics.align(labels.filter("label < 4"), 11, 4).collect()) == list(enumerate(best))


def test_discovery_of_the_three_layouts(spark):
    nested = ["a/raw/S1/filtered/matrix.mtx.gz", "a/raw/S1/filtered/barcodes.tsv.gz", "a/tissue_positions_list.csv", "b/raw/S5/filtered/matrix.mtx"]
    flat = ["S2_matrix.mtx.gz", "S2_barcodes.tsv.gz", "S2_tissue_positions_list.csv.gz"]
    h5 = ["S3_filtered_feature_bc_matrix.h5", "S3_tissue_positions.csv", "S3_tissue_positions_list.csv"]
    files = spark.createDataFrame([(f"file:/data/x/{p}",) for p in nested + flat + h5], "path string")
    got = {r.sample_id: (r.layout, r.matrix.rsplit("/", 1)[1]) for r in io.discover(files, "/data/x").collect()}
    assert got == {"S1": ("mtx", "matrix.mtx.gz"), "S2": ("flat", "S2_matrix.mtx.gz"), "S3": ("h5", "S3_filtered_feature_bc_matrix.h5")}  # S5 has no barcodes


def test_tsv_sink_fixes_the_columns_and_overwrites(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for n in (3, 2):
        io.write_tsv(spark.createDataFrame([(i, "NA" if i else "b", 1.5) for i in range(n)], "b int, a string, c double"), path, ["a", "b"])
    back = io.read_tsv(spark, path)
    assert back.columns == ["a", "b"] and sorted((r.a or "-", r.b) for r in back.collect()) == [("-", "1"), ("b", "0")]


def test_ledger_takes_each_row_once(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    rows = [(1, None, 0.5), (1, None, 0.5), (2, "x", None)]
    spark.createDataFrame(rows[:1], "k int, s string, v double").write.parquet(path)
    for _ in range(2):
        io.append_new(spark.createDataFrame(rows, "k int, s string, v double"), path)
    assert sorted((r.k, r.s) for r in spark.read.parquet(path).collect()) == [(1, None), (2, "x")]
