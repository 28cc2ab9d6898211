"""What a task or a search takes must not grow with the number of rows that share it."""

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlattice.operators import compare, graph, normalize, stats
from spotlattice.operators.lineage import cut
from spotlattice.plans import q_ledger, views

DIR = "/root/testdata/sf0.001"


def test_rounds_are_hashed_once_for_all_groups(spark):
    sizes = {0: 1, 1: 2, 2: 37, 3: 500, 4: 501}
    rows = spark.createDataFrame([(g, i, float((i * 7919) % 1009)) for g, n in sizes.items() for i in range(n)], "g int, o int, x double")
    medians = stats._medians(stats._indexed(rows, ("g",), "x", "o"), ("g",), 20, 11)
    plan = medians._jdf.queryExecution().optimizedPlan().toString()
    assert "array_max(sizes" in plan and plan.count("md5") == 1
    got = {(r.g, r.b): r.m for r in medians.collect()}
    assert len(got) == 20 * len(sizes)
    for (g, b), m in got.items():
        n = sizes[g]
        x = sorted(float((i * 7919) % 1009) for i in range(n))
        drawn = [int(hashlib.md5(f"11|{b}|{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)]
        assert m == np.median([x[i] for i in drawn])


def test_spots_about_one_pixel_share_a_patch(spark):
    pixels = spark.range(100 * 100).select((F.col("id") % 100).alias("px"), F.floor(F.col("id") / 100).alias("py"), (F.col("id") * 31 % 17 + 0.5).alias("gray"))
    spots = spark.range(200_000).select(F.lit("s").alias("sample_id"), F.col("id").alias("spot"), (50.0 + F.col("id") % 2).alias("x"), F.lit(50.2).alias("y"))
    start = time.perf_counter()
    out = compare.patch_features(spots, pixels)
    one = out.drop("spot").distinct().collect()
    # one search a spot would meet 480 million pixels
    assert time.perf_counter() - start < 60 and len(one) == 2 and out.count() == 200_000
    few = compare.patch_features(spots.filter("spot < 2"), pixels).drop("spot").collect()
    assert sorted(map(str, one)) == sorted(map(str, few))


def test_tasks_of_the_counts_grow_with_the_lines(spark, monkeypatch):
    lines = views.view(spark, DIR, "lineitem").count()
    monkeypatch.setattr(views, "PER_TASK", 100)
    counts = views.view(spark, DIR, "counts")
    assert counts.rdd.getNumPartitions() == -(-lines // 100)
    by_sql = spark.sql(views.VIEWS["counts"], **{x: views.view(spark, DIR, x) for x in ("orders", "lineitem", "spots")})
    rows = lambda df: sorted(map(tuple, df.select("sample_id", "spot", "gene", "n").collect()))
    want = rows(by_sql)
    assert rows(counts) == want
    for query in (q_ledger.mtx_read, q_ledger.csc_to_triplets):
        assert rows(query(spark, DIR)) == want


def test_a_sample_is_written_in_several_files(spark, monkeypatch):
    monkeypatch.setattr(views, "PER_TASK", 1000)
    out = q_ledger.mtx_read(spark, DIR)
    per_sample = [sum(f"sample_id={s}/" in f for f in out.inputFiles()) for s in ("ASIA", "EUROPE")]
    assert min(per_sample) > 1


def test_rounds_of_the_components_do_not_read_the_spots(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(normalize, "cut", lambda df: passes.append(df) or cut(df))
    x = np.random.default_rng(1).random((40, 45))
    e = spark.createDataFrame([(s, i, 7 * j, float(x[i, j]) * k) for k, s in ((1, "a"), (2, "b")) for i in range(40) for j in range(45)], "sample_id string, spot long, gene long, v double")
    _, variance = normalize.pca(e, e.select("sample_id", "spot").distinct())
    got = {(r.sample_id, r.part): r.variance for r in variance.collect()}
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:20]
    for k, s in ((1, "a"), (2, "b")):
        assert np.allclose([got[s, i] for i in range(20)], want * k * k, rtol=1e-6)
    # one round more read the spots once more
    assert len(passes) <= 3


def test_affinities_of_near_spots_are_never_rows(spark, monkeypatch):
    r = np.random.default_rng(2)
    at = {"wide": r.uniform(0, 50, (400, 2)), "clump": np.concatenate([r.normal(0, 0.1, (300, 2)), r.uniform(0, 50, (50, 2))]), "equal": np.zeros((90, 2)), "one": np.ones((1, 2))}
    spots = spark.createDataFrame([(s, i, float(x), float(y)) for s, p in at.items() for i, (x, y) in enumerate(p)], "sample_id string, spot long, x double, y double")
    monkeypatch.setattr(graph, "_SUMMED", 16)
    out = graph.affinity_mass(spots, [0.5, 2.0])
    got = {(q.sample_id, q.l): q.mass for q in out.collect()}
    for s, p in at.items():
        d2 = ((p[:, None] - p) ** 2).sum(2)
        for length in (0.5, 2.0):
            want = np.where(d2 <= 36 * length * length, np.exp(-d2 / (2 * length * length)), 0.0).sum() / len(p) - 1
            assert abs(got[s, length] - want) < 1e-9
    assert len(got) == 2 * len(at)
    monkeypatch.setattr(graph, "_SUMMED", 4096)
    start = time.perf_counter()
    many = spark.range(60_000).select(F.lit("s").alias("sample_id"), F.col("id").alias("spot"), (F.col("id") % 251 / 251).alias("x"), (F.col("id") % 257 / 257).alias("y"))
    # 3.6 thousand million pairs
    assert graph.affinity_mass(many, [10.0]).first().mass > 59_000 and time.perf_counter() - start < 240


def test_pairs_of_the_bandwidth_search_are_never_rows(spark, monkeypatch):
    rows = []
    monkeypatch.setattr(graph, "cut", lambda df: rows.append((out := cut(df)).count()) or out)
    p = np.random.default_rng(3).random((900, 2)) * 100
    p[:15] = p[0] + p[:15] / 1e4
    monkeypatch.setattr(graph, "_MET", 16, raising=False)
    spots = spark.createDataFrame([("s", i, float(x), float(y)) for i, (x, y) in enumerate(p)], "sample_id string, spot long, x double, y double")
    got = graph.bandwidth_search(spots, 0.5).first()
    assert max(rows) <= 900
    d2 = ((p[:, None] - p[None]) ** 2).sum(-1)
    assert np.exp(-d2 / (2 * got.l**2)).sum() / len(p) - 1 == pytest.approx(got.mass, abs=1e-6)
    near = graph._within(spots, spark.createDataFrame([("s", 20.0)], "sample_id string, c double")).collect()
    found = np.sort(np.concatenate([np.frombuffer(r.d2) for r in near]))
    want = np.sort(d2[np.triu_indices(900, 1)])
    assert np.allclose(found, want[want <= 400.0])
