"""k-means of many groups: seeding against hash starts, settled clusters, few and equal points."""

import hashlib

import numpy as np
import pytest

from spotlattice.operators import cluster
from spotlattice.operators.lineage import cut

BLOBS = {
    "even": (np.random.default_rng(1), [(12, 0, 60), (0, 12, 60), (-12, 0, 60), (0, -12, 60), (25, 25, 60), (-25, 25, 60)]),
    "uneven": (np.random.default_rng(2), [(0, 0, 300), (30, 0, 8), (0, 30, 8), (30, 30, 8), (60, 0, 8), (0, 60, 8)]),
    "line": (np.random.default_rng(3), [(10 * i, 0, 40) for i in range(6)]),
}


def points_of():
    out = {}
    for name, (r, blobs) in BLOBS.items():
        out[name] = np.vstack([r.normal((x, y), 1.0, (n, 2)) for x, y, n in blobs])
    return out


def lloyd(x, c):
    while True:
        label = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        new = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(len(c))])
        if ((new - c) ** 2).sum(1).max() <= 1e-12:
            return ((x - new[label]) ** 2).sum()
        c = new


def hash_starts(x, k, seed, inits=10):
    """Inertia of the best of ten starts at the k points of least hash."""
    name = lambda t, i: hashlib.md5(f"{seed}|{t}|{i}".encode()).hexdigest()
    return min(lloyd(x, x[sorted(range(len(x)), key=lambda i: name(t, i))[:k]]) for t in range(inits))  # noqa: B023


@pytest.fixture(scope="module")
def fitted(spark):
    data = points_of()
    rows = [(s, i, v.tolist()) for s, x in data.items() for i, v in enumerate(x)] + [("few", i, [float(i), 0.0]) for i in range(3)] + [("same", i, [1.0, 2.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "sample_id string, spot long, f array<double>").repartition(3)
    plan = spark.createDataFrame([(6, 11), (6, 23), (2, 11)], "K int, seed int")
    labels, best = cluster.kmeans_fit(df, plan, 2)
    return data, labels.toPandas(), best.toPandas()


def test_never_worse_than_hash_starts(fitted):
    data, _, best = fitted
    for name, x in data.items():
        for seed in (11, 23):
            got = best[(best.sample_id == name) & (best.K == 6) & (best.seed == seed)].inertia.iloc[0]
            assert got <= hash_starts(x, 6, seed) + 1e-6


def test_clusters_are_settled(fitted):
    data, labels, best = fitted
    assert best.converged.all()
    for (name, k, seed), g in labels[labels.sample_id.isin(list(data))].groupby(["sample_id", "K", "seed"]):
        x = data[name][g.spot.to_numpy()]
        label = g.label.to_numpy()
        c = np.array([x[label == j].mean(0) for j in range(k)])
        assert len(g) == len(data[name]) and (((x[:, None] - c) ** 2).sum(2).argmin(1) == label).all()
        one = best[(best.sample_id == name) & (best.K == k) & (best.seed == seed)].iloc[0]
        assert one.inertia == pytest.approx(((x - c[label]) ** 2).sum()) and one.n_labels == k


def test_few_and_equal_points(fitted):
    _, labels, best = fitted
    few = best[best.sample_id == "few"].set_index(["K", "seed"])
    assert few.loc[(6, 11)].inertia == 0 and few.loc[(6, 11)].n_labels == 3 and few.loc[(2, 11)].n_labels == 2
    same = best[best.sample_id == "same"]
    assert (same.inertia == 0).all() and (labels[labels.sample_id == "same"].groupby(["K", "seed"]).size() == 20).all()


def test_rows_of_a_round_do_not_grow_with_the_points(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(600, 2))
    points = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "sample_id string, spot long, f array<double>").coalesce(1)
    monkeypatch.setattr(cluster, "_BLOCK", 8)
    blocks = cut(cluster._packed(points, 2))
    assert blocks.count() == 75
    centres = spark.createDataFrame([("s", k, 11, 0, x[:k].ravel().tolist()) for k in (2, 3)], "sample_id string, K int, seed int, init int, c array<double>")
    rows = cluster._totals(blocks.coalesce(1), centres, 2).collect()
    assert sorted(r.K for r in rows) == [2, 3]
    for r in rows:
        label = ((x[:, None] - x[: r.K]) ** 2).sum(2).argmin(1)
        assert r.n == [(label == j).sum() for j in range(r.K)]
        assert np.allclose(np.reshape(r.total, (r.K, 2)), [x[label == j].sum(0) for j in range(r.K)])
