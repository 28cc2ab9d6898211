"""Distributed order within groups, against windows and full enumeration."""

import itertools
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spotlattice.operators import ranks, stats


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    some = [("big", float(r.randint(0, 40)), i) for i in range(3000)] + [("small", 1.0, 5000), ("small", 1.0, 5001)] + [(None, float(i % 3), 6000 + i) for i in range(7)]
    return spark.createDataFrame(some, "g string, v double, id long")


@pytest.fixture(params=[0, 1_000_000])
def one_task(request, monkeypatch):
    monkeypatch.setattr(ranks, "ONE_TASK", request.param)


def test_ranks_equal_the_window(spark, rows, one_task):
    w = Window.partitionBy("g").orderBy("v")
    want = rows.select("g", "v", (F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy("g", "v")) - 1) / 2.0).alias("mid")).distinct()
    got = ranks.distinct_ranks(rows, ("g",), F.col("v")).select("g", F.col("x").alias("v"), "mid")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    want = rows.select("g", "id", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")).alias("n"))
    got = ranks.numbered(rows, ("g",), ("v", "id")).select("g", "id", (F.col("before") + 1).alias("n"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {(r.g, r.total) for r in ranks.numbered(rows, ("g",), ("v", "id")).collect()} == {("big", 3000), ("small", 2), (None, 7)}
    assert ranks.numbered(rows.limit(0), ("g",), ("v", "id")).count() == 0


def test_one_group_lies_in_many_parts(spark, rows):
    """No task sorts a whole group: the rows of one group are dealt by ranges, evenly."""
    big = ranks._dealt(rows.filter("g = 'big'"), ("g",), ("v", "id"))
    sizes = [r["count"] for r in big.groupBy("_part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 3000 / 4


def test_false_discovery_equals_the_window(spark, rows, one_task):
    p = rows.select("g", "id", (F.col("v") / 41.0).alias("p")).unionByName(spark.createDataFrame([("big", 9000, None)], "g string, id long, p double"))
    w = Window.partitionBy("g").orderBy("p", "id")
    some = p.filter("p IS NOT NULL").withColumn("raw", F.col("p") * F.count("p").over(Window.partitionBy("g")) / F.row_number().over(w))
    want = some.withColumn("q", F.least(F.lit(1.0), F.min("raw").over(w.rowsBetween(0, Window.unboundedFollowing)))).select("g", "id", F.round("q", 12).alias("q"))
    got = stats.bh_fdr(p, ("g",), "p", "id").select("g", "id", F.round("q", 12).alias("q"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def _enumerated(m, n):
    """P(U <= u) for every u by all choices of ranks."""
    counts = {}
    for chosen in itertools.combinations(range(m + n), m):
        u = sum(chosen) - m * (m - 1) // 2
        counts[u] = counts.get(u, 0) + 1
    total = sum(counts.values())
    return {u: sum(c for v, c in counts.items() if v <= u) / total for u in range(m * n + 1)}


def test_rank_sums_are_counted_exactly():
    for m in range(1, 9):
        for n in range(m, 9):
            want = _enumerated(m, n)
            for u in range(m * n // 2 + 1):
                assert stats.rank_sum_tail(m, n, u) == pytest.approx(want[u], abs=1e-14)
    # the middle of a long side: the distribution is symmetric about an attained value
    assert stats.rank_sum_tail(8, 5000, 8 * 5000 // 2) > 0.5 > stats.rank_sum_tail(8, 5000, 8 * 5000 // 2 - 1)


def test_small_sides_without_ties_take_the_exact_distribution(spark):
    def of(first, second, **kw):
        df = spark.createDataFrame([("g", True, float(x)) for x in first] + [("g", False, float(x)) for x in second], "g string, side boolean, v double")
        return stats.mann_whitney(df, ("g",), "side", "v", **kw).first()

    # U = 2 of 5 x 4: 4 of 126 orders give 2 or less
    r = of((1, 2, 3, 5, 7), (4, 8, 9, 10))
    assert (r.u, r.p) == (2.0, pytest.approx(2 * 4 / 126))
    tied = of((1, 2, 3, 5, 8), (4, 8, 9, 10))
    assert tied.p == pytest.approx(of((1, 2, 3, 5, 8), (4, 8, 9, 10), exact_side=0).p)
    large = of(range(0, 40, 2), range(1, 41, 2))
    assert large.p == pytest.approx(of(range(0, 40, 2), range(1, 41, 2), exact_side=0).p)
    assert of((1, 2, 3), range(10, 60)).p == pytest.approx(2 * 6 / (53 * 52 * 51))
    alone = of((1, 2), ())
    assert (alone.n1, alone.n2, alone.z, alone.p) == (2, 0, None, 1.0)


def test_quantiles_equal_percentile(spark, rows, one_task):
    some = rows.unionByName(spark.createDataFrame([("big", None, 1), ("none", None, 2), ("one", 3.5, 3)], "g string, v double, id long"))
    shares = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.975, "e": 1.0}
    want = some.filter("v IS NOT NULL").groupBy("g").agg(*(F.percentile("v", s).alias(c) for c, s in shares.items()))
    show = lambda df: sorted(str([r.g, *(None if r[c] is None else round(r[c], 12) for c in shares)]) for r in df.collect())
    assert show(ranks.quantiles(some, ("g",), "v", shares)) == show(want)
