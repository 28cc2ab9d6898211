"""Assignment of labels: brute force for few, sums and order for many."""

import itertools
import random

import numpy as np
import pytest

from spotlattice.operators import metrics


def brute(table):
    return min(itertools.permutations(range(len(table))), key=lambda p: (-sum(table[i][j] for i, j in enumerate(p)), p))


def test_first_best_assignment_equals_brute_force():
    r = random.Random(3)
    for k in range(1, 8):
        for most in (1, 2, 5, 1000):
            for _ in range(25):
                table = np.array([[r.randint(0, most) for _ in range(k)] for _ in range(k)])
                assert metrics.first_best_assignment(table) == list(brute(table)), table


def test_forty_labels(spark):
    k, r = 40, random.Random(8)
    shift = list(range(k))
    r.shuffle(shift)
    # spots 0..799 carry the shuffled name, 800 to 1199 a random one: the shuffle keeps most overlap
    rows = [("s", i, 11, i % k) for i in range(1200)] + [("s", i, 23, shift[i % k] if i < 800 else r.randrange(k)) for i in range(1200)]
    # the second sample has no overlap at all beyond label 0: all other labels are free and take the first order
    rows += [("t", 0, 11, 0), ("t", 0, 23, 39)]
    labels = spark.createDataFrame(rows, "sample_id string, spot long, seed int, label int")
    got = {}
    for q in metrics.align(labels, 11, k).collect():
        got.setdefault(q.sample_id, {})[q.cur] = q.ref
    assert got["s"] == {shift[i]: i for i in range(k)}
    assert got["t"] == {39: 0, **{i: i + 1 for i in range(39)}}


@pytest.mark.parametrize("k", [0, 1])
def test_trivial_tables(k):
    assert metrics.first_best_assignment(np.zeros((k, k), int)) == list(range(k))
