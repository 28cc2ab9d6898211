"""Patches of several images in one call."""

import random

import pytest

from spotlattice.operators import compare


def test_patches_of_two_images_equal_those_of_each(spark):
    r = random.Random(9)
    pixels = {s: [(s, x, y, float(r.randint(0, 255))) for x in range(w) for y in range(h)] for s, w, h in (("a", 40, 30), ("b", 20, 60))}
    spots = [(s, i, r.random() * 60 - 5, r.random() * 60 - 5) for s in "ab" for i in range(40)]
    kind = "sample_id string, px long, py long, gray double"
    at = spark.createDataFrame(spots, "sample_id string, spot long, x double, y double")
    both = compare.patch_features(at, spark.createDataFrame(pixels["a"] + pixels["b"], kind), half=6, keys=("sample_id",)).collect()
    got = {(q.sample_id, q.spot): tuple(q[2:]) for q in both}
    want = {}
    for s in "ab":
        alone = compare.patch_features(at.filter(f"sample_id = '{s}'"), spark.createDataFrame(pixels[s], kind).drop("sample_id"), half=6)
        want |= {(q.sample_id, q.spot): tuple(q[2:]) for q in alone.collect()}
    assert set(got) == set(want) and {s for s, _ in got} == {"a", "b"}
    assert all(got[k] == pytest.approx(want[k]) for k in want)
