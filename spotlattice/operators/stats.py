"""Rank tests, false-discovery control and bootstrap intervals as grouped DataFrame operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlattice.functions.expr import hash_number, normal_tail
from spotlattice.operators.ranks import distinct_ranks, least_from_here, numbered


def _ties() -> Column:
    """Sum of t^3 - t over the groups of t equal values."""
    n = F.col("n").cast("double")
    return F.sum(n * n * n - n)


def wilcoxon(rows: DataFrame, keys: tuple[str, ...], delta: str = "delta", alternative: str = "two-sided", against: float = 0.0) -> DataFrame:
    """Signed-rank test per group: zeros dropped, middle ranks, tie correction, continuity 0.5, normal tail.

    Differences are rounded to 12 decimals first, so that float noise breaks no ties. Equal sizes
    are counted first and ranked once, so a group may be of any size.
    """
    d = F.round(F.col(delta) - against, 12)
    rows = rows.select(*keys, d.alias("d")).filter("d <> 0")
    ranked = distinct_ranks(rows, keys, F.abs("d"), up=(F.col("d") > 0).cast("bigint"))
    g = ranked.groupBy(*keys).agg(F.sum("n").alias("n_all"), F.sum(F.col("up") * F.col("mid")).alias("v"), _ties().alias("tie")).withColumnRenamed("n_all", "n")
    n = F.col("n").cast("double")
    sigma = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48.0)
    z = F.col("v") - n * (n + 1) / 4
    z = z - (0.5 if alternative == "greater" else F.signum(z) * 0.5)
    g = g.withColumn("z", F.try_divide(z, sigma))
    p = normal_tail(F.col("z")) if alternative == "greater" else F.least(F.lit(1.0), 2 * normal_tail(F.abs("z")))
    return g.select(*keys, "n", "v", "z", p.alias("p"))


#: A side of so many values or fewer, without ties, is tested by the exact distribution.
EXACT_SIDE = 8


def rank_sum_tail(small: int, large: int, most: int) -> float:
    """P(U <= most) without ties: orders are counted by the product of (1 - q^(large + i)) / (1 - q^i) over the smaller side."""
    ways = np.zeros(most + 1)
    ways[0] = 1.0
    for i in range(1, small + 1):
        if large + i <= most:
            ways[large + i :] -= ways[: most + 1 - large - i].copy()
        folded = np.zeros((-(-(most + 1) // i), i))
        folded.flat[: most + 1] = ways
        ways = np.cumsum(folded, axis=0).ravel()[: most + 1]
    total = 1.0
    for i in range(1, small + 1):
        total = total * (large + i) / i
    return float(ways.sum() / total)


def _exact_p(small: pd.Series, large: pd.Series, most: pd.Series) -> pd.Series:
    """Two-sided p of each group; groups of equal sizes and U are counted once."""
    known: dict[tuple[int, int, int], float] = {}
    out = []
    for key in zip(small.astype(int), large.astype(int), most.astype(int), strict=True):
        if key not in known:
            known[key] = min(1.0, 2 * rank_sum_tail(*key))
        out.append(known[key])
    return pd.Series(out, dtype="float64")


def mann_whitney(rows: DataFrame, keys: tuple[str, ...], side: str, value: str, exact_side: int = EXACT_SIDE) -> DataFrame:
    """Two-sided U test per group; ``side`` is true for the first sample. U counts its wins.

    The exact distribution where a side has ``exact_side`` values or fewer and no two values
    are equal, else the normal tail with tie correction and continuity 0.5. A group
    without values on one of the sides has no z and p 1.
    """
    rows = rows.select(*keys, F.col(side).alias("b"), F.col(value).cast("double").alias("x")).filter("x IS NOT NULL")
    ranked = distinct_ranks(rows, keys, F.col("x"), first=F.col("b").cast("bigint"))
    g = ranked.groupBy(*keys).agg(
        F.sum("first").alias("n1"), F.sum(F.col("n") - F.col("first")).alias("n2"), F.sum(F.col("first") * F.col("mid")).alias("r1"), _ties().alias("tie")
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.coalesce(F.try_divide(F.col("tie"), n * (n - 1)), F.lit(0.0))))
    g = g.withColumn("u", u).withColumn("z", F.try_divide(F.greatest(F.col("u"), n1 * n2 - F.col("u")) - n1 * n2 / 2 - 0.5, sigma))
    g = g.withColumn("normal", F.least(F.lit(1.0), 2 * normal_tail(F.col("z"))))
    few = (F.least("n1", "n2") <= exact_side) & (F.least("n1", "n2") > 0) & (F.col("tie") == 0)
    # groups that need no exact count are passed as the smallest one
    at = lambda c: F.when(few, c).otherwise(F.lit(1)).cast("bigint")
    exact = F.pandas_udf(_exact_p, "double")(at(F.least("n1", "n2")), at(F.greatest("n1", "n2")), at(F.least(F.col("u"), n1 * n2 - F.col("u"))))
    return g.select(*keys, "n1", "n2", "u", "z", F.when(few, exact).otherwise(F.col("normal")).alias("p"))


def bh_fdr(rows: DataFrame, keys: tuple[str, ...], p: str, order: str) -> DataFrame:
    """Step-up q values within the family ``keys``; rows without p go. Equal p values have equal q values, whatever their ``order``.

    The last of equal p values gives the smallest of their quotients, so each value is needed once.
    """
    some = rows.filter(F.col(p).isNotNull())
    values = distinct_ranks(some, keys, F.col(p))
    values = values.select(*keys, "x", (F.col("x") * F.col("total") / (F.col("before") + F.col("n"))).alias("raw"))
    q = least_from_here(values, keys, ("x",), "raw").select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("x").alias("_x"), F.least("least", F.lit(1.0)).alias("q"))
    same = F.col(p) == F.col("_x")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return some.join(q, same).select(*rows.columns, "q")


def _indexed(rows: DataFrame, keys: tuple[str, ...], value: str, order: str) -> DataFrame:
    """(keys, x, i, n): the values of a group numbered in their order."""
    some = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("x"), F.col(order).alias("_o"))
    return numbered(some, keys, ("x", "_o")).select(*keys, "x", F.col("before").alias("i"), F.col("total").alias("n"))


#: Tasks that the rounds of a resampling are dealt to.
DEALT = 256


def _middles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each round's hashes, for each size n, the two middle ones of the first n numbers modulo n."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            drawn = np.asarray(row.drawn, np.int64)
            out = []
            for n in row.sizes:
                low, high = (n - 1) // 2, n // 2
                middle = np.partition(drawn[:n] % n, [low, high])
                out.append((row.b, n, [int(middle[low]), int(middle[high])]))
            yield pd.DataFrame(out, columns=["b", "n", "i"])


def _medians(rows: DataFrame, keys: tuple[str, ...], rounds: int, seed: int) -> DataFrame:
    """(keys, b, m): the median of each of ``rounds`` resamples, each of n values drawn by a portable hash of (seed, round, place).

    Values are numbered in their order, so the median of a resample is at the median of the
    numbers drawn. These depend on the round and on n alone: a round is hashed once, as often as the largest group
    has values, and gives the middle numbers for every size; only those meet the values.
    """
    groups = rows.groupBy(*keys).agg(F.first("n").alias("n"))
    sizes = groups.agg(F.sort_array(F.collect_set("n")).alias("sizes")).filter(F.size("sizes") > 0)
    each = rows.sparkSession.range(0, rounds, 1, min(rounds, DEALT)).select(F.col("id").cast("int").alias("b"))
    number = lambda i: hash_number(F.concat_ws("|", F.lit(str(seed)), F.col("b"), i))
    # one row of sizes
    drawn = each.crossJoin(F.broadcast(sizes)).select("b", "sizes", F.transform(F.sequence(F.lit(0).cast("bigint"), F.array_max("sizes") - 1), number).alias("drawn"))
    middle = groups.join(drawn.mapInPandas(_middles, "b int, n bigint, i array<bigint>"), "n").select(*keys, "b", F.explode("i").alias("i"))
    return middle.join(rows.select(*keys, "i", "x"), [*keys, "i"]).groupBy(*keys, "b").agg(F.avg("x").alias("m"))


def bootstrap_ci(rows: DataFrame, keys: tuple[str, ...], value: str, order: str, rounds: int = 5000, seed: int = 11) -> DataFrame:
    """Percentile interval of the median; null with fewer than two values."""
    indexed = _indexed(rows, keys, value, order)
    medians = _medians(indexed.filter("n > 1"), keys, rounds, seed)
    ci = medians.groupBy(*keys).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(*keys, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))
    return indexed.groupBy(*keys).agg(F.percentile("x", 0.5).alias("median"), F.count(F.lit(1)).alias("n")).join(ci, list(keys), "left")


def bootstrap_median_diff(rows: DataFrame, keys: tuple[str, ...], side: str, value: str, order: str, rounds: int = 1000, seed: int = 11) -> DataFrame:
    """Percentile interval of median(true side) - median(false side), both sides resampled."""
    both = (*keys, side)
    medians = _medians(_indexed(rows, both, value, order), both, rounds, seed).groupBy(*keys, "b").agg(F.max(F.when(F.col(side), F.col("m"))).alias("m1"), F.max(F.when(~F.col(side), F.col("m"))).alias("m0"))
    return medians.groupBy(*keys).agg(F.percentile(F.col("m1") - F.col("m0"), F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(*keys, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))
