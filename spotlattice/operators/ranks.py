"""Order within groups of any size: running sums, ranks and row numbers over many tasks.

A window over a whole group sorts it in one task. Here the rows are dealt by ranges of
(group, order) into as many parts as the session has shuffle partitions and written
once; sums run within a part, and what lies before a part is added from one small row a part.
Only where the whole table has no more than ``ONE_TASK`` rows, so that no group can, a window does the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlattice.operators.lineage import cut, tidy


#: So many rows one task may sort.
ONE_TASK = 1_000_000


def _dealt(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The rows with ``_part``, the number of their range. Written, for a range's borders are sampled anew each time it is made."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))


def _by_part(rows: DataFrame, parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Joins on group and part; a null key is a group like any other."""
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "_part")]
    more = [c for c in parts.columns if c not in (*keys, "_part")]
    return rows.alias("l").join(parts.alias("r"), reduce(Column.__and__, on)).select("l.*", *(F.col(f"r.{c}") for c in more))


@tidy
def running(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], of: str) -> DataFrame:
    """The rows with ``before``, the sum of ``of`` over the rows of the group that come earlier in ``order``, and ``total`` of the group."""
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero, rows = F.lit(0).cast("bigint"), cut(rows)
    if rows.count() <= ONE_TASK:
        group = Window.partitionBy(*keys)
        return rows.withColumns({"before": F.coalesce(F.sum(of).over(earlier(group.orderBy(*order))), zero), "total": F.sum(of).over(group)})
    dealt = _dealt(rows, keys, order)
    within = earlier(Window.partitionBy(*keys, "_part").orderBy(*order))
    parts = dealt.groupBy(*keys, "_part").agg(F.sum(of).alias("_sum"))
    group = Window.partitionBy(*keys)
    parts = parts.select(*keys, "_part", F.coalesce(F.sum("_sum").over(earlier(group.orderBy("_part"))), zero).alias("_start"), F.sum("_sum").over(group).alias("total"))
    out = _by_part(dealt.withColumn("_inner", F.coalesce(F.sum(of).over(within), zero)), parts, keys)
    return out.withColumn("before", F.col("_start") + F.col("_inner")).drop("_start", "_inner", "_part")


def distinct_ranks(rows: DataFrame, keys: tuple[str, ...], value: Column, **sums: Column) -> DataFrame:
    """(keys, x, n, sums, before, total, mid): each value of a group once, how often it occurs, and its middle rank.

    Equal values are counted before anything is sorted, so however many there are they cost one row.
    """
    counts = rows.groupBy(*keys, value.alias("x")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(name) for name, c in sums.items()))
    return running(counts, keys, ("x",), "n").withColumn("mid", F.col("before") + (F.col("n") + 1) / 2.0)


def numbered(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The rows with ``before``, their place in the group counted from 0, and ``total``, its size; ``order`` leaves no ties."""
    return running(rows.withColumn("_one", F.lit(1).cast("bigint")), keys, order, "_one").drop("_one")


@tidy
def least_from_here(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], of: str) -> DataFrame:
    """The rows with ``least``, the smallest ``of`` among them and the later ones of the group in ``order``."""
    later = lambda w, first: w.rowsBetween(first, Window.unboundedFollowing)
    rows = cut(rows)
    if rows.count() <= ONE_TASK:
        return rows.withColumn("least", F.min(of).over(later(Window.partitionBy(*keys).orderBy(*order), Window.currentRow)))
    dealt = _dealt(rows, keys, order)
    within = later(Window.partitionBy(*keys, "_part").orderBy(*order), Window.currentRow)
    parts = dealt.groupBy(*keys, "_part").agg(F.min(of).alias("_least"))
    parts = parts.select(*keys, "_part", F.min("_least").over(later(Window.partitionBy(*keys).orderBy("_part"), 1)).alias("_beyond"))
    out = _by_part(dealt.withColumn("_inner", F.min(of).over(within)), parts, keys)
    return out.withColumn("least", F.least("_inner", "_beyond")).drop("_inner", "_beyond", "_part")


@tidy
def quantiles(rows: DataFrame, keys: tuple[str, ...], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, one column a share): exact quantiles with linear interpolation, as ``percentile`` gives them; null values do not count.

    The values at the two places about each quantile are looked up among the ranks, so a group's values never meet in one buffer.
    """
    ranked = distinct_ranks(rows.filter(F.col(value).isNotNull()), keys, F.col(value).cast("double"))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("x")))

    def one(share: float) -> Column:
        place = (F.col("total") - 1) * F.lit(share)
        low = F.floor(place)
        a, b = at(low), at(F.least(low + 1, F.col("total") - 1))
        part = F.max(place - low)
        # the same sum as ``percentile``: equal neighbours give their value as it is
        return F.when(a == b, a).otherwise((1 - part) * a + part * b)

    return ranked.groupBy(*keys).agg(*(one(share).alias(name) for name, share in shares.items()))
