"""Scores of labellings: agreement of neighbours, markers, Rand index, alignment, controls."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotlattice.functions.expr import hash_number
from spotlattice.operators.graph import KEY, coherence_neighbours
from spotlattice.operators.ranks import numbered, quantiles


def agreement(edges: DataFrame, labels: DataFrame, by: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Mean over (spot, neighbour) of equal labels; null for a group without edges to labelled spots."""
    keys = list(dict.fromkeys((KEY, *by)))
    a = labels.select(*keys, F.col("spot").alias("src"), F.col("label").alias("la"))
    b = labels.select(*keys, F.col("spot").alias("dst"), F.col("label").alias("lb"))
    pairs = edges.join(a, [KEY, "src"]).join(b, [*keys, "dst"])
    return pairs.groupBy(*keys).agg(F.avg((F.col("la") == F.col("lb")).cast("double")).alias("coherence"), F.count(F.lit(1)).alias("n_pairs"))


def marker_differences(expr: DataFrame, labels: DataFrame, least: int = 3) -> DataFrame:
    """(sample, label, gene, diff): mean inside less mean outside each cluster, absent values as zero.

    Clusters with fewer than ``least`` spots inside or outside are left out.
    Every gene of the sample takes part in every cluster.
    """
    n = labels.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    c = labels.groupBy(KEY, "label").agg(F.count(F.lit(1)).alias("nc")).join(n, KEY).filter((F.col("nc") >= least) & (F.col("n") - F.col("nc") >= least))
    inside = expr.join(labels, [KEY, "spot"])
    s = inside.groupBy(KEY, "label", "gene").agg(F.sum("v").alias("s"))
    t = inside.groupBy(KEY, "gene").agg(F.sum("v").alias("t"))
    full = c.join(t, KEY).join(s, [KEY, "label", "gene"], "left")
    s = F.coalesce("s", F.lit(0.0))
    return full.select(KEY, "label", "gene", (s / F.col("nc") - (F.col("t") - s) / (F.col("n") - F.col("nc"))).alias("diff"))


def marker_top(diffs: DataFrame, sizes: list[int]) -> DataFrame:
    """(sample, label, top_n, mean, most): mean and largest difference of the top genes, for several sizes in one ranking."""
    w = Window.partitionBy(KEY, "label").orderBy(F.desc("diff"), "gene")
    ranked = diffs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= max(sizes))
    each = ranked.withColumn("top_n", F.explode(F.array(*map(F.lit, sizes)))).filter("r <= top_n")
    return each.groupBy(KEY, "label", "top_n").agg(F.avg("diff").alias("mean"), F.max("diff").alias("most"))


def marker_separation(diffs: DataFrame, sizes: list[int]) -> DataFrame:
    """(sample, top_n, separation): median over clusters."""
    return marker_top(diffs, sizes).groupBy(KEY, "top_n").agg(F.percentile("mean", 0.5).alias("separation"), F.count(F.lit(1)).alias("n_clusters"))


def ari_of(pairs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Adjusted Rand index of rows ``(keys, la, lb)``; two trivial labellings agree fully."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = pairs.groupBy(*keys, "la", "lb").agg(F.count(F.lit(1)).cast("double").alias("n"))
    a = cells.groupBy(*keys, "la").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(two("n")).alias("a"))
    b = cells.groupBy(*keys, "lb").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(two("n")).alias("b"))
    g = cells.groupBy(*keys).agg(F.sum(two("n")).alias("i"), F.sum("n").alias("n")).join(a, list(keys)).join(b, list(keys))
    expected = F.try_divide(F.col("a") * F.col("b"), two("n"))
    top = (F.col("a") + F.col("b")) / 2
    return g.select(*keys, F.coalesce(F.try_divide(F.col("i") - expected, top - expected), F.lit(1.0)).alias("ari"))


def ari(labels: DataFrame, seed_a: int, seed_b: int) -> DataFrame:
    a = labels.filter(F.col("seed") == seed_a).select(KEY, "spot", F.col("label").alias("la"))
    b = labels.filter(F.col("seed") == seed_b).select(KEY, "spot", F.col("label").alias("lb"))
    return ari_of(a.join(b, [KEY, "spot"]), (KEY,))


def ari_seed_pairs(labels: DataFrame) -> DataFrame:
    """All pairs of seeds a < b, named ``a_vs_b``."""
    a = labels.select(KEY, "spot", F.col("seed").alias("sa"), F.col("label").alias("la"))
    b = labels.select(KEY, "spot", F.col("seed").alias("sb"), F.col("label").alias("lb"))
    pairs = a.join(b, [KEY, "spot"]).filter("sa < sb").withColumn("pair", F.concat_ws("_vs_", "sa", "sb"))
    return ari_of(pairs, (KEY, "pair"))


def random_labels(spots: DataFrame, k: int, seed: int) -> DataFrame:
    """A label below ``k`` for each spot by a portable hash of seed and spot."""
    return spots.select(KEY, "spot", (hash_number(F.concat_ws("|", F.lit(str(seed)), F.col("spot"))) % k).alias("label"))


def shuffled_coords(spots: DataFrame, seed: int) -> DataFrame:
    """The sample's coordinates dealt out anew: the i-th spot by id gets those of the i-th by hash."""
    h = hash_number(F.concat_ws("|", F.lit(str(seed)), F.col("spot")))
    by_id = numbered(spots.select(KEY, "spot"), (KEY,), ("spot",)).select(KEY, "spot", F.col("before").alias("i"))
    by_hash = numbered(spots.select(KEY, h.alias("h"), "spot", "x", "y"), (KEY,), ("h", "spot")).select(KEY, "x", "y", F.col("before").alias("i"))
    return by_id.join(by_hash, [KEY, "i"]).select(KEY, "spot", "x", "y")


def control_shuffled(spots: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    """Coherence of the real labels on shuffled coordinates."""
    return agreement(coherence_neighbours(shuffled_coords(spots, seed)), labels)


def _overlap(labels: DataFrame, reference: int) -> DataFrame:
    a = labels.filter(F.col("seed") == reference).select(KEY, "spot", F.col("label").alias("ref"))
    b = labels.filter(F.col("seed") != reference).select(KEY, "spot", "seed", F.col("label").alias("cur"))
    return a.join(b, [KEY, "spot"]).groupBy(KEY, "seed", "cur", "ref").agg(F.count(F.lit(1)).alias("n"))


def first_best_assignment(overlap: np.ndarray) -> list[int]:
    """For each row of a square table the column, all different, with the largest sum; of equal ones the first in lexicographic order.

    Shortest augmenting paths give one best assignment and the prices that prove it. Every best one
    uses only cells without slack at those prices, so the first of them is found by giving each row
    in turn its smallest such column that leaves the later rows one.
    """
    k = len(overlap)
    cost = (overlap.max(initial=0) - overlap).astype(np.int64)
    u, v, row_of = np.zeros(k, np.int64), np.zeros(k + 1, np.int64), np.full(k + 1, -1)
    for i in range(k):
        row_of[k], j = i, k
        least, via, done = np.full(k, np.iinfo(np.int64).max), np.full(k, k), np.zeros(k + 1, bool)
        while row_of[j] >= 0:
            done[j] = True
            r = row_of[j]
            slack = cost[r] - u[r] - v[:k]
            better = ~done[:k] & (slack < least)
            least[better], via[better] = slack[better], j
            near = np.where(done[:k], np.iinfo(np.int64).max, least)
            j = int(near.argmin())
            step = near[j]
            u[row_of[done]] += step
            v[done] -= step
            least[~done[:k]] -= step
        while j != k:
            row_of[j], j = row_of[via[j]], via[j]
    column = np.empty(k, int)
    column[row_of[:k]] = np.arange(k)
    tight = cost == u[:, None] + v[None, :k]
    owner, fixed = row_of[:k].copy(), np.zeros(k, bool)

    def move(r: int, seen: np.ndarray) -> bool:
        """Finds row ``r`` another column by moving later rows on."""
        for j in np.flatnonzero(tight[r] & ~fixed & ~seen):
            seen[j] = True
            if owner[j] < 0 or move(int(owner[j]), seen):
                owner[j], column[r] = r, j
                return True
        return False

    for i in range(k):
        for j in np.flatnonzero(tight[i] & ~fixed):
            if column[i] == j:
                break
            before = owner.copy(), column.copy()
            other = int(owner[j])
            owner[column[i]], owner[j], column[i] = -1, i, j
            fixed[j] = True
            if move(other, np.zeros(k, bool)):
                break
            fixed[j] = False
            owner[:], column[:] = before
        fixed[column[i]] = True
    return column.tolist()


def align(labels: DataFrame, reference: int, k: int) -> DataFrame:
    """(sample, seed, cur, ref): the relabelling of 0..k-1 to the reference seed with most overlap, the first of equal ones.

    Overlaps are counted by Spark; a task takes the k x k table of one sample and seed.
    """
    o = _overlap(labels, reference).filter(F.col("cur").between(0, k - 1) & F.col("ref").between(0, k - 1))

    def best(cells: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((k, k), np.int64)
        table[cells["cur"].to_numpy(), cells["ref"].to_numpy()] = cells["n"].to_numpy()
        return pd.DataFrame({KEY: cells[KEY].iloc[0], "seed": cells["seed"].iloc[0], "cur": np.arange(k), "ref": first_best_assignment(table)})

    kind = lambda c: labels.schema[c].dataType.simpleString()
    return o.groupBy(KEY, "seed").applyInPandas(best, f"{KEY} {kind(KEY)}, seed {kind('seed')}, cur int, ref int")


def align_greedy(labels: DataFrame, reference: int, k: int) -> DataFrame:
    """The same by taking the pair of largest (overlap, ref, cur) among unused labels, k times, in one pass per group's table."""
    left = _overlap(labels, reference)
    taken = None
    for _ in range(k):
        best = left.groupBy(KEY, "seed").agg(F.max(F.struct("n", "ref", "cur")).alias("b")).select(KEY, "seed", "b.cur", "b.ref")
        taken = best if taken is None else taken.unionByName(best)
        left = left.join(best.select(KEY, "seed", "cur"), [KEY, "seed", "cur"], "left_anti").join(best.select(KEY, "seed", "ref"), [KEY, "seed", "ref"], "left_anti")
    return taken


def aligned(labels: DataFrame, mapping: DataFrame, reference: int) -> DataFrame:
    """Labels of the other seeds in the reference's names, with the reference label."""
    ref = labels.filter(F.col("seed") == reference).select(KEY, "spot", F.col("label").alias("reference_label"))
    cur = labels.filter(F.col("seed") != reference).withColumnRenamed("label", "cur").join(mapping, [KEY, "seed", "cur"])
    return ref.join(cur.select(KEY, "spot", "seed", F.col("ref").alias("label")), [KEY, "spot"])


def unstable_spots(aligned_labels: DataFrame) -> DataFrame:
    """Per spot whether any other seed disagrees with the reference, and the share that does."""
    neq = (F.col("label") != F.col("reference_label")).cast("int")
    return aligned_labels.groupBy(KEY, "spot").agg(F.max(neq).alias("unstable"), F.avg(neq).alias("diff_rate"))


def instability_summary(unstable: DataFrame, values: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Medians of marker values and of their sum, for stable and unstable spots; missing values are skipped."""
    rows = unstable.join(values, [KEY, "spot"])
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    n = rows.groupBy(KEY, "unstable").agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns), F.struct(F.lit("sum").alias("name"), total.cast("double").alias("v"))))
    middle = quantiles(rows.select(KEY, "unstable", each.alias("e")).select(KEY, "unstable", "e.name", "e.v"), (KEY, "unstable", "name"), "v", {"m": 0.5})
    middle = middle.groupBy(KEY, "unstable").agg(*(F.max(F.when(F.col("name") == c, F.col("m"))).alias(f"median_{c}") for c in (*columns, "sum")))
    return n.join(middle, [KEY, "unstable"], "left")


def boundary(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(sample, spot, is_boundary): whether any of the true nearest spots has another label."""
    a = labels.select(KEY, "spot", F.col("label").alias("la"))
    b = labels.select(KEY, F.col("spot").alias("other"), F.col("label").alias("lb"))
    return neighbours.select(KEY, "spot", "other").join(a, [KEY, "spot"]).join(b, [KEY, "other"]).groupBy(KEY, "spot").agg(F.max((F.col("la") != F.col("lb")).cast("int")).alias("is_boundary"))


def boundary_guard(mask: DataFrame, least: int = 10, keys: tuple[str, ...] = (KEY,)) -> tuple[DataFrame, DataFrame]:
    """(kept, failures): the spots of the groups with ``least`` boundary and ``least`` interior spots, and a row for each other group."""
    on = F.col("is_boundary") == 1
    n = mask.groupBy(*keys).agg(F.count_if(on).alias("n_boundary"), F.count_if(~on).alias("n_interior"))
    few = n.filter(F.least("n_boundary", "n_interior") < least)
    message = F.concat(F.lit("too few boundary or interior spots: "), "n_boundary", F.lit(" and "), "n_interior")
    return mask.join(few, list(keys), "left_anti"), few.withColumns({"failure_type": F.lit("boundary_sides"), "error_message": message})


def select_marker(candidates: DataFrame, genes: DataFrame) -> DataFrame:
    """Per category the first candidate that the genes hold; null where none is."""
    c = candidates.select("category", F.posexplode("candidates").alias("place", "name"))
    best = c.join(genes.select("name").distinct(), "name").groupBy("category").agg(F.min_by("name", "place").alias("marker"))
    return candidates.select("category").join(best, "category", "left")
