"""Clustering of many (sample, K, seed) groups in one job, and checks of labellings."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlattice.functions.expr import squared_distance
from spotlattice.operators.graph import KEY, components, connect
from spotlattice.operators.lineage import cut, tidy
from spotlattice.operators.ranks import numbered


def _mean(c: str, n: int):
    return F.array(*(F.avg(F.col(c)[i]) for i in range(n)))


#: Rows of clusters or nodes and of their edges up to which a group's further rounds run in one task.
_SMALL = 500_000


# --- k-means -------------------------------------------------------------------


def _assigned(points: DataFrame, centroids: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, spot, label, d2, f): a group's centroids come to a point as one array, so nothing is gathered by spot."""
    c = centroids.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("label", F.col("f").alias("c")))).alias("cs"))
    pairs = points.select(KEY, "spot", "f").join(c, KEY)
    best = F.array_min(F.transform("cs", lambda s: F.struct(squared_distance(F.col("f"), s["c"]).alias("d2"), s["label"].alias("label"))))
    return pairs.withColumn("b", best).select(*keys, "spot", "b.label", "b.d2", "f")


def kmeans_assign(points: DataFrame, centroids: DataFrame, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """(keys, spot, label, d2): the nearest centroid of each point in every group; ties to the lower label.

    Centroids are few, K of each group; the join is on the sample and Spark picks its kind by their size.
    """
    return _assigned(points, centroids, keys).drop("f")


def kmeans_update(points: DataFrame, assigned: DataFrame, size: int, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """(keys, label, f): the mean of each cluster."""
    return assigned.join(points.select(KEY, "spot", "f"), [KEY, "spot"]).groupBy(*keys, "label").agg(_mean("f", size).alias("f"))


#: Points drawn in each round of the seeding, as a multiple of K, and how many rounds there are.
OVERSAMPLE, DRAWS = 2, 2
_BLOCK = 2048
_GROUP = ("K", "seed", "init")


def _hashed(spots: np.ndarray, *salt: int) -> np.ndarray:
    """A number below 2^64 for each spot, the same wherever the spot lies."""
    with np.errstate(over="ignore"):
        x = spots.astype(np.int64).view(np.uint64).copy()
        for s in salt:
            x = (x ^ np.uint64(s & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
    return x


def _packed(points: DataFrame, size: int) -> DataFrame:
    """(sample, spots, x): points of one sample packed into matrices, as they lie; nothing is shuffled."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, rows in batch.groupby(KEY, sort=False):
                for i in range(0, len(rows), _BLOCK):
                    some = rows.iloc[i : i + _BLOCK]
                    x = np.vstack(some["f"].to_numpy()).astype(np.float64).reshape(-1, size)
                    yield pd.DataFrame({KEY: [key], "spots": [some["spot"].to_numpy().astype(np.int64).tobytes()], "x": [x.tobytes()]})

    return points.select(KEY, "spot", "f").mapInPandas(work, f"{KEY} {points.schema[KEY].dataType.simpleString()}, spots binary, x binary")


def _each_group(blocks: DataFrame, centres: DataFrame, size: int, work: Callable, columns: str) -> DataFrame:
    """``work(spots, x, (K, seed, init), centres, note)`` on every block and group of its sample; it gives rows without sample and group.

    ``centres`` has one row a group with its vectors one after the other in ``c`` and a number in ``note``.
    A sample's groups come to a block as one row, so a pass over the points takes no shuffle of theirs while Spark can broadcast the centres.
    """
    per = centres.groupBy(KEY).agg(F.collect_list(F.struct(*_GROUP, "c", "note")).alias("groups"))
    key = f"{KEY} {blocks.schema[KEY].dataType.simpleString()}"
    names = [c.split()[0] for c in f"{key}, K int, seed int, init int, {columns}".split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                spots, x = np.frombuffer(row.spots, np.int64), np.frombuffer(row.x, np.float64).reshape(-1, size)
                out = []
                for g in row.groups:
                    c = np.asarray(g["c"], np.float64).reshape(-1, size)
                    name = (g["K"], g["seed"], g["init"])
                    out += [(getattr(row, KEY), *name, *r) for r in work(spots, x, name, c, g["note"])]
                yield pd.DataFrame(out, columns=names)

    return blocks.join(per, KEY).mapInPandas(run, f"{key}, K int, seed int, init int, {columns}")


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1), 0.0)


def _joined(rows: DataFrame, note: Column | None = None) -> DataFrame:
    """(sample, K, seed, init, c, note): vectors ``f`` of each group one after the other in the order of ``label``."""
    c = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("label", "f"))), lambda s: s["f"]))
    return rows.groupBy(KEY, *_GROUP).agg(c.alias("c"), (note if note is not None else F.lit(0.0)).alias("note"))


def _first_points(spots, x, name, c, note):
    """The K points of least hash in a block."""
    h = _hashed(spots, 1, name[1], name[2])
    for i in np.lexsort((spots, h))[: name[0]]:
        yield int(spots[i]), float(h[i] >> np.uint64(11)), x[i].tolist()


def _cost(spots, x, name, c, note):
    yield (float(_distances(x, c).min(1).sum()),)


def _drawn(turn: int) -> Callable:
    def work(spots, x, name, c, note):
        """Points drawn in proportion to their squared distance from what was drawn before; ``note`` is its sum over the sample."""
        if note <= 0:
            return
        chance = OVERSAMPLE * name[0] * _distances(x, c).min(1) / note
        for i in np.flatnonzero(_hashed(spots, 2 + turn, name[1], name[2]) / 2.0**64 < chance):
            yield int(spots[i]), x[i].tolist()

    return work


def _weights(spots, x, name, c, note):
    """How many points of a block are nearest to each candidate."""
    for j, n in enumerate(np.bincount(_distances(x, c).argmin(1), minlength=len(c))):
        yield j, int(n)


def _reduced(size: int) -> Callable:
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        """K of a group's candidates: the next one is the best of a few, drawn by weight times squared distance."""
        rows = rows.sort_values("label", kind="stable")
        c, w = np.vstack(rows["f"].to_numpy()).astype(float), rows["n"].to_numpy(float)
        k, seed, init = (int(rows[g].iloc[0]) for g in _GROUP)
        r = np.random.default_rng([k, seed & (2**63 - 1), init])
        chosen: list[int] = []
        d = np.full(len(c), 1.0)
        for _ in range(min(k, len(c))):
            p = w * d
            if p.sum() <= 0:
                left = [i for i in range(len(c)) if i not in chosen]
                best = left[0]
            else:
                tries = r.choice(len(c), 2 + int(np.log(k)), p=p / p.sum())
                near = [np.minimum(d if chosen else np.inf, ((c - c[i]) ** 2).sum(1)) for i in tries]
                best = int(tries[int(np.argmin([(w * n).sum() for n in near]))])
            away = ((c - c[best]) ** 2).sum(1)
            d = np.minimum(d, away) if chosen else away
            chosen.append(best)
        one = rows.iloc[[0] * len(chosen)][[KEY, *_GROUP]].reset_index(drop=True)
        return one.assign(label=np.arange(len(chosen), dtype=np.int32), f=[c[i].tolist() for i in chosen])

    return work


def _totals(blocks: DataFrame, centres: DataFrame, size: int) -> DataFrame:
    """(sample, K, seed, init, c, n, total): a task's share of each group, how many points are nearest to each centre, and their sum.

    A task adds up its blocks, all groups of a sample at once, before it gives a row: a round's rows do not grow with the points.
    """
    per = centres.groupBy(KEY).agg(F.collect_list(F.struct(*_GROUP, "c")).alias("groups"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                key, x = getattr(row, KEY), np.frombuffer(row.x, np.float64).reshape(-1, size)
                if key not in found:
                    each = [np.asarray(g["c"], np.float64).reshape(-1, size) for g in row.groups]
                    c, ends = np.vstack(each), np.cumsum([len(g) for g in each])
                    found[key] = [[tuple(g[n] for n in _GROUP) for g in row.groups], c, ends, np.zeros(len(c)), np.zeros(c.shape)]
                _, c, ends, n, total = found[key]
                d, hot = _distances(x, c), np.zeros((len(x), len(c)))
                for a, b in itertools.pairwise([0, *ends]):
                    hot[np.arange(len(x)), a + d[:, a:b].argmin(1)] = 1.0
                n += hot.sum(0)
                total += hot.T @ x
        for key, (names, c, ends, n, total) in found.items():
            of = lambda v: [g.ravel() for g in np.split(v, ends[:-1])]  # noqa: B023, E731
            yield pd.DataFrame({KEY: [key] * len(names), **{g: [name[i] for name in names] for i, g in enumerate(_GROUP)}, "c": of(c), "n": of(n), "total": of(total)})

    key = f"{KEY} {blocks.schema[KEY].dataType.simpleString()}"
    return blocks.join(per, KEY).mapInPandas(run, f"{key}, K int, seed int, init int, c array<double>, n array<double>, total array<double>")


def _stepped(size: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        """A group's next centres, and whether one of them moved."""
        c = np.asarray(rows["c"].iloc[0], np.float64).reshape(-1, size)
        n, total = np.sum(np.vstack(rows["n"].to_numpy()), axis=0)[:, None], np.sum(np.vstack(rows["total"].to_numpy()), axis=0).reshape(-1, size)
        new = np.where(n > 0, total / np.maximum(n, 1.0), c)
        return rows.iloc[:1][[KEY, *_GROUP]].assign(c=[new.ravel()], moves=[bool(((new - c) ** 2).sum(1).max() > 1e-12)])

    return work


def _costs(spots, x, name, c, note):
    """Per cluster of a block the squared distances of its points."""
    label = _distances(x, c).argmin(1)
    for j in np.unique(label):
        yield int(j), float(((x[label == j] - c[j]) ** 2).sum())


def _labelled(spots, x, name, c, note):
    yield from zip(spots.tolist(), _distances(x, c).argmin(1).tolist(), strict=True)


def kmeans_starts(blocks: DataFrame, plan: DataFrame, size: int, inits: int) -> DataFrame:
    """(sample, K, seed, init, label, f): first centroids of every start.

    Each start takes K points by hash, draws about ``OVERSAMPLE`` K more in proportion to their
    squared distance, ``DRAWS`` times, weights all of them by the points nearest to them, and keeps K of these
    candidates. All starts of all samples go on together.
    """
    starts = plan.select("K", "seed", F.explode(F.sequence(F.lit(0), F.lit(inits - 1))).alias("init"))
    every = blocks.select(KEY).distinct().crossJoin(F.broadcast(starts)).select(KEY, *(F.col(g).cast("int").alias(g) for g in _GROUP), F.array().cast("array<double>").alias("c"), F.lit(0.0).alias("note"))
    first = _each_group(blocks, every, size, _first_points, "spot bigint, h double, f array<double>")
    w = Window.partitionBy(KEY, *_GROUP).orderBy("h", "spot")  # K points of each block
    found = cut(first.withColumn("r", F.row_number().over(w)).filter("r <= K").select(KEY, *_GROUP, F.col("spot").alias("label"), "f"))
    for turn in range(DRAWS):
        cost = _each_group(blocks, _joined(found), size, _cost, "cost double").groupBy(KEY, *_GROUP).agg(F.sum("cost").alias("cost"))
        more = _each_group(blocks, _joined(found.join(cost, [KEY, *_GROUP]), F.max("cost")), size, _drawn(turn), "label bigint, f array<double>")
        found = cut(found.unionByName(more).groupBy(KEY, *_GROUP, "label").agg(F.first("f").alias("f")))
    weight = _each_group(blocks, _joined(found), size, _weights, "place int, n bigint").groupBy(KEY, *_GROUP, "place").agg(F.sum("n").alias("n"))
    place = found.withColumn("place", (F.row_number().over(Window.partitionBy(KEY, *_GROUP).orderBy("label")) - 1).cast("int"))
    columns = f"{KEY} {blocks.schema[KEY].dataType.simpleString()}, K int, seed int, init int, label int, f array<double>"
    # a group holds its candidates, about K (1 + OVERSAMPLE DRAWS) of them
    return place.join(weight, [KEY, *_GROUP, "place"]).groupBy(KEY, *_GROUP).applyInPandas(_reduced(size), columns)


@tidy
def kmeans_fit(points: DataFrame, plan: DataFrame, size: int, inits: int = 10, rounds: int = 300) -> tuple[DataFrame, DataFrame]:
    """(labels, inertia) per (sample, K, seed): Lloyd steps of all groups and starts at once, the best start wins.

    ``plan`` has K and seed. Points are packed once; a round is one pass over them
    that gives the sums of each task's clusters. A group advances until none of its centroids
    moves; ``converged`` in the inertia table is false where the best start still moved after
    ``rounds``. A centroid without points stays.
    """
    keys = [KEY, *_GROUP]
    blocks = cut(_packed(points, size))
    c = cut(_joined(kmeans_starts(blocks, plan, size, inits)).select(*keys, "c", F.lit(True).alias("moves")))
    shape = f"{KEY} {blocks.schema[KEY].dataType.simpleString()}, K int, seed int, init int, c array<double>, moves boolean"
    for _ in range(rounds):
        new = _totals(blocks, c.filter("moves"), size).groupBy(*keys).applyInPandas(_stepped(size), shape)
        c = cut(c.filter("NOT moves").unionByName(new))
        if c.filter("moves").isEmpty():
            break
    c = c.withColumn("note", F.lit(0.0))
    last = _each_group(blocks, c, size, _costs, "label int, cost double")
    inertia = last.groupBy(*keys).agg(F.sum("cost").alias("inertia"), F.count_distinct("label").alias("n_labels")).join(c.select(*keys, (~F.col("moves")).alias("converged")), keys)
    best = cut(inertia.groupBy(KEY, "K", "seed").agg(F.min(F.struct("inertia", "init", "n_labels", "converged")).alias("b")).select(KEY, "K", "seed", "b.inertia", "b.init", "b.n_labels", "b.converged"))
    labels = _each_group(blocks, c.join(best.select(*keys), keys, "left_semi"), size, _labelled, "spot bigint, label int")
    return labels.select(KEY, "K", "seed", "spot", "label"), best.drop("init")


# --- Ward under contiguity -----------------------------------------------------


def ward_costs(clusters: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(sample, a, b, cost) of adjacent clusters ``(sample, id, n, f)``: n_a n_b / (n_a + n_b) times the squared distance."""
    a = clusters.select(KEY, F.col("id").alias("a"), F.col("n").alias("na"), F.col("f").alias("fa"))
    b = clusters.select(KEY, F.col("id").alias("b"), F.col("n").alias("nb"), F.col("f").alias("fb"))
    pairs = adjacency.join(a, [KEY, "a"]).join(b, [KEY, "b"])
    return pairs.select(KEY, "a", "b", (F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")) * squared_distance(F.col("fa"), F.col("fb"))).alias("cost"))


def ward_round(costs: DataFrame, spread: bool = False) -> DataFrame:
    """(sample, a, b, cost): pairs a < b that are each other's cheapest partner; ties to the lower id.

    With ``spread`` ties go to the pair of least hash, the same seen from both sides, so that of many
    pairs of one cost a fair part is reciprocal in each round.
    """
    both = costs.select(KEY, F.col("a").alias("x"), F.col("b").alias("y"), "cost").unionByName(costs.select(KEY, F.col("b").alias("x"), F.col("a").alias("y"), "cost"))
    tie = F.xxhash64(F.least("x", "y"), F.greatest("x", "y")) if spread else F.lit(0)
    best = both.groupBy(KEY, "x").agg(F.min(F.struct("cost", tie.alias("tie"), "y")).alias("m")).select(KEY, "x", "m.y", "m.cost")
    back = best.select(KEY, F.col("x").alias("y"), F.col("y").alias("x"))
    return best.join(back, [KEY, "x", "y"]).filter("x < y").select(KEY, F.col("x").alias("a"), F.col("y").alias("b"), "cost")


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``xxhash64`` of two longs, as the tables' rounds break ties by it."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    h = np.full(len(a), 42, np.uint64)
    for v in (a, b):
        h = (h + p5 + np.uint64(8)) ^ (turned(v.astype(np.int64).view(np.uint64) * p2, 31) * p1)
        h = turned(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _merged(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The rounds of ``ward_fit`` for one sample of few clusters: each cluster with the one that it ends in."""

    def work(clusters: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(clusters["id"].to_numpy())
        clusters = clusters.sort_values("id")
        n, total = clusters["n"].to_numpy(np.int64).copy(), np.vstack(clusters["total"].to_numpy()).astype(float)
        a, b = (np.searchsorted(ids, pairs[c].to_numpy()) for c in "ab")
        into, spare = np.arange(len(ids)), len(ids) - k
        while spare > 0 and len(a):
            f = total / n[:, None]
            cost = n[a] * n[b] / (n[a] + n[b]) * sum((f[a, i] - f[b, i]) * (f[a, i] - f[b, i]) for i in range(f.shape[1]))
            tie = _pair_hash(ids[a], ids[b])
            x, y, pair = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(np.arange(len(a)), 2)
            order = np.lexsort((y, tie[pair], cost[pair], x))
            best = pair[order[np.flatnonzero(np.diff(x[order], prepend=-1))]]
            # the pairs that are the best of both sides
            merge = np.flatnonzero(np.bincount(best, minlength=len(a)) == 2)
            merge = merge[np.lexsort((a[merge], cost[merge]))][:spare]
            to, gone = a[merge], b[merge]
            n[to] += n[gone]
            total[to] += total[gone]
            new = np.arange(len(ids))
            new[gone] = to
            into, spare = new[into], spare - len(merge)
            a, b = np.minimum(new[a], new[b]), np.maximum(new[a], new[b])
            pair = np.unique(a[a < b] * len(ids) + b[a < b])
            a, b = pair // len(ids), pair % len(ids)
        return pd.DataFrame({KEY: clusters[KEY].to_numpy(), "id": ids, "into": ids[into]})

    return work


@tidy
def ward_fit(points: DataFrame, edges: DataFrame, k: int, size: int) -> DataFrame:
    """(sample, spot, label) with exactly k labels (or one a spot): rounds of reciprocal merges over the edges.

    Parts of the graph without an edge between them are first tied by the shortest ones (``connect``, by
    x and y, or by the first two features where the points have none). The cheapest merges of a round go
    first, as many as still leave k clusters. Ends when no sample has spare clusters:
    each round merges a pair in every other one. A round works on the clusters that are left, not on their spots; a sample
    whose clusters and pairs have come down to ``_SMALL`` rows takes the same rounds in one task.
    """
    place = points.select(KEY, "spot", *((F.col(c) if c in points.columns else F.coalesce(F.get("f", F.lit(i)), F.lit(0.0))).alias(c) for i, c in enumerate("xy")))
    member = cut(points.select(KEY, "spot", F.col("spot").alias("id")))
    adjacency = cut(connect(place, edges))
    clusters = cut(points.select(KEY, F.col("spot").alias("id"), F.lit(1).cast("bigint").alias("n"), F.slice(F.col("f").cast("array<double>"), 1, size).alias("total")))
    total = F.array(*(F.sum(F.col("total")[i]) for i in range(size)))
    key, kind = (points.schema[c].dataType.simpleString() for c in (KEY, "spot"))
    settled = []
    while True:
        rows = clusters.select(KEY, F.lit(1).alias("one")).unionByName(adjacency.select(KEY, F.lit(0).alias("one"))).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), (F.sum("one") - k).alias("spare"))
        rows = cut(rows)
        small = rows.filter((F.col("n") <= _SMALL) | (F.col("spare") <= 0)).select(KEY)
        if not small.isEmpty():
            ends = clusters.join(small, KEY, "left_semi").groupBy(KEY).cogroup(adjacency.join(small, KEY, "left_semi").groupBy(KEY)).applyInPandas(_merged(k), f"{KEY} {key}, id {kind}, into {kind}")
            settled.append(cut(member.join(small, KEY, "left_semi").join(ends, [KEY, "id"]).select(KEY, "spot", F.col("into").alias("id"))))
            member, clusters, adjacency = (cut(t.join(small, KEY, "left_anti")) for t in (member, clusters, adjacency))
        left = rows.join(small, KEY, "left_anti").select(KEY, "spare")
        if left.isEmpty():
            break
        costs = ward_costs(clusters.select(KEY, "id", "n", F.transform("total", lambda t: t / F.col("n")).alias("f")), adjacency)
        merges = cut(ward_round(costs, spread=True).join(left, KEY).select(KEY, "a", "b", "cost", "spare"))
        # only samples with more merges than they can spare have to put them in order
        over = merges.groupBy(KEY).agg((F.count(F.lit(1)) > F.max("spare")).alias("over")).filter("over").select(KEY)
        some = numbered(merges.join(over, KEY, "left_semi"), (KEY,), ("cost", "a")).filter("before < spare")
        taken = merges.join(over, KEY, "left_anti").select(KEY, "a", "b").unionByName(some.select(KEY, "a", "b"))
        merges = cut(taken.select(KEY, F.col("b").alias("id"), F.col("a").alias("into")))
        now = F.coalesce("into", "id").alias("id")
        member = cut(member.join(merges, [KEY, "id"], "left").select(KEY, "spot", now))
        clusters = cut(clusters.join(merges, [KEY, "id"], "left").select(KEY, now, "n", "total").groupBy(KEY, "id").agg(F.sum("n").alias("n"), total.alias("total")))
        for c in "ab":
            adjacency = adjacency.join(merges.select(KEY, F.col("id").alias(c), "into"), [KEY, c], "left").withColumn(c, F.coalesce("into", c)).drop("into")
        adjacency = cut(adjacency.select(KEY, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    if not settled:  # no points
        settled = [member]
    member = functools.reduce(DataFrame.unionByName, settled)
    # the clusters are numbered, not their spots
    label = member.select(KEY, "id").distinct().withColumn("label", F.row_number().over(Window.partitionBy(KEY).orderBy("id")) - 1)
    return member.join(label, [KEY, "id"]).select(KEY, "spot", "label")


# --- communities ---------------------------------------------------------------


def strengths(edges: DataFrame) -> DataFrame:
    """(sample, node, k): summed weight of the edges of each node."""
    ends = edges.select(KEY, F.explode(F.array("src", "dst")).alias("node"), "w")
    return ends.groupBy(KEY, "node").agg(F.sum("w").alias("k"))


def rb_modularity(edges: DataFrame, labels: DataFrame, gamma: float) -> DataFrame:
    """Per sample the sum over communities of inner weight less gamma S^2 / 4m."""
    m = edges.groupBy(KEY).agg(F.sum("w").alias("m"))
    at = lambda c, name: labels.select(KEY, F.col("spot").alias(c), F.col("label").alias(name))
    inner = edges.join(at("src", "la"), [KEY, "src"]).join(at("dst", "lb"), [KEY, "dst"]).filter("la = lb").groupBy(KEY).agg(F.sum("w").alias("inner"))
    s = strengths(edges).join(labels.select(KEY, F.col("spot").alias("node"), "label"), [KEY, "node"]).groupBy(KEY, "label").agg(F.sum("k").alias("s")).groupBy(KEY).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    return s.join(m, KEY).join(inner, KEY, "left").select(KEY, (F.coalesce("inner", F.lit(0.0)) - gamma * F.col("ss") / (4 * F.col("m"))).alias("modularity"))


def _spread(rows: DataFrame) -> DataFrame:
    """``rows`` for a join that shuffles: a fit has hundreds of them, and what Spark broadcasts passes through the driver."""
    return rows.hint("merge")


def _taken(wish: DataFrame, group: list[str]) -> DataFrame:
    """(group, node, to): of the moves ``(group, node, k, m, c, to, g)`` those that raise the modularity taken one after the other.

    In the order of falling gain a move stands if nothing earlier leaves its goal or enters
    what it leaves, and if its gain outlasts the strength of what earlier enters its goal or leaves with it. The first
    move always stands; of two that are in each other's way the later one waits.
    """
    # each move touches two communities: it enters one and leaves the other
    side = lambda c, enters: F.struct(F.col(c).alias("x"), F.lit(enters).alias("enters"))
    touch = wish.withColumn("t", F.explode(F.array(side("to", True), side("c", False)))).select(*group, "node", "to", "k", "m", "g", "t.x", "t.enters")
    earlier = Window.partitionBy(*group, "x").orderBy(F.desc("g"), "node").rowsBetween(Window.unboundedPreceding, -1)
    came, went = (F.sum(F.when(F.col("enters") == yes, F.col("k"))).over(earlier) for yes in (True, False))
    touch = touch.withColumns({"came": came, "went": went})
    alike, against = F.when(F.col("enters"), F.col("came")).otherwise(F.col("went")), F.when(F.col("enters"), F.col("went")).otherwise(F.col("came"))
    moves = touch.groupBy(*group, "node").agg(*(F.max(c).alias(c) for c in ("to", "k", "m", "g")), F.coalesce(F.sum(alike), F.lit(0.0)).alias("before"), F.count(against).alias("clashes"))
    return moves.filter((F.col("clashes") == 0) & (F.col("g") > F.col("gamma") * F.col("k") * F.col("before") / (2 * F.col("m")))).select(*group, "node", "to")


def _move_round(both: DataFrame, comm: DataFrame, group: list[str]) -> DataFrame:
    """(group, node, k, m, c, moved): nodes go to the neighbouring community of largest gain, as far as ``_taken`` lets them.

    Every round raises the modularity of each sample in which any single move would.
    """
    named = comm.select(*group, "node", "k", "m", "c")
    own = named.join(_spread(named.groupBy(*group, "c").agg(F.sum("k").alias("s"))), [*group, "c"])
    other = own.select(*group, F.col("node").alias("other"), F.col("c").alias("to"), F.col("s").alias("to_s"))
    options = both.join(_spread(other), [*group, "other"]).groupBy(*group, "node", "to").agg(F.sum("w").alias("w"), F.max("to_s").alias("to_s")).join(_spread(own), [*group, "node"])
    price = F.col("gamma") * F.col("k") / (2 * F.col("m"))
    stays = F.col("to") == F.col("c")
    gain = F.round(F.col("w") - price * F.when(stays, F.col("s") - F.col("k")).otherwise(F.col("to_s")), 9)
    best = options.withColumn("gain", gain).groupBy(*group, "node").agg(
        *(F.max(c).alias(c) for c in ("k", "m", "c", "s")), F.max(F.when(stays, F.col("gain"))).alias("stay"), F.max(F.when(~stays, F.struct("gain", (-F.col("to")).alias("t")))).alias("b")
    )
    best = best.withColumn("stay", F.coalesce("stay", F.round(-price * (F.col("s") - F.col("k")), 9)))
    wish = best.filter(F.col("b.gain") > F.col("stay")).select(*group, "node", "k", "m", "c", (-F.col("b.t")).alias("to"), (F.col("b.gain") - F.col("stay")).alias("g"))
    return named.join(_spread(_taken(wish, group)), [*group, "node"], "left").select(*group, "node", "k", "m", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved"))


def _refine_round(inside: DataFrame, parts: DataFrame, group: list[str]) -> DataFrame:
    """(group, node, k, m, c, part, joined): nodes that are still alone join well-connected parts of their community.

    ``inside`` has the edges within communities, in both directions. A part is well
    connected if its weight to the rest of the community reaches what chance would give it. Only single
    nodes move, and none while another one joins it (``_taken``), so a node always joins a
    part that keeps the neighbour through which it came: parts are connected.
    """
    parts = parts.select(*group, "node", "k", "m", "c", "part")
    sizes = parts.groupBy(*group, "c", "part").agg(F.sum("k").alias("s"), F.count(F.lit(1)).alias("n"), F.max("m").alias("m"))
    whole = parts.groupBy(*group, "c").agg(F.sum("k").alias("all"))
    at = lambda node, name: parts.select(*group, F.col("node").alias(node), F.col("part").alias(name))
    ends = inside.join(_spread(at("node", "part")), [*group, "node"]).join(_spread(at("other", "to")), [*group, "other"]).filter("part <> to").groupBy(*group, "part", "to").agg(F.sum("w").alias("w"))
    outward = ends.groupBy(*group, "part").agg(F.sum("w").alias("out"))
    by_chance = F.col("gamma") * F.col("s") * (F.col("all") - F.col("s")) / (2 * F.col("m"))
    well = sizes.join(_spread(whole), [*group, "c"]).join(_spread(outward), [*group, "part"]).filter(F.round(F.col("out") - by_chance, 9) >= 0)
    alone = well.filter("n = 1").select(*group, "part", F.col("s").alias("k"), "m")
    options = ends.join(_spread(alone), [*group, "part"]).join(_spread(well.select(*group, F.col("part").alias("to"), "s")), [*group, "to"])
    options = options.withColumn("gain", F.round(F.col("w") - F.col("gamma") * F.col("k") * F.col("s") / (2 * F.col("m")), 9)).filter("gain > 0")
    best = options.groupBy(*group, F.col("part").alias("node")).agg(F.max("k").alias("k"), F.max("m").alias("m"), F.max(F.struct("gain", (-F.col("to")).alias("t"))).alias("b"))
    wish = best.select(*group, "node", "k", "m", F.col("node").alias("c"), (-F.col("b.t")).alias("to"), F.col("b.gain").alias("g"))
    return parts.join(_spread(_taken(wish, group)), [*group, "node"], "left").select(*group, "node", "k", "m", "c", F.coalesce("to", "part").alias("part"), F.col("to").isNotNull().alias("joined"))


def _best_of(at: np.ndarray, to: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Places of the largest gain of each ``at``; of equal ones the least ``to``."""
    order = np.lexsort((to, -gain, at))
    return order[np.flatnonzero(np.diff(at[order], prepend=-1))]


def _summed(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, w) with one row for each pair."""
    pair, at = np.unique(a * n + b, return_inverse=True)
    return pair // n, pair % n, np.bincount(at, weights=w, minlength=len(pair))


def _standing(node: np.ndarray, k: np.ndarray, c: np.ndarray, to: np.ndarray, g: np.ndarray, price: float) -> np.ndarray:
    """Which moves of one group stand; the same as ``_taken``."""
    x, enters, i = np.concatenate([to, c]), np.repeat([True, False], len(node)), np.tile(np.arange(len(node)), 2)
    order = np.lexsort((node[i], -g[i], x))
    x, enters, i = x[order], enters[order], i[order]
    first = np.maximum.accumulate(np.where(np.diff(x, prepend=-1) != 0, np.arange(len(x)), 0))
    earlier = lambda v: (t := np.cumsum(v) - v) - t[first]
    came, went = earlier(np.where(enters, k[i], 0.0)), earlier(np.where(enters, 0.0, k[i]))
    against = np.where(enters, earlier((~enters).astype(int)), earlier(enters.astype(int))) > 0
    before = np.bincount(i, weights=np.where(enters, came, went), minlength=len(node))
    return (np.bincount(i, weights=against, minlength=len(node)) == 0) & (g > price * k * before)


def _levels(level: int, levels: int | None, rounds: int | None) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The levels of ``community_fit`` from ``level`` on for one small group: each node with the name of its community."""

    def work(edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([nodes["node"].to_numpy(), nodes["c"].to_numpy()]))
        place = lambda v: np.searchsorted(ids, v.to_numpy())
        size = len(ids)
        v, k, c = place(nodes["node"]), np.zeros(size), np.zeros(size, np.int64)
        k[v], c[v] = nodes["k"], place(nodes["c"])
        a, b, w = place(edges["node"]), place(edges["other"]), edges["w"].to_numpy(float)
        m = float(nodes["m"].iloc[0])
        price = float(nodes["gamma"].iloc[0]) / (2 * m) if m else 0.0
        began, where = v, np.arange(size)
        for at in itertools.count(level):
            last, start = at + 1 == levels, c.copy()
            for turn in itertools.count(1):
                s = np.bincount(c[v], weights=k[v], minlength=size)
                u, to, weight = _summed(a, c[b], w, size)
                stays = to == c[u]
                gain = np.round(weight - price * k[u] * np.where(stays, s[to] - k[u], s[to]), 9)
                stay = np.round(-price * k * (s[c] - k), 9)
                stay[u[stays]] = gain[stays]
                u, to, gain = u[~stays], to[~stays], gain[~stays]
                best = _best_of(u, to, gain)
                best = best[gain[best] > stay[u[best]]]
                u, to, g = u[best], to[best], gain[best] - stay[u[best]]
                stand = _standing(u, k[u], c[u], to, g, price)
                c[u[stand]] = to[stand]
                if turn == rounds or not stand.any():
                    break
            same = c[a] == c[b]
            part = np.arange(size)
            while not last and same.any():
                s, n = np.bincount(part[v], weights=k[v], minlength=size), np.bincount(part[v], minlength=size)
                p, to, weight = _summed(part[a[same]], part[b[same]], w[same], size)
                p, to, weight = p[p != to], to[p != to], weight[p != to]
                out, whole = np.bincount(p, weights=weight, minlength=size), np.bincount(c[v], weights=k[v], minlength=size)
                # only single nodes go, and a part has its community from the node that names it
                well = (np.bincount(p, minlength=size) > 0) & (np.round(out - price * s * (whole[c] - s), 9) >= 0)
                gain = np.round(weight - price * s[p] * s[to], 9)
                may = well[p] & (n[p] == 1) & well[to] & (gain > 0)
                p, to, gain = p[may], to[may], gain[may]
                best = _best_of(p, to, gain)
                p, to, g = p[best], to[best], gain[best]
                stand = _standing(p, s[p], p, to, g, price)
                part[p[stand]] = to[stand]
                if not stand.any():
                    break
            moved, merged, several = (c[v] != start[v]).any(), (part[v] != v).any(), len(np.unique(c[v])) < len(v)
            if last or (several and not moved and not merged):
                part = np.arange(size)
                while True:  # the least node of each connected piece
                    near = part.copy()
                    np.minimum.at(near, a[same], part[b[same]])
                    near = near[near]
                    if (near == part).all():
                        break
                    part = near
                c = part.copy()
            where = part[where]
            if last or not (moved or merged or several):
                break
            c[part[v]], k = c[v], np.bincount(part[v], weights=k[v], minlength=size)
            v, a, b = np.unique(part[v]), part[a], part[b]
            a, b, w = _summed(a[a != b], b[a != b], w[a != b], size)
        one = nodes.iloc[[0] * len(began)][[KEY, "gamma"]].reset_index(drop=True)
        return one.assign(node=ids[began], name=ids[where[began]])

    return work


@tidy
def community_fit(edges: DataFrame, gammas: list[float] | DataFrame, levels: int | None = None, rounds: int | None = None) -> DataFrame:
    """(sample, gamma, spot, label): communities of all samples and resolutions at once, each of them connected.

    A level moves nodes between communities while any move raises the modularity. Each
    community is then refined into well-connected parts by merges inside it, and
    the graph is aggregated by the parts, which start the next level in their community. A sample where
    nothing moves and nothing merges is aggregated by the connected pieces of its
    communities. It is done when each community is one node and none would gain by another.
    ``levels`` and ``rounds`` may stop it sooner. Labels are numbered from 0.
    ``gammas`` are the resolutions of all samples, or a table ``(sample, gamma)``.
    Groups whose graph has, or has come down to, ``_SMALL`` rows take the same steps in one task each.
    """
    group = [KEY, "gamma"]
    if isinstance(gammas, DataFrame):
        grid, on = gammas.select(KEY, "gamma").distinct(), KEY
    else:
        grid, on = edges.sparkSession.createDataFrame([(g,) for g in gammas], "gamma double"), None
    edges = cut(edges.select(KEY, "src", "dst", "w"))
    e = edges.join(grid, on) if on else edges.crossJoin(F.broadcast(grid))  # a list of resolutions is a parameter
    e = e.filter("src <> dst").select(*group, "src", "dst", "w")
    both = e.toDF(*group, "node", "other", "w").unionByName(e.toDF(*group, "other", "node", "w")).groupBy(*group, "node", "other").agg(F.sum("w").alias("w"))
    m = edges.groupBy(KEY).agg(F.sum("w").alias("m"))
    node = strengths(edges).join(m, KEY)
    comm = cut((node.join(grid, on) if on else node.crossJoin(F.broadcast(grid))).select(*group, "node", "k", "m", F.col("node").alias("c")))
    where = comm.select(*group, F.col("node").alias("spot"), "node")
    key, node_type = (edges.schema[c].dataType.simpleString() for c in (KEY, "src"))
    settled = []
    for level in itertools.count():
        both = cut(both)
        few = cut(comm.select(group).unionByName(both.select(group)).groupBy(*group).agg((F.count(F.lit(1)) <= _SMALL).alias("few")))
        small, large = few.filter("few"), few.filter("NOT few")
        if not small.isEmpty():
            ends = both.join(small, group, "left_semi").groupBy(*group).cogroup(comm.join(small, group, "left_semi").groupBy(*group))
            ends = ends.applyInPandas(_levels(level, levels, rounds), f"{KEY} {key}, gamma double, node {node_type}, name {node_type}")
            settled.append(cut(where.join(small, group, "left_semi").join(ends, [*group, "node"]).select(*group, "spot", F.col("name").alias("node"))))
            if large.isEmpty():
                break
            both, comm, where = (cut(t.join(large, group, "left_semi")) for t in (both, comm, where))
        start = comm
        for turn in itertools.count(1):
            comm = cut(_move_round(both, comm, group))
            if turn == rounds or comm.filter("moved").isEmpty():
                break
        at = lambda n, name: comm.select(*group, F.col("node").alias(n), F.col("c").alias(name))  # noqa: B023, E731
        inside = cut(both.join(at("node", "ca"), [*group, "node"]).join(at("other", "cb"), [*group, "other"]).filter("ca = cb").select(*group, "node", "other", "w"))
        last = level + 1 == levels
        parts = comm.select(*group, "node", "k", "m", "c", F.col("node").alias("part"))
        while not last and not inside.isEmpty():
            parts = cut(_refine_round(inside, parts, group))
            if parts.filter("joined").isEmpty():
                break
        state = parts.join(start.select(*group, "node", F.col("c").alias("before")), [*group, "node"]).groupBy(*group).agg(
            F.max((F.col("c") != F.col("before")).cast("int")).alias("moved"), F.max((F.col("part") != F.col("node")).cast("int")).alias("merged"), (F.count_distinct("c") < F.count(F.lit(1))).alias("several")
        )
        state = cut(state)
        still = state.filter("true" if last else "moved = 0 AND merged = 0 AND several")
        named = parts.withColumn("name", F.col("part"))
        if not still.isEmpty():
            pieces = components(inside.join(still, group, "left_semi"), comm.join(still, group, "left_semi"), group).select(*group, "node", F.col("part").alias("piece"))
            named = parts.join(pieces, [*group, "node"], "left").withColumns({"name": F.coalesce("piece", "part"), "c": F.coalesce("piece", "c")})
        named = cut(named.select(*group, "node", "k", "m", "name", "c"))
        where = cut(where.join(named.select(*group, "node", "name"), [*group, "node"]).select(*group, "spot", F.col("name").alias("node")))
        if last or state.filter("moved = 1 OR merged = 1 OR several").isEmpty():
            settled.append(where)
            break
        comm = cut(named.groupBy(*group, F.col("name").alias("node")).agg(F.sum("k").alias("k"), F.max("m").alias("m"), F.max("c").alias("c")))
        for c in ("node", "other"):
            both = both.join(named.select(*group, F.col("node").alias(c), "name"), [*group, c]).drop(c).withColumnRenamed("name", c)
        both = both.filter("node <> other").groupBy(*group, "node", "other").agg(F.sum("w").alias("w"))
    where = functools.reduce(DataFrame.unionByName, settled)
    # the communities are numbered, not their spots
    label = where.select(*group, "node").distinct().withColumn("label", F.row_number().over(Window.partitionBy(*group).orderBy("node")) - 1)
    return where.join(label, [*group, "node"]).select(*group, "spot", "label")


def resolution_select(found: DataFrame, k: int) -> DataFrame:
    """Of rows ``(sample, gamma, n_labels, place)`` the first exact one, else the nearest, then the smaller gamma."""
    gap = F.abs(F.col("n_labels") - k)
    best = F.struct(gap.alias("gap"), F.when(gap == 0, F.col("place")).otherwise(0).alias("p"), F.col("gamma").alias("gamma"))
    return found.groupBy(KEY).agg(F.min_by(F.struct("gamma", "n_labels"), best).alias("b")).select(KEY, "b.gamma", "b.n_labels", (F.col("b.n_labels") == k).alias("exact"))


# The resolutions that are tried first.
CANDIDATES = (0.01, 0.02, 0.05, 0.10, 0.20, 0.50, 1.0, 2.0, 5.0, 10.0)


def _between(bounds: DataFrame, n: int, ends: bool) -> DataFrame:
    """(sample, gamma, step): ``n`` resolutions in equal ratios between ``low`` and ``high``, the ends among them or not."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(n - 1)) if ends else F.sequence(F.lit(1), F.lit(n))).alias("step")
    share = F.col("step") / F.lit(n - 1 if ends else n + 1)
    return bounds.select(KEY, "low", "high", steps).select(KEY, (F.col("low") * F.pow(F.col("high") / F.col("low"), share)).alias("gamma"), "step")


@tidy
def resolution_search(edges: DataFrame, k: int, fit=community_fit) -> tuple[DataFrame, DataFrame]:
    """(choice, labels): per sample the resolution whose communities number ``k``, else the nearest, and its labels.

    The candidates come first. A sample without an exact one is searched between
    its last resolution below ``k`` and its first above: six rounds of seven
    inner resolutions (as 18 bisections, 2^18), then 60 in the last bracket.
    A sample without such a bracket is scanned at 90 resolutions of [0.005, 10].
    Each round is one fit of all samples that are still open.
    """
    edges = cut(edges.select(KEY, "src", "dst", "w"))
    samples = cut(edges.select(KEY).distinct())
    grid = samples.select(KEY, F.posexplode(F.array(*map(F.lit, CANDIDATES))).alias("step", "gamma"))
    found = labels = None
    for r in range(8):
        grid = cut(grid.select(KEY, "gamma", (F.lit(100 * r) + F.col("step")).alias("place")))
        if grid.isEmpty():
            break
        now = cut(fit(edges.join(F.broadcast(grid.select(KEY).distinct()), KEY, "left_semi"), grid.select(KEY, "gamma")))
        counts = now.groupBy(KEY, "gamma").agg(F.countDistinct("label").alias("n_labels")).join(grid, [KEY, "gamma"])
        found = cut(counts if found is None else found.unionByName(counts))
        chosen = resolution_select(found, k)
        labels = now if labels is None else labels.unionByName(now)
        labels = cut(labels.join(F.broadcast(chosen.select(KEY, "gamma")), [KEY, "gamma"], "left_semi"))
        open_ = chosen.filter("NOT exact").select(KEY)
        w = Window.partitionBy(KEY).orderBy("gamma")
        gap = F.col("n_labels") - k
        pairs = found.join(F.broadcast(open_), KEY).select(KEY, F.col("gamma").alias("low"), gap.alias("gap"), F.lead("gamma").over(w).alias("high"), F.lead(gap).over(w).alias("next"))
        crossed = pairs.filter(F.col("gap") * F.col("next") < 0).groupBy(KEY).agg(F.min_by(F.struct("low", "high"), F.struct(F.col("gap") > 0, F.col("low"))).alias("b")).select(KEY, "b.low", "b.high")
        grid = _between(crossed, 60, True) if r == 6 else _between(crossed, 7, False)
        if r == 0:
            wide = open_.join(crossed, KEY, "left_anti").select(KEY, F.lit(0.005).alias("low"), F.lit(10.0).alias("high"))
            grid = grid.unionByName(_between(wide, 90, True))
    return resolution_select(found, k), labels


# --- soft assignment -----------------------------------------------------------


def soft_assign(points: DataFrame, centroids: DataFrame, alpha: float = 0.2) -> DataFrame:
    """(sample, spot, label, q, p): Student-t similarity to each centroid, row-normalised, and its sharpened target."""
    pairs = points.select(KEY, "spot", "f").join(F.broadcast(centroids.select("label", F.col("f").alias("c"))))
    raw = F.pow(1 / (1 + squared_distance(F.col("f"), F.col("c")) / alpha + 1e-8), (alpha + 1) / 2)
    row, column = Window.partitionBy(KEY, "spot"), Window.partitionBy(KEY, "label")
    q = pairs.select(KEY, "spot", "label", raw.alias("raw")).withColumn("q", F.col("raw") / F.sum("raw").over(row))
    total = q.groupBy(KEY, "label").agg(F.sum("q").alias("total"))
    t = q.join(F.broadcast(total), [KEY, "label"]).withColumn("t", F.col("q") * F.col("q") / F.col("total"))
    return t.withColumn("p", F.col("t") / F.sum("t").over(row)).select(KEY, "spot", "label", "q", "p")


def soft_labels(soft: DataFrame) -> DataFrame:
    return soft.groupBy(KEY, "spot").agg(F.min_by("label", F.struct((-F.col("q")).alias("q"), F.col("label"))).alias("label"))


def kl(soft: DataFrame) -> DataFrame:
    """Mean over spots of sum p log(p / (q + 1e-6))."""
    one = soft.groupBy(KEY, "spot").agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("q") + 1e-6))).alias("d"))
    return one.groupBy(KEY).agg(F.avg("d").alias("kl"))


# --- checks and exchange -------------------------------------------------------


def change_rate(before: DataFrame, after: DataFrame, bar: float = 0.005) -> DataFrame:
    """Share of spots whose label changed, and whether it is below the bar."""
    both = before.select(KEY, "spot", F.col("label").alias("a")).join(after.select(KEY, "spot", F.col("label").alias("b")), [KEY, "spot"])
    return both.groupBy(KEY).agg(F.avg((F.col("a") != F.col("b")).cast("double")).alias("rate")).withColumn("stop", F.col("rate") < bar)


def exact_k_failures(labels: DataFrame, k: int) -> DataFrame:
    """Failure rows of runs without exactly k labels."""
    g = labels.groupBy(KEY, "seed").agg(F.countDistinct("label").alias("n_labels")).filter(F.col("n_labels") != k)
    return g.withColumns({"failure_type": F.lit("exact_k"), "error_message": F.concat(F.lit(f"expected {k} labels, found "), F.col("n_labels"))})


def run_plan(methods: DataFrame, ks: DataFrame, seeds: DataFrame) -> DataFrame:
    """(method, K, seed): each method with its first ``n_seeds`` seeds in the order asked for; all when it is null."""
    grid = methods.join(F.broadcast(ks)).join(F.broadcast(seeds))
    r = F.row_number().over(Window.partitionBy("method_id", "K").orderBy("place"))
    return grid.withColumn("r", r).filter(F.col("n_seeds").isNull() | (F.col("r") <= F.col("n_seeds"))).select("method_id", "K", "seed")


def reference_seed(runs: DataFrame, requested: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The first requested seed that succeeded, else the smallest that did."""
    ok = runs.filter("status = 'success'").join(F.broadcast(requested), "seed", "left")
    return ok.groupBy(*keys).agg(F.coalesce(F.min_by("seed", "place"), F.min("seed")).alias("reference_seed"))


DOMAIN_MAP = {"dataset_id": "string", "sample_id": "string", "method_id": "string", "K": "int", "seed": "int", "barcode": "string", "x": "double", "y": "double", "domain_label": "int", "notes": "string"}


def import_domain_map(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of labels made elsewhere: columns cast by name, those without sample or with a label below 1 are bad."""
    cast = rows.select(*((F.col(c).try_cast(k) if c in rows.columns else F.lit(None).cast(k)).alias(c) for c, k in DOMAIN_MAP.items()))
    good = F.coalesce((F.col("domain_label") >= 1) & F.col("sample_id").isNotNull() & F.col("method_id").isNotNull(), F.lit(False))
    return cast.filter(good), cast.filter(~good)


def export_domain_map(labels: DataFrame, spots: DataFrame, reference: DataFrame) -> DataFrame:
    """Labels of each sample's reference seed with coordinates, counted from 1."""
    chosen = labels.join(F.broadcast(reference), [KEY]).filter("seed = reference_seed")
    return chosen.join(spots.select(KEY, "spot", "x", "y"), [KEY, "spot"]).select(KEY, "seed", "spot", "x", "y", (F.col("label") + 1).alias("domain_label"))
