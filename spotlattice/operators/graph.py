"""Exact spatial neighbours and the graphs made of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlattice.operators.lineage import cut, tidy
from spotlattice.operators.normalize import dot, unit
from spotlattice.operators.ranks import quantiles

KEY = "sample_id"


def _cell(v: str) -> Column:
    return F.floor(F.col(v) / F.col("c"))


def _ring() -> Column:
    """The offsets of a cell and its eight neighbours."""
    return F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))


def _key() -> Column:
    return F.xxhash64(KEY, "c", "cx", "cy")


def _places(spots: DataFrame, k: int) -> DataFrame:
    """(sample_id, ox, oy, ids): every place once, with the k + 1 least ids of its spots; no search needs more of them."""
    w = Window.partitionBy(KEY, "x", "y").orderBy("spot")
    least = spots.select(KEY, "spot", "x", "y").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
    return least.groupBy(KEY, F.col("x").alias("ox"), F.col("y").alias("oy")).agg(F.sort_array(F.collect_list("spot")).alias("ids"))


def _first_cells(places: DataFrame, per_cell: float) -> DataFrame:
    """(sample_id, c, extent): the cell size that would hold ``per_cell`` places if they lay evenly."""
    e = places.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), (F.max("ox") - F.min("ox")).alias("dx"), (F.max("oy") - F.min("oy")).alias("dy"))
    extent = F.greatest("dx", "dy")
    even = F.greatest(F.sqrt(F.col("dx") * F.col("dy") * per_cell / F.col("n")), extent * per_cell / F.col("n"))
    return e.select(KEY, F.when(even > 0, even).otherwise(1.0).alias("c"), (extent * 1.0001 + 1e-300).alias("extent"))


def _nearest(queries: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """Of each query the k + 1 nearest spots in the 3 x 3 cells about it, and whether none farther off can be nearer."""
    # a hash comes first in every key, for it is compared faster than a name and two numbers
    place = ["q", KEY, "x", "y", "c", "extent", "full", "crowd"]
    q = queries.select(F.xxhash64(KEY, "x", "y").alias("q"), *place[1:], _ring().alias("o"))
    q = q.select(*place, (_cell("x") + F.col("o.i")).alias("cx"), (_cell("y") + F.col("o.j")).alias("cy")).withColumn("h", _key())
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    pairs = q.join(cells.withColumn("h", _key()), ["h", KEY, "c", "cx", "cy"]).select(*place, (dx * dx + dy * dy).alias("d2"), F.explode("ids").alias("other"))
    # cells that are not crowded give a bounded list, others are ranked first
    w = Window.partitionBy(*place).orderBy("d2", "other")
    few = pairs.filter("crowd").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).drop("r")
    near = pairs.filter("NOT crowd").unionByName(few).groupBy(*place).agg(F.slice(F.sort_array(F.collect_list(F.struct("d2", "other"))), 1, k + 1).alias("near"))
    reach = F.when(F.size("near") > k, F.element_at("near", -1)["d2"])
    return near.withColumn("sure", (F.col("c") >= F.col("extent")) | F.coalesce(reach < F.col("c") * F.col("c"), F.lit(False)))


#: Spots that a block is meant to hold, and from how many on it is left to the search by places.
_BLOCK, _CROWD = 512, 4096
_CHUNK = 512


def _order_of(d2: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` least numbers of each row in their order, equal ones by column."""
    n = d2.shape[1]
    some = min(k + 8, n)
    few = np.argpartition(d2, some - 1, axis=1)[:, :some] if some < n else np.broadcast_to(np.arange(n), d2.shape)
    value = np.take_along_axis(d2, few, 1)
    order = np.lexsort((few, value), axis=1)
    few, value = np.take_along_axis(few, order, 1)[:, :k], np.take_along_axis(value, order, 1)
    if some < n:  # more numbers may equal the last one than were looked at
        doubtful = np.flatnonzero(value[:, -1] == value[:, min(k, some) - 1])
        few[doubtful] = np.argsort(d2[doubtful], axis=1, kind="stable")[:, :k]
    return few


def _block_search(k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The nearest of a block's own spots among those of the block and of the margin about it."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("spot", kind="stable")
        x, y, spot = (rows[c].to_numpy() for c in ("x", "y", "spot"))
        own = np.flatnonzero(rows["own"].to_numpy())
        one = rows.iloc[0]
        # beyond these distances there may be spots that the block does not see; past the sample's ends there are none
        sides = []
        for u, at, extent in (("u", one["bx"], one["ex"]), ("v", one["by"], one["ey"])):
            low, high = at * one["side"] - one["margin"], (at + 1) * one["side"] + one["margin"]
            place = rows[u].to_numpy()[own]
            sides += [place - low if low > 0 else np.full(len(own), np.inf), high - place if high <= extent else np.full(len(own), np.inf)]
        sees = np.minimum.reduce(sides) * (1 - 1e-9)
        take = min(k, len(x) - 1)
        others, distances, sure = [], [], []
        for i in range(0, len(own), _CHUNK):
            q = own[i : i + _CHUNK]
            dx, dy = x[q][:, None] - x, y[q][:, None] - y
            d2 = dx * dx + dy * dy
            d2[np.arange(len(q)), q] = np.inf
            near = _order_of(d2, take) if take else np.empty((len(q), 0), int)
            value = np.take_along_axis(d2, near, 1)
            reach = np.sqrt(value[:, -1]) if take == k else np.full(len(q), np.inf)
            others += list(spot[near])
            distances += list(value)
            sure.append((reach < sees[i : i + _CHUNK]) | np.isinf(sees[i : i + _CHUNK]))
        return pd.DataFrame({KEY: rows[KEY].to_numpy()[own], "spot": spot[own], "others": pd.Series(others, dtype=object), "d2": pd.Series(distances, dtype=object), "sure": np.concatenate([np.empty(0, bool), *sure])})

    return work


@tidy
def knn(spots: DataFrame, k: int, per_cell: float | None = None) -> DataFrame:
    """(sample_id, spot, other, rank, d2): the exact k nearest other spots, ties by spot id.

    Spots are dealt to square blocks of about ``_BLOCK``, and to the blocks in whose margin
    they lie; a block is searched in one task, in one shuffle for all of them. A spot whose last
    neighbour is nearer than the margin's far side has its answer. Spots of crowded
    blocks and those left without proof are searched by places (``_by_places``). Samples with
    k spots or fewer give all there are.
    """
    kind = spots.schema["spot"].dataType
    spots = spots.select(KEY, F.col("spot").cast("bigint").alias("spot"), *(F.col(c).cast("double").alias(c) for c in "xy"))
    e = spots.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), *(f for c in "xy" for f in (F.min(c).alias(f"{c}0"), (F.max(c) - F.min(c)).alias(f"e{c}"))))
    even = F.greatest(F.sqrt(F.col("ex") * F.col("ey") * _BLOCK / F.col("n")), F.greatest("ex", "ey") * _BLOCK / F.col("n"))
    side = F.when(even > 0, even).otherwise(1.0)
    # the margin is twice and a half the distance at which the last neighbour is expected
    margin = F.least(side * 2.5 * (((k + 1) / (3.141592653589793 * _BLOCK)) ** 0.5), side * 0.49)
    sizes = cut(e.select(KEY, "x0", "y0", "ex", "ey", side.alias("side"), margin.alias("margin")))
    at = spots.join(sizes, KEY).withColumns({"u": F.col("x") - F.col("x0"), "v": F.col("y") - F.col("y0")})
    block = lambda c: F.floor(c / F.col("side"))
    about = lambda c: F.explode(F.sequence(block(F.col(c) - F.col("margin")), block(F.col(c) + F.col("margin"))))
    at = at.withColumn("bx", about("u")).withColumn("by", about("v"))
    at = at.withColumn("own", (F.col("bx") == block(F.col("u"))) & (F.col("by") == block(F.col("v"))))
    crowded = cut(at.groupBy(KEY, "bx", "by").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > _CROWD).select(KEY, "bx", "by"))
    calm = at
    rest = spots.limit(0)
    if not crowded.isEmpty():
        calm = at.join(crowded, [KEY, "bx", "by"], "left_anti")
        rest = at.filter("own").join(crowded, [KEY, "bx", "by"], "left_semi").select(KEY, "spot", "x", "y")
    columns = f"{KEY} {spots.schema[KEY].dataType.simpleString()}, spot bigint, others array<bigint>, d2 array<double>, sure boolean"
    found = cut(calm.select(KEY, "spot", "x", "y", "u", "v", "bx", "by", "own", "side", "margin", "ex", "ey").groupBy(KEY, "bx", "by").applyInPandas(_block_search(k), columns))
    rest = rest.unionByName(spots.join(found.filter("NOT sure").select(KEY, "spot"), [KEY, "spot"], "left_semi"))
    out = found.filter("sure").select(KEY, "spot", F.posexplode(F.arrays_zip(F.col("others").alias("other"), F.col("d2").alias("d2"))).alias("rank", "n")).select(KEY, "spot", "n.other", (F.col("rank") + 1).alias("rank"), "n.d2")
    rest = cut(rest)
    if not rest.isEmpty():
        out = out.unionByName(_by_places(spots, rest, k, per_cell or max(2.0, 0.7 * k)))
    return out.select(KEY, F.col("spot").cast(kind).alias("spot"), F.col("other").cast(kind).alias("other"), "rank", "d2")


def _by_places(spots: DataFrame, asked: DataFrame, k: int, per_cell: float) -> DataFrame:
    """``knn`` of the spots ``asked``, whatever their density.

    Places, not spots, are searched, so any number of spots at one place costs one
    search. Grid cells turn it into an equi join; every place has a cell size of its own.
    A place next to a cell of more than ``32 per_cell`` places is searched in cells
    of an eighth of the size; one whose last neighbour is not proven by the cell size, in
    cells eight times as large. Each pass is written once.
    """
    places = cut(_places(spots, k))
    open_ = asked.select(KEY, "x", "y").distinct().join(_first_cells(places, per_cell), KEY).withColumn("full", F.lit(False))
    found = None
    while True:
        sizes = open_.select(KEY, "c").distinct()
        cells = places.join(sizes, KEY).select(KEY, "c", "ox", "oy", "ids", _cell("ox").alias("cx"), _cell("oy").alias("cy"))
        crowded = cells.groupBy(KEY, "c", "cx", "cy").count().filter(F.col("count") > 32 * per_cell).select(KEY, "c", "cx", "cy")
        about = crowded.withColumn("o", _ring()).select(KEY, "c", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy")).distinct()
        # a place that was not proven in smaller cells, or whose cells are as fine as numbers go, is searched in full ones
        at = open_.select("*", _cell("x").alias("cx"), _cell("y").alias("cy"), (F.col("full") | (F.col("c") < 1e-12 * F.col("extent"))).alias("take"))
        at = at.join(about.withColumn("crowd", F.lit(True)), [KEY, "c", "cx", "cy"], "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
        at = at.withColumn("take", F.col("take") | ~F.col("crowd"))
        got = _nearest(at.filter("take").select(KEY, "x", "y", "c", "extent", "full", "crowd"), cells, k)
        finer = at.filter("NOT take").select(KEY, "x", "y", (F.col("c") / 8).alias("c"), "extent", "full", F.lit(None).cast("array<struct<d2:double,other:bigint>>").alias("near"), F.lit(False).alias("sure"))
        step = cut(got.select(KEY, "x", "y", F.when(F.col("sure"), F.col("c")).otherwise(F.least(F.col("c") * 8, "extent")).alias("c"), "extent", F.lit(True).alias("full"), F.col("near").cast("array<struct<d2:double,other:bigint>>").alias("near"), "sure").unionByName(finer))
        sure = step.filter("sure").select(KEY, "x", "y", "near")
        found = sure if found is None else found.unionByName(sure)
        open_ = step.filter("NOT sure").select(KEY, "x", "y", "c", "extent", "full")
        if open_.isEmpty():
            break
    both = asked.select(KEY, "spot", "x", "y").join(found, [KEY, "x", "y"])
    others = F.slice(F.filter("near", lambda s: s["other"] != F.col("spot")), 1, k)
    out = both.select(KEY, "spot", F.posexplode(others).alias("rank", "n"))
    return out.select(KEY, "spot", "n.other", (F.col("rank") + 1).alias("rank"), "n.d2")


def coherence_neighbours(spots: DataFrame) -> DataFrame:
    """Ranks 2 to 7: the nearest is left out."""
    return knn(spots, 7).filter("rank >= 2").select(KEY, F.col("spot").alias("src"), F.col("other").alias("dst"), "rank")


def symmetric_graph(neighbours: DataFrame, spots: DataFrame) -> DataFrame:
    """Each neighbour in both directions, and every spot with itself."""
    one = neighbours.select(KEY, F.col("spot").alias("src"), F.col("other").alias("dst"))
    both = one.unionByName(one.select(KEY, F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.unionByName(spots.select(KEY, F.col("spot").alias("src"), F.col("spot").alias("dst"))).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(KEY, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a < b").distinct()


#: Edges, each in both directions, up to which the pieces of a group are found in one task.
_SMALL = 500_000


def _pieces(group: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The least node of each connected piece of one small group."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate([rows["node"].to_numpy(), rows["other"].to_numpy()]), return_inverse=True)
        a, b, part = at[: len(rows)], at[len(rows) :], np.arange(len(ids))
        while len(a):
            near = np.arange(len(ids))
            np.minimum.at(near, a, b)
            np.minimum.at(near, b, a)
            while (near[near] != near).any():
                near = near[near]
            part, a, b = near[part], near[a], near[b]
            a, b = a[a != b], b[a != b]
        one = rows.iloc[[0] * len(ids)][group].reset_index(drop=True)
        return one.assign(node=ids, to=ids[part])

    return work


@tidy
def components(inside: DataFrame, nodes: DataFrame, group: list[str]) -> DataFrame:
    """(group, node, part): the least node of each connected piece of the edges ``inside``.

    Each round every node takes its least neighbour's name if that is less than its own, names are followed to the end, and the
    edges between what is left go on: all but nodes less than their neighbours drop out. Groups with ``_SMALL`` edges or fewer end in one task each.
    """
    named = cut(nodes.select(*group, "node", F.col("node").alias("part")))
    edges = cut(inside.select(*group, "node", "other").filter("node <> other"))
    columns = ", ".join(f"{n} {edges.schema[c].dataType.simpleString()}" for n, c in [*((c, c) for c in group), ("node", "node"), ("to", "node")])
    while not edges.isEmpty():
        few = cut(edges.groupBy(*group).agg((F.count(F.lit(1)) <= _SMALL).alias("few")))
        large = edges.join(few.filter("NOT few"), group, "left_semi")
        hook = cut(large.groupBy(*group, "node").agg(F.min("other").alias("to")).withColumn("to", F.least("node", "to")))
        while not hook.isEmpty():
            far = hook.select(*group, F.col("node").alias("to"), F.col("to").alias("farther"))
            hook = cut(hook.join(far, [*group, "to"]).select(*group, "node", F.col("to").alias("before"), F.col("farther").alias("to")))
            ended = hook.filter("before <> to").isEmpty()
            hook = hook.drop("before")
            if ended:
                break
        ends = edges.join(few.filter("few"), group, "left_semi").groupBy(*group).applyInPandas(_pieces(group), columns)
        moved = cut(hook.unionByName(ends))
        named = cut(named.join(moved.select(*group, F.col("node").alias("part"), "to"), [*group, "part"], "left").select(*group, "node", F.coalesce("to", "part").alias("part")))
        for c in ("node", "other"):
            large = large.join(hook.select(*group, F.col("node").alias(c), "to"), [*group, c]).drop(c).withColumnRenamed("to", c)
        edges = cut(large.filter("node <> other").select(*group, "node", "other").distinct())
    return named


#: Cells of this many spots or fewer are not cut further: their spots are compared one by one.
_FEW = 16
#: The finest cells have this share of the extent, as a power of two.
_DEEPEST = 40


def _between(low: str, high: str, at: str) -> tuple[Column, Column]:
    """Least and largest distance along one axis of two intervals, of the own box and of the cell's box ``at``."""
    a0, a1, b0, b1 = F.col(f"a.{low}"), F.col(f"a.{high}"), F.col(f"{at}.{low}"), F.col(f"{at}.{high}")
    return F.greatest(F.lit(0.0), b0 - a1, a0 - b1), F.greatest(b1 - a0, a1 - b0)


def _shortest_ties(spots: DataFrame) -> DataFrame:
    """(sample, comp, a, b, d2): of spots ``(sample, spot, x, y, comp)`` the shortest tie of each component to a spot of another.

    Pairs of a component's cell and a cell with other components are halved level by level, all components at
    once. The least of the largest distances of its pairs bounds a component's shortest tie from above; pairs farther
    apart go. When no cell that is left has many spots, the spots are compared.
    """
    size = spots.groupBy(KEY).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("extent"))
    fine = lambda c: F.least(F.floor((F.col(c) - F.col(f"{c}0")) / F.when(F.col("extent") > 0, F.col("extent")).otherwise(1.0) * float(2**_DEEPEST)), F.lit(2**_DEEPEST - 1))
    s = cut(spots.join(size, KEY).select(KEY, "spot", "x", "y", "comp", fine("x").cast("bigint").alias("fx"), fine("y").cast("bigint").alias("fy")))
    box = [f(c).alias(n) for c in "xy" for f, n in ((F.min, f"{c}_low"), (F.max, f"{c}_high"))]
    several = s.groupBy(KEY).agg((F.min("comp") < F.max("comp")).alias("more")).filter("more").select(KEY)
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("ax", "ay", "bx", "by")]
    live = s.join(several, KEY, "left_semi").select(KEY, "comp").distinct().select(KEY, "comp", *zero)
    for level in range(1, _DEEPEST + 1):
        cell = lambda c: F.shiftright(F.col(c), _DEEPEST - level)  # noqa: B023, E731
        up = lambda c: F.shiftright(F.col(c), 1)
        at = s.withColumns({"cx": cell("fx"), "cy": cell("fy")})
        own = at.groupBy(KEY, "comp", "cx", "cy").agg(*box)
        all_ = at.groupBy(KEY, "cx", "cy").agg(*box, F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("n"))
        a = own.select(KEY, "comp", F.col("cx").alias("nx"), F.col("cy").alias("ny"), up("cx").alias("ax"), up("cy").alias("ay"), F.struct("x_low", "x_high", "y_low", "y_high").alias("a"))
        b = all_.select(KEY, F.col("cx").alias("mx"), F.col("cy").alias("my"), up("cx").alias("bx"), up("cy").alias("by"), F.struct("x_low", "x_high", "y_low", "y_high").alias("b"), "least", "most", "n")
        pairs = live.join(a, [KEY, "comp", "ax", "ay"]).join(b, [KEY, "bx", "by"]).filter("least <> comp OR most <> comp")
        (dx0, dx1), (dy0, dy1) = _between("x_low", "x_high", "b"), _between("y_low", "y_high", "b")
        pairs = pairs.select(KEY, "comp", F.col("nx").alias("ax"), F.col("ny").alias("ay"), F.col("mx").alias("bx"), F.col("my").alias("by"), "n", (dx0 * dx0 + dy0 * dy0).alias("near"), (dx1 * dx1 + dy1 * dy1).alias("far"))
        pairs = cut(pairs)
        bound = pairs.groupBy(KEY, "comp").agg((F.min("far") * (1 + 1e-12)).alias("bound"))
        live = cut(pairs.join(bound, [KEY, "comp"]).filter("near <= bound").select(KEY, "comp", "ax", "ay", "bx", "by", "n"))
        most = live.agg(F.max("n")).first()[0]
        if most is None or most <= _FEW:
            break
        live = live.drop("n")
    place = s.select(KEY, "spot", "x", "y", "comp", F.shiftright("fx", _DEEPEST - level).alias("cx"), F.shiftright("fy", _DEEPEST - level).alias("cy"))
    a = place.select(KEY, "comp", F.col("spot").alias("a"), "x", "y", F.col("cx").alias("ax"), F.col("cy").alias("ay"))
    b = place.select(KEY, F.col("comp").alias("other"), F.col("spot").alias("b"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    d2 = (F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) + (F.col("y") - F.col("v")) * (F.col("y") - F.col("v"))
    pairs = live.join(a, [KEY, "comp", "ax", "ay"]).join(b, [KEY, "bx", "by"]).filter("comp <> other")
    best = F.min(F.struct(d2.alias("d2"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return pairs.groupBy(KEY, "comp").agg(best.alias("t")).select(KEY, "comp", "t.a", "t.b", "t.d2")


@tidy
def connect(spots: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample_id, a, b): the undirected edges, and the shortest ties that make each sample's graph one piece.

    Each round every piece takes its shortest tie to another one, ties of equal
    length by their spots, so the number of pieces is halved at least.
    """
    spots = cut(spots.select(KEY, "spot", "x", "y"))
    found = cut(edges.select(KEY, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    both = lambda e: e.select(KEY, F.col("a").alias("node"), F.col("b").alias("other")).unionByName(e.select(KEY, F.col("b").alias("node"), F.col("a").alias("other")))
    comp = components(both(found), spots.select(KEY, F.col("spot").alias("node")), [KEY]).select(KEY, F.col("node").alias("spot"), F.col("part").alias("comp"))
    while not comp.groupBy(KEY).agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a < b").isEmpty():
        ties = cut(_shortest_ties(spots.join(comp, [KEY, "spot"])).select(KEY, "a", "b").distinct())
        found = found.unionByName(ties)
        at = lambda c: comp.select(KEY, F.col("spot").alias(c), F.col("comp").alias(f"c{c}"))  # noqa: B023, E731
        tied = ties.join(at("a"), [KEY, "a"]).join(at("b"), [KEY, "b"]).select(KEY, F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = components(both(tied), comp.select(KEY, F.col("comp").alias("node")).distinct(), [KEY])
        comp = cut(comp.join(merged.select(KEY, F.col("node").alias("comp"), "part"), [KEY, "comp"]).select(KEY, "spot", F.col("part").alias("comp")))
    return found


def edge_weights(graph: DataFrame, embedding: DataFrame) -> DataFrame:
    """Edges src < dst with weight max(0, (1 + cosine) / 2)."""
    f = embedding.select(KEY, "spot", unit(F.col("f")).alias("u"))
    a, b = f.select(KEY, F.col("spot").alias("src"), F.col("u").alias("ua")), f.select(KEY, F.col("spot").alias("dst"), F.col("u").alias("ub"))
    e = graph.filter("src < dst").join(a, [KEY, "src"]).join(b, [KEY, "dst"])
    return e.select(KEY, "src", "dst", F.greatest(F.lit(0.0), (1 + dot(F.col("ua"), F.col("ub"))) / 2).alias("w"))


def edge_failures(spots: DataFrame, edges: DataFrame) -> DataFrame:
    """A failure row for each sample without an edge between two of its spots."""
    none = spots.select(KEY).distinct().join(edges.filter("src <> dst").select(KEY).distinct(), KEY, "left_anti")
    return none.withColumns({"failure_type": F.lit("no_edges"), "error_message": F.lit("the graph has no edges")})


def lattice_neighbours(lists: DataFrame, spots: DataFrame) -> DataFrame:
    """(sample_id, src, dst) of comma lists ``(sample_id, spot, neighbours)``; what is no spot goes."""
    e = lists.select(KEY, F.col("spot").alias("src"), F.explode(F.split("neighbours", ",")).alias("t")).select(KEY, "src", F.trim("t").try_cast("bigint").alias("dst")).filter("dst IS NOT NULL")
    return e.join(spots.select(KEY, F.col("spot").alias("dst")), [KEY, "dst"], "left_semi").select(KEY, "src", "dst")


#: Spots that a block of the affinity sums is meant to hold.
_SUMMED = 4096


def _block_rows(rows: pd.DataFrame) -> pd.DataFrame:
    """A block as one row with its box; blocks that cover the same ground are told apart by ``part``."""
    x, y = rows["x"].to_numpy(np.float64), rows["y"].to_numpy(np.float64)
    one = rows.iloc[0]
    return pd.DataFrame({KEY: [one[KEY]], "block": [f"{one['bx']}|{one['by']}|{one['part']}"], "x0": [x.min()], "x1": [x.max()], "y0": [y.min()], "y1": [y.max()], "x": [x.tobytes()], "y": [y.tobytes()]})


def _block_sums(lengths: list[float]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Affinities between two blocks, per length; the pairs of two different blocks count in both directions."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair in batch.itertuples(index=False):
                ax, ay, bx, by = (np.frombuffer(v, np.float64) for v in (pair.ax, pair.ay, pair.bx, pair.by))
                sums = np.zeros(len(lengths))
                for i in range(0, len(ax), _CHUNK):
                    dx, dy = ax[i : i + _CHUNK, None] - bx, ay[i : i + _CHUNK, None] - by
                    d2 = dx * dx + dy * dy
                    for j, l in enumerate(lengths):  # noqa: E741
                        sums[j] += np.exp(d2[d2 <= 36 * l * l] / (-2 * l * l)).sum()
                yield pd.DataFrame({KEY: [getattr(pair, KEY)] * len(lengths), "l": lengths, "s": sums * (1 if pair.a == pair.b else 2)})

    return work


@tidy
def affinity_mass(spots: DataFrame, lengths: list[float]) -> DataFrame:
    """(sample_id, l, mass): mean over spots of the Gaussian affinity to the others, cut at six lengths.

    All lengths are taken in one pass over the pairs within six times the largest. Their number is quadratic in a sample's
    density; they are never rows: spots are packed into blocks of about ``_SUMMED``, and two blocks near enough
    are summed in one row, once for both directions.
    """
    e = spots.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), *(f for c in "xy" for f in (F.min(c).alias(f"{c}0"), (F.max(c) - F.min(c)).alias(f"e{c}"))))
    even = F.greatest(F.sqrt(F.col("ex") * F.col("ey") * _SUMMED / F.col("n")), F.greatest("ex", "ey") * _SUMMED / F.col("n"))
    sizes = cut(e.select(KEY, "n", "x0", "y0", F.when(even > 0, even).otherwise(1.0).alias("side")))
    place = [F.floor((F.col(c) - F.col(f"{c}0")) / F.col("side")).alias(f"b{c}") for c in "xy"]
    at = spots.join(F.broadcast(sizes), KEY).select(KEY, "spot", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *place)
    # crowded blocks are cut into parts of equal size, more or less
    many = at.groupBy(KEY, "bx", "by").agg(F.ceil(F.count(F.lit(1)) / _SUMMED).alias("parts"))
    at = at.join(many, [KEY, "bx", "by"]).withColumn("part", F.pmod(F.xxhash64("spot"), F.col("parts")))
    shape = f"{KEY} {spots.schema[KEY].dataType.simpleString()}, block string, x0 double, x1 double, y0 double, y1 double, x binary, y binary"
    blocks = cut(at.groupBy(KEY, "bx", "by", "part").applyInPandas(_block_rows, shape))
    box = lambda name: blocks.select(KEY, F.col("block").alias(name), *(F.col(f"{c}{i}").alias(f"{name}{c}{i}") for c in "xy" for i in "01"))
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"b{c}0") - F.col(f"a{c}1"), F.col(f"a{c}0") - F.col(f"b{c}1"))
    reach = 6.0 * max(lengths) * (1 + 1e-9)
    near = box("a").join(box("b"), KEY).filter((F.col("a") <= F.col("b")) & (gap("x") * gap("x") + gap("y") * gap("y") <= reach * reach)).select(KEY, "a", "b")
    near = cut(near)
    of = lambda name: blocks.select(KEY, F.col("block").alias(name), *(F.col(c).alias(f"{name}{c}") for c in "xy"))
    # a pair of blocks is much work for its size, so tasks are told by their number
    pairs = near.join(of("a"), [KEY, "a"]).join(of("b"), [KEY, "b"]).repartition(max(1, near.count() // 16))
    sums = pairs.mapInPandas(_block_sums([float(l) for l in lengths]), f"{KEY} {spots.schema[KEY].dataType.simpleString()}, l double, s double")  # noqa: E741
    mass = cut(sums).groupBy(KEY, "l").agg(F.sum("s").alias("s")).join(sizes, KEY)
    return mass.select(KEY, "l", (F.col("s") / F.col("n") - 1).alias("mass"))


#: Most spots of a cell that meet those of another cell in one row, and squared distances of a row.
_MET, _SQUARES = 512, 131_072


def _squares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Squared distances between two cells as far as the reach ``c``, packed sample by sample."""
    held, size = {}, {}

    def row(key):
        d2, size[key] = np.concatenate(held.pop(key)), 0
        return pd.DataFrame({KEY: [key], "d2": [d2.tobytes()]})

    for batch in batches:
        for pair in batch.itertuples(index=False):
            key, ax, ay, bx, by = getattr(pair, KEY), pair.ax, pair.ay, pair.bx, pair.by
            dx, dy = ax[:, None] - bx, ay[:, None] - by
            d2 = dx * dx + dy * dy
            near = d2 <= pair.c * pair.c
            # within a cell every pair would come twice
            found = d2[np.triu(near, 1) if pair.same else near]
            if len(found):
                held.setdefault(key, []).append(found)
                size[key] = size.get(key, 0) + len(found)
                if size[key] >= _SQUARES:
                    yield row(key)
    for key in list(held):
        yield row(key)


def _within(spots: DataFrame, reach: DataFrame) -> DataFrame:
    """(sample_id, d2): squared distances, each pair of spots once, no greater than that of ``reach(sample_id, c)``; packed, pairs are never rows.

    Cells have the size of the reach; a cell meets itself and half of its neighbours. Crowded cells are cut into parts.
    """
    at = spots.join(reach, KEY).select(KEY, "c", "spot", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), _cell("x").alias("cx"), _cell("y").alias("cy")).filter("cx IS NOT NULL AND cy IS NOT NULL")
    many = at.groupBy(KEY, "cx", "cy").agg(F.ceil(F.count(F.lit(1)) / _MET).alias("parts"))
    at = at.join(many, [KEY, "cx", "cy"]).withColumn("part", F.pmod(F.xxhash64("spot"), F.col("parts")))
    cells = cut(at.groupBy(KEY, "c", "cx", "cy", "part").agg(F.collect_list(F.struct("x", "y")).alias("m")))
    half = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)))))
    a = cells.withColumn("o", half).select(KEY, "c", "o", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), F.col("part").alias("pa"), F.col("m.x").alias("ax"), F.col("m.y").alias("ay"))
    b = cells.select(KEY, "cx", "cy", F.col("part").alias("pb"), F.col("m.x").alias("bx"), F.col("m.y").alias("by"))
    inner = (F.col("o.i") == 0) & (F.col("o.j") == 0)
    pairs = a.join(b, [KEY, "cx", "cy"]).filter(~inner | (F.col("pa") <= F.col("pb")))
    pairs = pairs.select(KEY, "c", "ax", "ay", "bx", "by", (inner & (F.col("pa") == F.col("pb"))).alias("same"))
    return pairs.mapInPandas(_squares, f"{KEY} {spots.schema[KEY].dataType.simpleString()}, d2 binary")


def _gaussian_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's sums of affinities, per sample and length, of both directions of a pair."""
    sums: dict = {}
    for batch in batches:
        for row in batch.itertuples(index=False):
            d2 = np.frombuffer(row.d2, np.float64)
            of = sums.setdefault(getattr(row, KEY), {})
            for l in row.ls:  # noqa: E741
                of[l] = of.get(l, 0.0) + 2.0 * float(np.exp(d2 / (-2 * l * l)).sum())
    for key, of in sums.items():
        yield pd.DataFrame({KEY: [key] * len(of), "l": list(of), "s": list(of.values())})


def _masses(pairs: DataFrame, grid: DataFrame, n: DataFrame) -> DataFrame:
    """(sample_id, l, mass) of the lengths ``grid(sample_id, l)``; a sample without pairs has none."""
    few = grid.groupBy(KEY).agg(F.collect_set("l").alias("ls"))
    sums = pairs.join(F.broadcast(few), KEY).mapInPandas(_gaussian_sums, f"{KEY} {pairs.schema[KEY].dataType.simpleString()}, l double, s double")
    mass = sums.groupBy(KEY, "l").agg(F.sum("s").alias("s"))
    return grid.join(mass, [KEY, "l"], "left").join(n, KEY).select(KEY, "l", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mass"))


@tidy
def bandwidth_search(spots: DataFrame, target: float, low: float = 0.01, high: float = 1000.0, tolerance: float = 0.01, width: int = 8, rounds: int = 8) -> DataFrame:
    """(sample_id, l, mass, reached): the length whose mass is nearest to ``target``, all samples at once.

    Mass grows with length and is about ``2 pi l^2`` times the density, which
    gives each sample its first bounds and a reach of a few spots. Bounds that do
    not enclose the target are widened, and the reach with them, until they do or
    are ``low`` and ``high``. Each round then evaluates ``width`` lengths in equal
    ratios between the bounds and narrows them. A sample that misses the target by
    more than the tolerance is not ``reached`` and takes the 5 % quantile of all its positive distances;
    only for such samples are all pairs made.
    """
    e = spots.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("dx"), (F.max("y") - F.min("y")).alias("dy"))
    guess = F.sqrt(target * F.greatest(F.col("dx") * F.col("dy"), F.lit(1e-12)) / (6.283185307179586 * F.col("n")))
    n = cut(spots.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")))
    open_ = cut(e.select(KEY, F.least(F.lit(high / 2), F.greatest(F.lit(low), guess / 20)).alias("lo"), F.greatest(F.lit(2 * low), F.least(F.lit(high), guess * 4)).alias("hi")))
    bounds = pairs = None
    while True:
        near = cut(_within(spots, open_.select(KEY, (6 * F.col("hi")).alias("c"))))
        mass = _masses(near, open_.select(KEY, F.explode(F.array("lo", "hi")).alias("l")), n)
        ends = open_.join(mass.select(KEY, F.col("l").alias("lo"), F.col("mass").alias("at_lo")), [KEY, "lo"]).join(mass.select(KEY, F.col("l").alias("hi"), F.col("mass").alias("at_hi")), [KEY, "hi"])
        up, down = (F.col("at_hi") < target) & (F.col("hi") < high), (F.col("at_lo") > target) & (F.col("lo") > low)
        ends = cut(ends.withColumns({"up": up, "down": down}))
        done = ends.filter("NOT up AND NOT down").select(KEY, "lo", "hi")
        kept = near.join(F.broadcast(done.select(KEY)), KEY, "left_semi")
        bounds, pairs = (done, kept) if bounds is None else (bounds.unionByName(done), pairs.unionByName(kept))
        lo = F.when(F.col("down"), F.greatest(F.lit(low), F.col("lo") / 20)).when(F.col("up"), F.col("hi")).otherwise(F.col("lo"))
        open_ = cut(ends.filter("up OR down").select(KEY, lo.alias("lo"), F.when(F.col("up"), F.least(F.lit(high), F.col("hi") * 4)).otherwise(F.col("hi")).alias("hi")))
        if open_.isEmpty():
            break
    best = None
    for _ in range(rounds):
        grid = bounds.select(KEY, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(width))).alias("i")).select(KEY, (F.col("lo") * F.pow(F.col("hi") / F.col("lo"), F.col("i") / width)).alias("l"))
        best = cut(_masses(pairs, grid.distinct(), n))
        bounds = best.groupBy(KEY).agg(F.coalesce(F.max(F.when(F.col("mass") <= target, F.col("l"))), F.min("l")).alias("lo"), F.coalesce(F.min(F.when(F.col("mass") >= target, F.col("l"))), F.max("l")).alias("hi"))
    near = cut(best.groupBy(KEY).agg(F.min_by(F.struct("l", "mass"), F.struct(F.abs(F.col("mass") - target), F.col("l"))).alias("b")).select(KEY, "b.l", "b.mass"))
    missed = near.filter(F.abs(F.col("mass") - target) > tolerance).select(KEY)
    a = spots.join(F.broadcast(missed), KEY, "left_semi")
    b = a.select(KEY, F.col("spot").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    fallback = a.join(b, KEY).select(KEY, F.sqrt(d2).alias("d")).filter("d > 0")
    fallback = quantiles(fallback, (KEY,), "d", {"q": 0.05})
    return near.join(fallback, KEY, "left").select(KEY, F.coalesce("q", "l").alias("l"), "mass", (F.abs(F.col("mass") - target) <= tolerance).alias("reached"))


def smooth(edges: DataFrame, features: DataFrame) -> DataFrame:
    """(sample_id, spot, feature, v): weighted sum of the neighbours' features."""
    e = edges.join(features.select(KEY, F.col("spot").alias("dst"), "feature", "v"), [KEY, "dst"])
    return e.groupBy(KEY, F.col("src").alias("spot"), "feature").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def edge_attention(edges: DataFrame, features: DataFrame, left: list[float], right: list[float], slope: float = 0.2) -> DataFrame:
    """Attention over each spot's edges with given weights, then the weighted sum of features.

    A spot's own edge is appended even if the graph has one, and then counts twice.
    """
    l_w, r_w = F.array(*map(F.lit, left)), F.array(*map(F.lit, right))
    f = features.select(KEY, "spot", "f", dot(F.col("f"), l_w).alias("fl"), dot(F.col("f"), r_w).alias("fr"))
    both = edges.select(KEY, "src", "dst").unionAll(features.select(KEY, F.col("spot").alias("src"), F.col("spot").alias("dst")))
    e = both.join(f.select(KEY, F.col("spot").alias("src"), "fl"), [KEY, "src"]).join(f.select(KEY, F.col("spot").alias("dst"), "fr", "f"), [KEY, "dst"])
    raw = F.col("fl") + F.col("fr")
    w = Window.partitionBy(KEY, "src")
    e = e.withColumn("s", F.when(raw > 0, raw).otherwise(slope * raw))
    e = e.withColumn("x", F.exp(F.col("s") - F.max("s").over(w)))
    e = e.withColumn("a", F.col("x") / F.sum("x").over(w))
    parts = e.select(KEY, "src", "a", F.posexplode("f").alias("part", "v"))
    return parts.groupBy(KEY, F.col("src").alias("spot"), "part").agg(F.sum(F.col("a") * F.col("v")).alias("v"))
