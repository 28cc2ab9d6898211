"""Operator 9, n-gram Jaccard join: an exact join in the metric space of shingle sets.

Jaccard distance ``d = 1 - |x & y| / |x | y|`` is a metric. Two documents link when
``d <= 0.25``, that is, when ``7 |x ^ y| <= |x| + |y|`` for the symmetric difference.

Each level of the join measures documents against pivots and sees them from there:
seen from a pivot ``b``, a document is the set ``x ^ b``, and ``x ^ y = (x ^ b) ^ (y ^ b)``,
so distances stay what they are while all that copies of ``b`` have in common vanishes.

1. Equal sets are one point, known by the hash of its sorted set. The first pivot is
   the empty set.
2. A level cuts what it sees into regions, one for each shingle that two documents
   or more show. Let ``s = |x ^ b|`` and ``e = s - (|x| + |b|) / 7``; ``x`` links with ``b``
   when ``e <= 0``. By the triangle inequality a partner ``y`` in another component has
   ``|(x ^ b) & (y ^ b)| >= |b| / 7 + (e_x + e_y) / 2``, which is at least ``7 e_x / 8`` for
   ``e_x > 0`` and above ``|b| / 7 + e_x / 2`` otherwise. With one order of shingles for
   all, rare ones first, a document copied into the regions of its first
   ``s - bound + 1`` shingles meets every such partner (``|x| / 4`` of them at the first
   level). Regions with equal members are merged.
3. Windows: members whose sizes, or whose places of the region's shingle, leave no
   room for the overlap that a link needs are not compared, and a member that can
   have no partner in another component leaves the region.
4. In each region the member that shows the fewest rarer shingles becomes pivot; it is
   the most central one. Each document is compared with the pivot with which it shares
   most regions, its nearest one by all that is known, and components are merged.
5. Regions of ``SMALL`` members or fewer are finished by comparing the pairs that the
   windows leave between components; before their whole sets, pairs are held against counts of
   their shingles by part of the hash range, which bound the overlap from above. The members of larger regions are measured
   against the region's pivot, which makes the cell of that pivot, and the join
   recurs on the cells that still hold two components, as seen from their pivots.

No link is lost: a pair is skipped only if it lies in one component already, or if a
bound proves that it is no link. The recursion ends, for a pivot leaves its cell.
A group of near copies costs a few comparisons for each document, for copies of one text
join its component through it, and what does not link with it is sorted by how it differs
from it. Hashes of shingles and sets have 64 bits; equal hashes are taken for equal things.

Everything that grows with the corpus stays in Spark and is cut by tables in the
shared folder, which are deleted at the end but for those that the result reads. Sent
to the tasks is one table of fixed size, a byte for each of ``2^SLOT_BITS`` parts of the
hash range with the logarithm of how often its shingles were seen; it decides the order
of shingles and not the result.

Defined cases: a null or wordless text has an empty set, links with nothing and
is its own component; fewer than five words count as one shingle; very long texts are
taken whole; repeated rows give one row each; ties among pivots go to the least hash; an
empty table gives an empty result; a null id takes part and its component is the smallest
id that is not null (null if there is none); extra columns are ignored by ``join`` and
kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotlattice.llm.common import Tables, shingle_sets, table

SLOT_BITS, PART = 24, 1 << 16
SMALL = 64
_CHUNK = 1_000_000


def signature(s: np.ndarray) -> int:
    """Signed 64-bit hash of a sorted set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def profile(docs: DataFrame) -> DataFrame:
    """Of ``docs(doc_id, key, text)`` rows of two kinds: each document's (doc_id, key, n, sig), and (cell, n) of shingles that a task has seen in several sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def heavy() -> pa.RecordBatch:
            cells = np.concatenate(held)
            held.clear()
            cells.sort()
            edge = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1], [True]]))
            counts = np.diff(edge)
            often = counts > 1
            k = int(often.sum())
            none = pa.nulls(k, pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(counts[often].astype(np.int32)), none, pa.array(cells[edge[:-1][often]].view(np.int64))], ["doc_id", "key", "n", "sig", "cell"])

        for batch in batches:
            ns, sigs = [], []
            for _, s in shingle_sets(batch.column(2)):
                sig = signature(s)
                ns.append(len(s))
                sigs.append(sig)
                if sig not in seen:
                    seen.add(sig)
                    held.append(s)
                    size += len(s)
                if size > _CHUNK:
                    yield heavy()
                    held, size, seen = [], 0, set()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ns, pa.int32()), pa.array(sigs, pa.int64()), pa.nulls(len(ns), pa.int64())], ["doc_id", "key", "n", "sig", "cell"])
        if held:
            yield heavy()

    return docs.mapInArrow(work, "doc_id long, key long, n int, sig long, cell long")


def levels_of(profiled: DataFrame) -> np.ndarray:
    """For each of ``SLOTS`` equal parts of the hash range how frequent its shingles are: the binary logarithm of their counts in all, 0 if none was seen twice.

    Each task makes the bytes of whole parts, so the driver only joins ``SLOTS / PART`` pieces.
    """
    slot = F.shiftrightunsigned("cell", 64 - SLOT_BITS)
    counts = profiled.filter("cell IS NOT NULL").groupBy(slot.alias("slot")).agg(F.sum("n").alias("n"))
    level = (F.floor(F.log2("n")) + 1).cast("int")
    parts = counts.select(F.expr(f"slot div {PART}").alias("part"), F.struct((F.col("slot") % PART).alias("at"), level.alias("level")).alias("one"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = []
            for ones in batch.column(1):
                bytes_ = np.zeros(PART, np.uint8)
                fields = ones.values
                bytes_[fields.field("at").to_numpy()] = fields.field("level").to_numpy()
                pieces.append(bytes_.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, pa.binary())], ["part", "bytes"])

    out = np.zeros(1 << SLOT_BITS, np.uint8)
    for r in parts.groupBy("part").agg(F.collect_list("one").alias("ones")).mapInArrow(packed, "part long, bytes binary").collect():
        out[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.bytes, np.uint8)
    return out


def cells_of(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """(cell, sig, n, pos) of the first cells of every set, rare shingles first."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        seen: set[int] = set()
        cells, sigs, ns, size = [], [], [], 0

        def packed() -> pa.RecordBatch:
            sizes = np.array([len(c) for c in cells], np.int64)
            pos = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.empty(0, np.uint64), *cells]).view(np.int64)),
                    pa.array(np.repeat(np.array(sigs, np.int64), sizes)),
                    pa.array(np.repeat(np.array(ns, np.int32), sizes)),
                    pa.array(pos.astype(np.int32)),
                ],
                ["cell", "sig", "n", "pos"],
            )

        for batch in batches:
            for _, s in shingle_sets(batch.column(0)):
                sig = signature(s)
                if len(s) == 0 or sig in seen:
                    continue
                seen.add(sig)
                n = len(s)
                first = n - (3 * n + 3) // 4 + 1
                heat = levels[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                s = s[np.argsort(heat, kind="stable")]  # of equal levels the lesser hash comes first
                cells.append(s[:first].copy())
                sigs.append(sig)
                ns.append(n)
                size += first
                if size > 200_000:
                    yield packed()
                    cells, sigs, ns, size = [], [], [], 0
                    if len(seen) > 100_000:
                        seen = set()
        yield packed()

    return docs.select("text").mapInArrow(work, "cell long, sig long, n int, pos int")


def first_regions(cells: DataFrame) -> DataFrame:
    """(pivot, cell, sig, n, s, pos) of the cells that two different sets share, once for each set; the pivot is null, the empty set."""
    cells = cells.repartition("cell")
    # all columns are used, so that both sides of the join read one exchange
    shared = cells.groupBy("cell").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.max("n").alias("n"), F.max("pos").alias("pos"))
    shared = shared.filter("lo < hi AND n IS NOT NULL AND pos IS NOT NULL").select("cell")
    cells = cells.groupBy("cell", "sig").agg(F.min("n").alias("n"), F.min("pos").alias("pos")).join(shared.hint("shuffle_hash"), "cell", "left_semi")
    return cells.select(F.lit(None).cast("long").alias("pivot"), "cell", "sig", "n", F.col("n").alias("s"), "pos")


def merged(cells: DataFrame) -> DataFrame:
    """(region, sig, n, s, pos): cells of one pivot with equal members made one region."""
    whole = cells.groupBy("pivot", "cell").agg(F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("sig").cast("decimal(38,0)")).alias("sum"))
    whole = whole.select("cell", F.col("pivot").alias("p"), F.xxhash64("pivot", F.col("sum").cast("string"), "k").alias("region"))
    cells = cells.join(whole, (cells["cell"] == whole["cell"]) & cells["pivot"].eqNullSafe(whole["p"]))
    # the earliest of merged cells is the earliest of each member, for the order is one for all
    return cells.groupBy("region", "sig").agg(F.min("n").alias("n"), F.min("s").alias("s"), F.min("pos").alias("pos"))


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    rows = rows.drop("label")
    if labels is None:
        return rows.withColumn("label", F.col("sig"))
    return rows.join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig"))


def _need(side: str = "") -> Column:
    """What a member of size ``s`` adds to 14 times the overlap that a link needs."""
    return 7 * F.col(f"{side}s") - F.col(f"{side}n")


def _room(side: str = "") -> Column:
    """The most that a partner may add to it: the overlap is at most what stands from the region's shingle on."""
    return 14 * (F.col(f"{side}s") - F.col(f"{side}pos")) - _need(side)


def pruned(regions: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The members that may have a partner in another component of their region."""
    out = _labelled(regions, labels)
    for _ in range(2):
        region = out.groupBy("region").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(_need()).alias("least"), F.max(_room()).alias("most"))
        out = out.join(region.filter("lo < hi"), "region").filter((F.col("least") <= _room()) & (_need() <= F.col("most"))).drop("lo", "hi", "least", "most")
    return out


def _windows() -> Column:
    """Whether members ``p_`` and ``m_`` of a region lie in different components and may link."""
    sizes = 4 * F.least("p_n", "m_n") >= 3 * F.greatest("p_n", "m_n")
    return (F.col("p_label") != F.col("m_label")) & sizes & (_need("p_") <= _room("m_")) & (_need("m_") <= _room("p_"))


def _side(regions: DataFrame, side: str) -> DataFrame:
    return regions.select("region", *(F.col(c).alias(f"{side}{c}") for c in ("sig", "n", "s", "pos", "label")))


def nearest(regions: DataFrame, pivots: DataFrame) -> DataFrame:
    """(a, b): each member with the pivot with which it shares most regions."""
    pairs = _side(regions, "m_").join(_side(regions.join(pivots.select("region", F.col("pivot").alias("sig")), ["region", "sig"]), "p_"), "region").filter(_windows())
    pairs = pairs.groupBy(F.col("p_sig").alias("a"), F.col("m_sig").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    return pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")


def remaining(regions: DataFrame) -> DataFrame:
    """(a, b): the pairs that the windows leave in regions of ``SMALL`` members at most."""
    pairs = _side(regions, "p_").join(_side(regions, "m_"), "region").filter((F.col("p_sig") < F.col("m_sig")) & _windows())
    return pairs.select(F.col("p_sig").alias("a"), F.col("m_sig").alias("b")).distinct()


def counts_of(s: np.ndarray) -> np.ndarray:
    """How many shingles of a sorted set fall in each of ``2^b`` equal parts of the hash range, two to four on average."""
    b = max(0, int(np.log2(max(1, len(s) // 2))))
    return np.bincount((s >> np.uint64(64 - b)).astype(np.int64), minlength=1 << b).astype(np.int16) if b else np.array([min(len(s), 32767)], np.int16)


def _lists(arrays: list[np.ndarray], kind: type) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate([np.empty(0, kind), *arrays])))


def sets_of(docs: DataFrame, wanted: DataFrame, tables: Tables) -> DataFrame:
    """(sig, items, counts): the sorted sets that ``wanted(sig)`` names, once each, and their counts, in buckets of ``sig``: later joins move pairs, not sets."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sigs = [signature(s) for _, s in shingle_sets(batch.column(0))]
            fresh = [x not in seen and not seen.add(x) for x in sigs]
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), batch.column(0)], ["sig", "text"]).filter(pa.array(fresh, pa.bool_()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                part = part.filter(pa.array([x not in seen and not seen.add(x) for x in part.column(0).to_pylist()], pa.bool_()))
                sets = [s for _, s in shingle_sets(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([x.view(np.int64) for x in sets], np.int64), _lists([counts_of(x) for x in sets], np.int16)], ["sig", "items", "counts"])

    texts = docs.select("text").mapInArrow(first, "sig long, text string").join(wanted.hint("shuffle_hash"), "sig", "left_semi")
    return tables.keep_in_buckets(texts.mapInArrow(work, "sig long, items array<long>, counts array<short>"), "sets", "sig")


def _with(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """``pairs(a, b)`` with a column of their sets, as x and y."""
    for end, name in (("a", "x"), ("b", "y")):
        pairs = pairs.hint("shuffle_hash").join(sets.select(F.col("sig").alias(end), F.col(column).alias(name)), end)
    return pairs


def may_link(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose counts allow a link: the overlap is at most the sum of the lesser counts."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda acc, v: acc + v)

    def halved(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(x), F.lit(2)), lambda i: (F.element_at(x, i) + F.element_at(x, i + 1)).cast("short"))

    # sizes within 3 to 4 have equal numbers of parts, or one twice the other
    x = F.when(F.size("x") > F.size("y"), halved(F.col("x"))).otherwise(F.col("x"))
    y = F.when(F.size("y") > F.size("x"), halved(F.col("y"))).otherwise(F.col("y"))
    most = total(F.zip_with(x, y, lambda u, v: F.least(u, v).cast("int")))
    return _with(pairs, sets, "counts").filter(175 * most >= 75 * (total(F.col("x")) + total(F.col("y")))).select("a", "b")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of signatures whose sets link, by their whole sets."""
    both = F.size(F.array_intersect("x", "y"))
    pairs = _with(may_link(pairs, sets), sets, "items").select("a", "b", both.alias("i"), (F.size("x") + F.size("y")).alias("n"))
    return pairs.filter(100 * F.col("i") >= 75 * (F.col("n") - F.col("i"))).select("a", "b")


def components(tables: Tables, links: DataFrame, labels: DataFrame | None = None) -> DataFrame | None:
    """(sig, label) over ``labels`` and ``links(a, b)``: the smallest signature reachable, by minimum and pointer jumping on the contracted graph."""
    links = tables.keep(links, "found")
    if labels is not None:
        for end in ("a", "b"):
            found = labels.select(F.col("sig").alias(end), F.col("label").alias("to"))
            links = links.join(found, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    links = links.filter("a <> b")
    both = tables.keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    if both.isEmpty():
        return labels
    found = tables.keep(both.groupBy(F.col("a").alias("sig")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(found.withColumnRenamed("sig", "b"), "b").groupBy(F.col("a").alias("sig")).agg(F.min("label").alias("near"))
        step = found.join(near, "sig").select("sig", F.least("label", "near").alias("hop"), F.col("label").alias("old"))
        step = step.join(found.select(F.col("sig").alias("hop"), F.col("label").alias("far")), "hop").select("sig", F.least("hop", "far").alias("label"), "old")
        step = tables.keep(step, "labels")
        found = step.select("sig", "label")
        if step.filter("label <> old").isEmpty():
            break
    if labels is None:
        return found
    moved = labels.join(found.select(F.col("sig").alias("label"), F.col("label").alias("to")), "label", "left").select("sig", F.coalesce("to", "label").alias("label"))
    return tables.keep(moved.union(found.join(labels, "sig", "left_anti").select("sig", "label")), "labels")


def seen_from(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``pairs(a, b)`` the documents ``b`` as seen from the pivots ``a``: (pivot, n_pivot, sig, n, s, diff)."""
    pairs = _with(pairs, sets, "items")
    diff = F.concat(F.array_except("x", "y"), F.array_except("y", "x"))
    pairs = pairs.select(F.col("a").alias("pivot"), F.size("x").alias("n_pivot"), F.col("b").alias("sig"), F.size("y").alias("n"), diff.alias("diff"))
    return pairs.withColumn("s", F.size("diff")).dropDuplicates(["pivot", "sig"])


def next_regions(seen: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(pivot, cell, sig, n, s, pos): the first shingles, rare ones first, of every document of the cells that still hold two components."""
    seen = _labelled(seen, labels)
    open_ = seen.groupBy("pivot").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("pivot")
    excess = 7 * F.col("s") - F.col("n") - F.col("n_pivot")
    near = F.greatest(F.lit(1), F.floor((7 * F.col("s") + F.col("n_pivot") - F.col("n")) / 14) + 1)
    seen = seen.join(open_, "pivot", "left_semi").withColumn("bound", F.when(excess > 0, F.greatest(F.lit(1), F.ceil(excess / 8))).otherwise(near))
    rows = seen.select("pivot", "sig", "n", "s", "bound", F.explode("diff").alias("cell"))
    often = rows.groupBy("pivot", "cell").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    own = Window.partitionBy("pivot", "sig")
    rows = rows.join(often, ["pivot", "cell"])
    # shingles that no other member shows come first, and need no region
    alone = F.col("s") - F.count(F.lit(1)).over(own)
    rows = rows.withColumn("pos", (alone + F.row_number().over(own.orderBy("often", "cell")) - 1).cast("int"))
    return rows.filter(F.col("pos") <= F.col("s") - F.col("bound")).select("pivot", "cell", "sig", "n", "s", "pos")


def resolve(spark: SparkSession, docs: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Of ``docs(doc_id, key, text)`` the rows (doc_id, key, n, sig), and the points (sig, label) with a partner."""
    profiled = tables.keep(profile(docs), "profile")
    rows = profiled.filter("sig IS NOT NULL").select("doc_id", "key", "n", "sig")
    regions = tables.keep(merged(tables.keep(first_regions(cells_of(docs, levels_of(profiled))), "cells")), "regions")
    regions = tables.keep(pruned(regions, None), "regions")
    sets = sets_of(docs, regions.select("sig").distinct(), tables)
    labels = None
    while not regions.isEmpty():
        labels = components(tables, linked(nearest(regions, _pivots(regions)), sets), labels)
        regions = tables.keep(pruned(regions, labels), "regions")
        regions = tables.keep(regions.join(_pivots(regions), "region"), "regions")
        labels = components(tables, linked(remaining(regions.filter(F.col("k") <= SMALL)), sets), labels)
        cells = pruned(regions.filter(F.col("k") > SMALL), labels).filter("sig <> pivot")
        seen = tables.keep(seen_from(cells.select(F.col("pivot").alias("a"), F.col("sig").alias("b")).distinct(), sets), "seen")
        near = seen.filter(7 * F.col("s") <= F.col("n") + F.col("n_pivot"))
        labels = components(tables, near.select(F.col("pivot").alias("a"), F.col("sig").alias("b")), labels)
        regions = tables.keep(merged(tables.keep(next_regions(seen, labels), "cells")), "regions")
        regions = tables.keep(pruned(regions, labels), "regions")
    if labels is None:
        labels = tables.keep(rows.select("sig", F.col("sig").alias("label")).limit(0), "labels")
    tables.drop(profiled, labels)
    return rows, labels


def _pivots(regions: DataFrame) -> DataFrame:
    """(region, k, pivot): members and pivot of each region."""
    return regions.groupBy("region").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("pos", "n", "sig"))["sig"].alias("pivot"))


def _rows_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, text): ``key`` is one for rows of equal id and text."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(doc_id).cast("long"), text).alias("key"), F.col(text).alias("text"))


def join(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id."""
    rows, labels = resolve(spark, _rows_of(docs, doc_id, text), Tables(spark))
    points = _labelled(rows.groupBy("sig").agg(F.min("doc_id").alias("doc_id")), labels)
    least = points.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(points.join(least, "label").select("sig", "component_id"), "sig")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of each component with all its columns: that of the smallest id (a null id comes last), then of the least hash.

    Rows without words all stay. Of rows with equal id and text, the one whose other columns have the least hash stays.
    """
    rows, labels = resolve(spark, _rows_of(docs), Tables(spark))
    words = _labelled(rows.filter("n > 0"), labels)
    kept = words.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")).select("first.doc_id", "first.key")
    twice = words.groupBy("key").count().filter("count > 1").select("key")
    kept = kept.union(rows.filter("n = 0").select("doc_id", "key").distinct()).select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"))
    hashed = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    out = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(*hashed).alias("h"))
    out = out.join(kept, (out["key"] == kept["kept_key"]) & out["id"].eqNullSafe(kept["kept_id"]), "left_semi")
    if not twice.isEmpty():
        again = out.join(twice, "key", "left_semi").groupBy("key", "id").agg(F.min_by("row", "h").alias("row"))
        out = out.join(twice, "key", "left_anti").select("row").union(again.select("row"))
    return out.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op9_ngram_jaccard_join": query}
SQL: dict[str, str] = {}
