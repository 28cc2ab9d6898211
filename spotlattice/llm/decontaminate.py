"""Operator 6, benchmark decontamination: size-partitioned MinHash containment search.

A test item is found in a document when 75 % or more of its distinct word
shingles are in the document.

The Jaccard similarity of a short item and a long document is tiny, so both
sides are brought to comparable sizes first. Items are partitioned by size:
class ``c`` holds items of ``2^c`` to ``2^(c+1) - 1`` shingles. For each class
in use, a document becomes windows of ``4 * 2^c`` shingles that start every
``2 * 2^c``. Items and windows get one-permutation MinHash sketches: a shingle
falls in one of ``BINS`` bins by its low bits, each bin keeps the least value of
its high bits. An item is a candidate for a document when any bin of any of its
windows agrees. There are so many bins that a shared shingle is the
least of its bin in either set with high probability (``miss`` bounds what is
lost: below 1e-5 for every class). Items of the first ``DIRECT`` classes, at most
three shingles, have too few for that: each of their shingles is looked up as it
is, and none is lost. Candidates are verified by exact containment
of the item's shingles in the whole document.

The items are a stated query set. They go to the tasks in blocks of
``BLOCK_SHINGLES`` words at most (an item of more is a block of its own), one block at a
time, so what is broadcast has a fixed bound; the documents are read once for each block
and never shuffled.

Defined cases: null or wordless texts and items match nothing; an item of fewer
than five words is one shingle, found only in a text of exactly these words; very long
texts are searched whole. Rows of equal id and text count once, on either side: an item
and a document repeated any number of times give one row of ``search``. Rows that share
an id but not the text are judged one by one. Empty tables give an empty result; extra
columns are ignored by ``search``; ``drop_leaks`` keeps them and judges repeated rows alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlattice.llm.common import materialise, shingle_sets, shingles, table

BLOCK_SHINGLES = 1_000_000
BINS = 4096
DIRECT = 2
_SHIFT, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


def miss(c: int, share: float = 0.75) -> float:
    """Bound on the probability that an item of class ``c`` inside two overlapping windows meets no bin.

    A shared shingle agrees unless another of the window's (below ``4 * 2^c``)
    or the item's (below ``2 * 2^c``) shares its bin and is less; both windows
    must miss all ``share * 2^c`` shared shingles. Sets larger than ``BINS``
    fill the bins, and each agrees with the Jaccard similarity of item and window.
    Classes that are looked up directly lose nothing.
    """
    if c < DIRECT:
        return 0.0
    if 2**c >= BINS:
        return (1 - share / (6 - share)) ** (BINS // 2)
    lost = min(1.0, (4 * 2**c + 2 * 2**c) / 2 / BINS)
    return min(lost ** int(np.ceil(share * 2**c)), (1 - share / (6 - share)) ** (2**c // 2))


def _sketch(bins: np.ndarray, values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Sorted ``group << 44 | bin << 32 | least value`` of each group and bin."""
    packed = (group << np.uint64(44)) | (bins << _SHIFT) | values
    packed.sort()
    first = np.ones(len(packed), bool)
    first[1:] = (packed[1:] >> _SHIFT) != (packed[:-1] >> _SHIFT)
    return packed[first]


class Index:
    """Sketches of one block of items, by size class."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        sizes = np.array([int(np.log2(len(s))) for _, s in items], np.int64)
        few = np.flatnonzero(sizes < DIRECT)
        plain = np.concatenate([np.empty(0, np.uint64), *(items[i][1] for i in few)])
        order = np.argsort(plain, kind="stable")
        self.direct = plain[order], np.repeat(few, [len(items[i][1]) for i in few])[order], np.zeros(1 << 16, bool)
        self.direct[2][(plain & np.uint64(0xFFFF)).astype(np.int64)] = True
        for c in np.unique(sizes[sizes >= DIRECT]).tolist():
            members = np.flatnonzero(sizes == c)
            shingles = np.concatenate([items[i][1] for i in members])
            owner = np.repeat(np.arange(len(members), dtype=np.uint64), [len(items[i][1]) for i in members])
            packed = _sketch(shingles & np.uint64(BINS - 1), shingles >> _SHIFT, owner)
            keys = packed & np.uint64((1 << 44) - 1)
            order = np.argsort(keys, kind="stable")
            maybe = np.zeros(1 << 16, bool)
            maybe[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.classes[c] = keys[order], members[(packed[order] >> np.uint64(44)).astype(np.int64)], maybe

    def candidates(self, shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Distinct (document, item) pairs; ``shingles`` of the documents stand one after another in text order."""
        found = [np.empty((0, 2), np.int64)]
        place = np.arange(len(shingles)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keys, owners, maybe = self.direct
        if len(keys):
            seen = np.flatnonzero(maybe[(shingles & np.uint64(0xFFFF)).astype(np.int64)])
            low, high = np.searchsorted(keys, shingles[seen], "left"), np.searchsorted(keys, shingles[seen], "right")
            hits = high - low
            at = np.repeat(low, hits) + np.arange(int(hits.sum())) - np.repeat(np.cumsum(hits) - hits, hits)
            found.append(np.stack([np.repeat(np.repeat(np.arange(len(sizes)), sizes)[seen], hits), owners[at]], axis=1))
        for c, (keys, owners, maybe) in self.classes.items():
            stride = 2 << c
            windows = -(-sizes // stride)
            first = np.cumsum(windows) - windows
            block = place // stride
            window = np.repeat(first, sizes) + block
            bins, values = shingles & np.uint64(BINS - 1), shingles >> _SHIFT
            back = block > 0
            packed = _sketch(np.concatenate([bins, bins[back]]), np.concatenate([values, values[back]]), np.concatenate([window, window[back] - 1]).astype(np.uint64))
            packed = packed[maybe[(packed & np.uint64(0xFFFF)).astype(np.int64)]]
            key = packed & np.uint64((1 << 44) - 1)
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            hits = high - low
            at = np.repeat(low, hits) + np.arange(int(hits.sum())) - np.repeat(np.cumsum(hits) - hits, hits)
            docs = np.repeat(np.arange(len(sizes)), windows)[np.repeat((packed >> np.uint64(44)).astype(np.int64), hits)]
            found.append(np.stack([docs, owners[at]], axis=1))
        return np.unique(np.concatenate(found), axis=0)


def _item_sets(rows: list[tuple[int, str | None]]) -> list[tuple[int, np.ndarray]]:
    found = shingle_sets(pa.array([t for _, t in rows], pa.string()))
    return [(rows[k][0], s) for k, s in found if len(s)]


def _blocks(items: DataFrame) -> list[DataFrame]:
    """The distinct items in blocks of ``BLOCK_SHINGLES`` words at most, or of one item."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = items.withColumns({"words": F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")), "h": F.xxhash64("item_id", "text")})
    total = items.agg(F.sum("words")).first()[0] or 0
    n = max(1, -(-total // BLOCK_SHINGLES))
    while n > 1:
        sizes = items.groupBy(F.pmod("h", F.lit(n))).agg(F.sum("words").alias("words"), F.count_distinct("h").alias("many"))
        if sizes.filter((F.col("words") > BLOCK_SHINGLES) & (F.col("many") > 1)).isEmpty():
            break
        n *= 2
    return [items.filter(F.pmod("h", F.lit(n)) == k).select("item_id", "text") for k in range(n)]


def _hits(index: Index, texts: pa.Array, percent: int) -> Iterator[tuple[int, int, int, int]]:
    """(row, place of the item, n_item, n_common) of a column of texts: candidates verified against the whole text."""
    for row, hashes, sizes in shingles(texts):
        ends, last, whole = np.cumsum(sizes), -1, None
        for d, i in index.candidates(hashes, sizes).tolist():
            if d != last:
                last, whole = d, np.unique(hashes[ends[d] - sizes[d] : ends[d]])
            s = index.items[i][1]
            at = np.minimum(np.searchsorted(whole, s), len(whole) - 1)
            common = int((whole[at] == s).sum())
            if 100 * common >= percent * len(s):
                yield row + d, i, len(s), common


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, share: float = 0.75) -> DataFrame:
    """(doc_id, item_id, n_item, n_common): items with at least ``share`` of their shingles in a document."""
    percent = round(100 * share)
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    out, blocks = None, _blocks(items)
    for block in blocks:
        sent = spark.sparkContext.broadcast(_item_sets([tuple(r) for r in block.collect()]))

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value)
            for batch in batches:
                ids, hs = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                rows = [(ids[row], hs[row], i, index.items[i][0], *rest) for row, i, *rest in _hits(index, batch.column(1), percent)]
                columns = list(zip(*rows, strict=True)) or [(), (), (), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "h", "place", "item_id", "n_item", "n_common"])

        # equal ids and texts give equal rows; the place tells apart items that share an id
        found = docs.mapInArrow(work, "doc_id long, h long, place long, item_id long, n_item long, n_common long").distinct().drop("h", "place")
        if len(blocks) > 1:
            found = materialise(spark, found, "decontaminate")
            sent.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, share: float = 0.75) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns; rows stay in place, block after block."""
    percent = round(100 * share)
    blocks = _blocks(items)
    for block in blocks:
        sent = spark.sparkContext.broadcast(_item_sets([tuple(r) for r in block.collect()]))

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, *_ in _hits(index, batch.column(batch.schema.get_field_index("text")), percent)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(work, docs.schema)
        if len(blocks) > 1:
            docs = materialise(spark, docs, "decontaminate")
            sent.unpersist()
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle(documents: str = "documents") -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    shingles = f"""(SELECT DISTINCT k, id, array_to_string(w[i:i + least(4, len(w) - 1)], ' ') AS s, least(5, len(w)) AS width
  FROM (SELECT k, id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i
    FROM (SELECT row_number() OVER () AS k, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {{}})
    WHERE len(w) > 0))"""
    return f"""
WITH d AS {shingles.format(f"(SELECT DISTINCT doc_id AS id, text FROM {documents})")},
b AS {shingles.format("(SELECT DISTINCT item_id AS id, text FROM benchmark)")},
n AS (SELECT k, count(*) AS n_item FROM b GROUP BY k)
SELECT any_value(d.id) AS doc_id, any_value(b.id) AS item_id, any_value(n_item)::BIGINT AS n_item, count(*)::BIGINT AS n_common
FROM b JOIN d USING (s, width) JOIN n ON n.k = b.k GROUP BY d.k, b.k HAVING 100 * count(*) >= 75 * any_value(n_item)"""


QUERIES = {"op6_benchmark_decontamination": query}
SQL = {"op6_benchmark_decontamination": oracle()}
