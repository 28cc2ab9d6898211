"""Operator 12, centroid clustering with heap-ordered bounds.

Lloyd's rounds over whole-number vectors, exact in every step. With each vector goes the
gap between its distance to the second-nearest and to its own centroid. A
centroid's move shrinks the gap of its members by at most its own drift and the largest
drift of any other, so each cluster accumulates those sums, and a gap is kept
as its value plus what the cluster had accumulated when it was measured. The
vectors of a cluster wait in a heap by that number: those on its top whose gap the
accumulated drift has used up are popped, measured against all centroids, and pushed into
the heap of their nearest; the others keep their centroid unseen. Bounds are rounded to
the safe side, so a tie is always measured, and goes to the smaller number.

Vectors are packed into blocks of ``BLOCK`` rows, one row of a table in the shared
folder, with the heaps of their clusters. A round is one pass over the blocks without a
shuffle, which writes them anew with the sums of the vectors that changed cluster; k rows of sums
meet at the driver, and nothing else does. A lost executor costs the blocks it was at.

Defined cases: vectors that are null, of another length, or with a component that is
null, not finite or beyond ``LARGEST`` (whose distances would not fit a long) take
no part and give no row; with fewer vectors than clusters there are as many clusters as
vectors; none gives an empty result; a null id is hashed as an empty one; repeated rows
are vectors of their own and share a cluster; an inertia that does not fit a long is
null; an empty centroid stays; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlattice.llm.common import Tables, table

CLUSTERS, ROUNDS, SIZE = 40, 5, 64
SCALE = 256
SALT = "2:"
#: Components are less than this after scaling: 64 squared differences of them fit a long.
LARGEST = 1 << 27
BLOCK = 1024

_COLUMNS = "vec_ids binary, present binary, vectors binary, cluster binary, heaps binary, rows binary, ends binary"
_SUMS = "sums array<struct<cluster:int,n:bigint,total:array<bigint>>>"


class Model(NamedTuple):
    """Centroids, and the drift that each cluster has accumulated since the first round."""

    centroids: np.ndarray
    drift: np.ndarray


def whole_vectors(vectors: DataFrame, vec: str = "embedding", key: str = "vec_id", size: int = SIZE) -> DataFrame:
    """(vec_id, v): the scaled whole-number components of the vectors that take part."""
    x = F.col(vec)
    scaled = F.transform(x, lambda e: F.floor(e.cast("double") * SCALE))
    fits = F.forall(x, lambda e: F.coalesce(e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double") * SCALE) < LARGEST), F.lit(False)))
    usable = F.coalesce((F.size(x) == size) & fits, F.lit(False))
    return vectors.select(F.col(key).cast("long").alias("vec_id"), F.when(usable, scaled).alias("v")).filter("v IS NOT NULL")


def first_centroids(rows: DataFrame, k: int, salt: str = SALT) -> np.ndarray:
    """The ``k`` vectors whose salted ids have the least SHA-256, in its order; equal hashes in the order of the vectors.

    Only hashes below a bound are sorted, about eight times ``k`` of all tasks together; it is raised until enough lie below it.
    """
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    hashed = rows.select(digest.alias("h"), "v")
    share = 8 * k / max(1, rows.count())
    while True:
        some = hashed if share >= 1 else hashed.filter(F.col("h") < f"{int(share * 2**64):016x}")
        found = some.orderBy("h", "v").limit(k).collect()
        if len(found) == k or share >= 1:
            return np.array([r.v for r in found], np.int64)
        share *= 8


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, squared distance of the second) of each row, in whole numbers; ties to the smaller number."""
    d = (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)
    best = d.argmin(1)
    rows = np.arange(len(x))
    own = d[rows, best]
    d[rows, best] = np.iinfo(np.int64).max
    return best, own, d.min(1)


def gaps(own: np.ndarray, second: np.ndarray, alone: bool) -> np.ndarray:
    """How far the centroids may drift in all before a vector must be measured again, rounded down."""
    if alone:
        return np.full(len(own), np.inf)
    u, v = np.sqrt(own.astype(float)), np.sqrt(second.astype(float))
    return v - u - 1e-9 * (1 + u + v)


def drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """By how much the gap of each cluster's members shrinks, rounded up."""
    step = np.sqrt(((after - before).astype(float) ** 2).sum(1))
    if len(step) < 2:
        return step
    order = np.argsort(step)
    other = np.full(len(step), step[order[-1]])
    other[order[-1]] = step[order[-2]]
    return np.where(step + other > 0, (step + other) * (1 + 1e-9) + 1e-9, 0.0)


class Block:
    """Some vectors with their clusters and, for each cluster, a heap of (gap + accumulated drift, row)."""

    def __init__(self, x: np.ndarray, cluster: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.x, self.cluster, self.heaps = x, cluster, heaps

    @classmethod
    def fresh(cls, x: np.ndarray, k: int) -> Block:
        """All rows in the heap of no cluster yet: each is due at once."""
        return cls(x, np.full(len(x), -1, np.int32), [[] for _ in range(k)])

    def advance(self, model: Model) -> tuple[list[dict], int]:
        """Measures the rows whose gap is used up; the sums of what entered and left each cluster, and how many rows were measured."""
        k = len(model.centroids)
        due = np.flatnonzero(self.cluster < 0).tolist()
        for heap, drift in zip(self.heaps, model.drift.tolist(), strict=True):
            while heap and heap[0][0] <= drift:
                due.append(heapq.heappop(heap)[1])
        if not due:
            return [], 0
        rows = np.array(due)
        x, old = self.x[rows].astype(np.int64), self.cluster[rows]
        new, own, second = nearest(x, model.centroids)
        until = gaps(own, second, k == 1) + model.drift[new]
        for row, c, key in zip(due, new.tolist(), until.tolist(), strict=True):
            heapq.heappush(self.heaps[c], (key, row))
        self.cluster[rows] = new
        moved = old != new
        n, total = np.zeros(k, np.int64), np.zeros((k, x.shape[1]), np.int64)
        np.add.at(n, new[moved], 1)
        np.add.at(total, new[moved], x[moved])
        left = moved & (old >= 0)
        np.subtract.at(n, old[left], 1)
        np.subtract.at(total, old[left], x[left])
        touched = np.unique(np.concatenate([new[moved], old[left]]))
        return [{"cluster": int(c), "n": int(n[c]), "total": total[c].tolist()} for c in touched], len(due)

    def packed(self) -> dict[str, bytes]:
        keys = np.array([key for heap in self.heaps for key, _ in heap], np.float64)
        rows = np.array([row for heap in self.heaps for _, row in heap], np.int32)
        return {"vectors": self.x.tobytes(), "cluster": self.cluster.tobytes(), "heaps": keys.tobytes(), "rows": rows.tobytes(), "ends": np.cumsum([len(h) for h in self.heaps], dtype=np.int32).tobytes()}

    @classmethod
    def unpacked(cls, batch: pa.RecordBatch, i: int, size: int) -> Block:
        get = lambda c, kind: np.frombuffer(batch.column(c)[i].as_py(), kind)
        keys, rows, ends = get("heaps", np.float64).tolist(), get("rows", np.int32).tolist(), get("ends", np.int32).tolist()
        heaps = [list(zip(keys[a:b], rows[a:b], strict=True)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return cls(get("vectors", np.int32).reshape(-1, size), get("cluster", np.int32).copy(), heaps)


def _blocks(rows: DataFrame, k: int, size: int) -> DataFrame:
    """The vectors packed, in the order in which they lie; none is in a cluster yet."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                ids = batch.column(0)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, size)
                made = {"vec_ids": ids.fill_null(0).to_numpy().astype(np.int64).tobytes(), "present": ids.is_valid().to_numpy(zero_copy_only=False).tobytes()} | Block.fresh(x, k).packed()
                yield pa.RecordBatch.from_pylist([made])

    return rows.select("vec_id", "v").mapInArrow(work, _COLUMNS)


def _round(blocks: DataFrame, model: Model, size: int) -> DataFrame:
    """The blocks after one assignment, with the sums of what moved and the number of vectors measured."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block.unpacked(batch, i, size)
                sums, measured = block.advance(model)
                row = {c: batch.column(c)[i].as_py() for c in ("vec_ids", "present")} | block.packed() | {"sums": sums, "measured": measured}
                yield pa.RecordBatch.from_pylist([row], schema)

    out = blocks.select(*(c.split()[0] for c in _COLUMNS.split(", ")))
    kind = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))
    schema = pa.schema([(c.split()[0], pa.binary()) for c in _COLUMNS.split(", ")] + [("sums", kind), ("measured", pa.int64())])
    return out.mapInArrow(work, f"{_COLUMNS}, {_SUMS}, measured bigint")


def _add_up(blocks: DataFrame, n: list[int], total: list[list[int]]) -> None:
    """Adds what moved in a round to the sizes and sums of the clusters."""
    moved = blocks.select(F.inline("sums"))
    each = moved.select("cluster", F.lit(-1).alias("part"), F.col("n").alias("v")).unionByName(moved.select("cluster", F.posexplode("total").alias("part", "v")))
    for r in each.groupBy("cluster", "part").agg(F.sum("v").alias("v")).collect():
        if r.part < 0:
            n[r.cluster] += r.v
        else:
            total[r.cluster][r.part] += r.v


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, vec: str = "embedding", key: str = "vec_id", seen: list[int] | None = None) -> DataFrame:
    """Per vector: vec_id, cluster, distance, and of its cluster cluster_inertia and centroid (array), and inertia of all.

    ``seen`` takes the number of vectors measured against all centroids in each round.
    """
    spark = vectors.sparkSession
    tables = Tables(spark)
    rows = whole_vectors(vectors, vec, key, size)
    centroids = first_centroids(rows, k)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<bigint>")
    model, n, total = Model(centroids, np.zeros(k)), [0] * k, [[0] * size for _ in range(k)]
    try:
        blocks = tables.keep(_blocks(rows, k, size), "centroids-blocks")
        for turn in range(rounds + 1):
            blocks = tables.keep(_round(blocks, model, size), f"centroids-{turn}")
            if seen is not None:
                seen.append(blocks.agg(F.sum("measured")).first()[0])
            tables.drop(blocks)
            if turn < rounds:
                _add_up(blocks, n, total)
                after = np.array([[t // n[c] for t in total[c]] if n[c] else model.centroids[c] for c in range(k)], np.int64)
                model = Model(after, model.drift + drifts(model.centroids, after))
        out = tables.keep(_distances(blocks, model.centroids, size), "centroids-result")
        tables.drop(out)
    except BaseException:
        tables.drop()
        raise
    return _with_inertia(out, model.centroids)


def _distances(blocks: DataFrame, centroids: np.ndarray, size: int) -> DataFrame:
    """(vec_id, cluster, distance) of all blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, kind: np.frombuffer(batch.column(c)[i].as_py(), kind)  # noqa: B023, E731
                own = get("cluster", np.int32)
                d = get("vectors", np.int32).reshape(-1, size).astype(np.int64) - centroids[own]
                ids = pa.array(get("vec_ids", np.int64), mask=~get("present", bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(own), pa.array((d * d).sum(1))], ["vec_id", "cluster", "distance"])

    return blocks.select("vec_ids", "present", "vectors", "cluster").mapInArrow(work, "vec_id bigint, cluster int, distance bigint")


def _with_inertia(out: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds what is told of clusters: k rows, sent to every task."""
    spark = out.sparkSession
    wide = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    own, fits = {r.cluster: int(r.s) for r in wide}, lambda v: v if v < 2**63 else None
    told = [(c, fits(s), fits(sum(own.values())), centroids[c].tolist()) for c, s in own.items()]
    stats = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return out.join(F.broadcast(stats), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: Column) -> Column:
    """SHA-256 of the components in decimal, joined by commas."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroid_digest(F.col("centroid")).alias("centroid_sha256"))


def digest_of(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE) -> str:
    """The same rows in DuckDB's SQL: every round measures all vectors against all centroids."""
    usable = f"len(embedding) = {size} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e::DOUBLE) AND abs(e::DOUBLE * {SCALE}) < {LARGEST})) = {size}"
    square = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (v.v[i] - c.c[i]) * (v.v[i] - c.c[i])))::BIGINT"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings WHERE {usable})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS id, v AS c FROM (SELECT sha256('{SALT}' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM v) ORDER BY h, v LIMIT {k})",
    ]
    for t in range(rounds + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, arg_min(id, (d, id)) AS id, min(d) AS d FROM (SELECT v.r, c.id, {square} AS d FROM v, c{t} c) GROUP BY r)")
        if t < rounds:
            parts.append(f"s{t} AS (SELECT id, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT a.id, unnest(range(1, {size + 1})) AS i, unnest(v.v) AS x FROM a{t} a JOIN v USING (r)) GROUP BY id, i)")
            parts.append(f"m{t} AS (SELECT id, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{t} GROUP BY id)")
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT c.id, coalesce(m.c, c.c) AS c FROM c{t} c LEFT JOIN m{t} m USING (id))")
    return f"""WITH {", ".join(parts)}
SELECT v.vec_id, a.id AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.id))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.id = a.id"""


QUERIES = {"op12_centroid_clustering": query}
SQL = {"op12_centroid_clustering": oracle()}
