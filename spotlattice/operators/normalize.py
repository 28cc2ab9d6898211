"""Library sizes, log-normalisation, variable genes, embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlattice.operators.lineage import cut, tidy


def library_size(counts: DataFrame, spots: DataFrame) -> DataFrame:
    """Total count of each spot over all genes; a spot without counts gets 1."""
    total = counts.groupBy("sample_id", "spot").agg(F.sum("n").alias("size"))
    out = spots.select("sample_id", "spot").join(total, ["sample_id", "spot"], "left")
    return out.withColumn("size", F.when(F.coalesce("size", F.lit(0)) == 0, 1).otherwise(F.col("size")))


def lognorm(counts: DataFrame, scale: float = 1e4) -> DataFrame:
    """v = log1p(n * scale / library size); absent rows stay zero."""
    size = F.sum("n").over(Window.partitionBy("sample_id", "spot"))
    return counts.withColumn("v", F.log1p(F.col("n") * scale / F.when(size == 0, 1).otherwise(size)))


def gene_variance(expr: DataFrame, spots: DataFrame) -> DataFrame:
    """Population variance over all spots of the sample, absent values counting as zero."""
    n = spots.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_spots"))
    g = expr.groupBy("sample_id", "gene").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss")).join(F.broadcast(n), "sample_id")
    mean = F.col("s") / F.col("n_spots")
    return g.select("sample_id", "gene", F.greatest(F.col("ss") / F.col("n_spots") - mean * mean, F.lit(0.0)).alias("variance"))


def hvg_select(expr: DataFrame, spots: DataFrame, most: int = 2000) -> DataFrame:
    """The most variable genes of each sample; of equal ones the later gene comes first."""
    w = Window.partitionBy("sample_id").orderBy(F.desc("variance"), F.desc("gene"))
    return gene_variance(expr, spots).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def coords_scaled(spots: DataFrame) -> DataFrame:
    """xs, ys: coordinates less their mean over their population deviation plus 1e-6."""
    of = spots.groupBy("sample_id").agg(*(f(c).alias(f"{n}_{c}") for n, f in (("mean", F.avg), ("sd", F.stddev_pop)) for c in "xy"))
    one = lambda c: (F.col(c) - F.col(f"mean_{c}")) / (F.col(f"sd_{c}") + 1e-6)
    return spots.join(of, "sample_id").withColumns({"xs": one("x"), "ys": one("y")}).drop("mean_x", "mean_y", "sd_x", "sd_y")


def spatial_features(embedding: DataFrame, scaled: DataFrame, weight: float = 0.5) -> DataFrame:
    """Embedding with the weighted scaled coordinates behind it."""
    return embedding.join(scaled, ["sample_id", "spot"]).select("sample_id", "spot", F.concat("f", F.array(weight * F.col("xs"), weight * F.col("ys"))).alias("f"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def unit(f: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    norm = F.sqrt(dot(f, f))
    return F.transform(f, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


#: Spots of a dense block.
_BLOCK = 2048


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spots of one sample as blocks: which row has which value of which gene."""
    for batch in batches:
        for key, rows in batch.groupby("sample_id", sort=False):
            for i in range(0, len(rows), _BLOCK):
                some = rows.iloc[i : i + _BLOCK]
                row = np.repeat(np.arange(len(some), dtype=np.int32), some["at"].map(len))
                at, v = np.concatenate(some["at"].to_numpy()).astype(np.int32), np.concatenate(some["v"].to_numpy()).astype(np.float64)
                yield pd.DataFrame({"sample_id": [key], "spots": [some["spot"].to_numpy().astype(np.int64).tobytes()], "row": [row.tobytes()], "at": [at.tobytes()], "v": [v.tobytes()]})


def _dense(block) -> tuple[np.ndarray, np.ndarray]:
    """Spots and the spots x genes matrix of a block."""
    spots = np.frombuffer(block.spots, np.int64)
    x = np.zeros((len(spots), block.size_))
    np.add.at(x, (np.frombuffer(block.row, np.int32), np.frombuffer(block.at, np.int32)), np.frombuffer(block.v, np.float64))
    return spots, x


def _products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of the genes x genes products of a task's spots, sample by sample."""
    sums: dict = {}
    for batch in batches:
        for block in batch.itertuples(index=False):
            _, x = _dense(block)
            sums[block.sample_id] = sums.get(block.sample_id, 0.0) + x.T @ x
    for key, g in sums.items():
        yield pd.DataFrame({"sample_id": [key] * len(g), "at": np.arange(len(g), dtype=np.int32), "g": list(g)})


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    one = rows.iloc[:1][["sample_id", "at", "mean", "n"]]
    return one.assign(g=[np.sum(np.vstack(rows["g"].to_numpy()), axis=0)])


def _axes(parts: int, asked: int, rounds: int, seed: int, tolerance: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One sample's axes by subspace iteration on its genes x genes covariance; ``w`` lies row by row."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        mean, n = rows["mean"].to_numpy(float), float(rows["n"].iloc[0])
        c = np.vstack(rows["g"].to_numpy()) / n - np.outer(mean, mean)

        def orthonormal(y: np.ndarray) -> np.ndarray:
            q, _ = np.linalg.qr(y)
            return np.pad(q, ((0, 0), (0, parts - q.shape[1])))

        w, before, moving = orthonormal(np.random.default_rng(seed).random((len(c), parts)) - 0.5), None, True
        for _ in range(rounds):
            y = c @ w
            # turned towards the principal axes first; ``value`` has the variances along them
            inner = w.T @ y
            value, turn = np.linalg.eigh((inner + inner.T) / 2)
            w, now = orthonormal(y @ turn[:, ::-1]), value[::-1][:asked]
            moving = before is None or np.abs(now - before).max() > tolerance * max(now.max(), 1e-300)
            before = now
            if not moving:
                break
        w = w[:, :asked]
        return pd.DataFrame({"sample_id": rows["sample_id"].iloc[:1].to_numpy(), "w": [w.ravel()], "offset": [mean @ w], "converged": [not moving]})

    return work


def _scores(asked: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch.itertuples(index=False):
                spots, x = _dense(block)
                yield pd.DataFrame({"sample_id": [block.sample_id] * len(spots), "spot": spots, "y": list(x @ np.asarray(block.w).reshape(-1, asked))})

    return work


@tidy
def pca(expr: DataFrame, spots: DataFrame, parts: int = 20, rounds: int = 300, seed: int = 0, spare: int = 20, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """(scores, variances) of all samples at once by subspace iteration on the genes x genes covariances.

    Spots are packed into blocks once. One pass over them gives each task's products of genes, which
    are added up by gene; only a sample's genes x genes table meets in one task, where the
    rounds run. Genes are the selected ones, 2000 at most, so that table is of 32 MB at most. Every spot
    takes part and has scores; one without counts is a row of zeros.
    ``spare`` further components speed up the rounds, which end when no variance
    moves by more than ``tolerance`` of the sample's largest, or after ``rounds``;
    ``converged`` tells which. A sample has no more components than spots or
    genes less one, two at least.
    """
    expr = expr.select("sample_id", "spot", "gene", "v")
    n = spots.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    place = Window.partitionBy("sample_id")
    genes = expr.groupBy("sample_id", "gene").agg(F.sum("v").alias("s")).join(F.broadcast(n), "sample_id")
    genes = cut(genes.select("sample_id", "gene", "n", (F.col("s") / F.col("n")).alias("mean"), (F.row_number().over(place.orderBy("gene")) - 1).alias("at"), F.count(F.lit(1)).over(place).cast("int").alias("size_")))
    cells = expr.join(genes.select("sample_id", "gene", "at"), ["sample_id", "gene"]).groupBy("sample_id", "spot").agg(F.collect_list(F.struct("at", "v")).alias("m"))
    shape = "sample_id string, spots binary, row binary, at binary, v binary"
    blocks = cut(cells.select("sample_id", F.col("spot").cast("bigint").alias("spot"), F.col("m.at").alias("at"), F.col("m.v").alias("v")).mapInPandas(_packed, shape))
    # one row a sample
    size = genes.groupBy("sample_id").agg(F.max("size_").alias("size_"))
    products = blocks.join(F.broadcast(size), "sample_id").mapInPandas(_products, "sample_id string, at int, g array<double>")
    products = products.join(genes.select("sample_id", "at", "mean", "n"), ["sample_id", "at"]).groupBy("sample_id", "at").applyInPandas(_added, "sample_id string, at int, mean double, n bigint, g array<double>")
    basis = products.groupBy("sample_id").applyInPandas(_axes(parts + spare, parts, rounds, seed, tolerance), "sample_id string, w array<double>, offset array<double>, converged boolean")
    basis = cut(basis.join(size, "sample_id"))
    kind = spots.schema["spot"].dataType
    y = blocks.join(F.broadcast(basis.select("sample_id", "size_", "w")), "sample_id").mapInPandas(_scores(parts), "sample_id string, spot bigint, y array<double>")
    y = y.withColumn("spot", F.col("spot").cast(kind))
    most = F.greatest(F.lit(2), F.least(F.lit(parts), F.col("n") - 1, F.col("size_") - 1)).cast("int")
    few = F.broadcast(basis.join(n, "sample_id").select("sample_id", "offset", most.alias("most"), "converged"))
    # a spot without values lies at minus the offset
    centred = F.zip_with(F.coalesce("y", F.array_repeat(F.lit(0.0), parts)), "offset", lambda a, b: a - b)
    scores = spots.select("sample_id", "spot").join(y, ["sample_id", "spot"], "left").join(few, "sample_id").select("sample_id", "spot", F.slice(centred, F.lit(1), F.col("most")).alias("f"), "converged")
    variance = scores.select("sample_id", "converged", F.posexplode("f").alias("part", "y")).groupBy("sample_id", "part", "converged").agg(F.var_pop("y").alias("variance"))
    return scores.drop("converged"), variance.select("sample_id", "part", "variance", "converged")
