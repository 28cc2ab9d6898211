"""Shared helpers: table access, shared folders, words and shingles."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters of the contracts: U+0020 and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
SHINGLE = 5

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_P = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one the cluster names in ``spark.checkpoint.dir``.

    Without that setting a session on one machine (tests) takes a folder of its
    own there; on a cluster it is an error, for executors would not see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        base = f"file://{tempfile.gettempdir()}/spotlattice-{spark.sparkContext.applicationId}"
    if not base:
        raise ValueError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Settings under which tables are written. Shuffle files go when the table stands, for nothing reads
# them again, and Python workers take rows in small batches, for texts may be long.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


@contextlib.contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """The settings ``WRITING`` while a table is written; those of the session come back after it."""
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(spark, name)
    with writing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Tables of one job in the shared folder; ``drop`` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.names = spark, [], []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``materialise``, with the folder noted."""
        path = shared_dir(self.spark, name)
        with writing(self.spark):
            df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_in_buckets(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """``keep``, dealt by ``key`` into as many buckets as the session has shuffle partitions, so that a join on it moves no row of the table."""
        path, at = shared_dir(self.spark, name), f"{name}_{uuid.uuid4().hex}"
        with writing(self.spark):
            df.write.bucketBy(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).format("parquet").saveAsTable(at)
        self.paths.append(path)
        self.names.append(at)
        return self.spark.table(at)

    def drop(self, *but: DataFrame) -> None:
        """Deletes all tables but those that ``but`` read (never those in buckets)."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []
        read = [f for df in but for f in df.inputFiles()]
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            if not any(path.rsplit("/", 1)[1] in f for f in read):
                folder = jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(conf).delete(folder, True)
        self.paths = [p for p in self.paths if any(p.rsplit("/", 1)[1] in f for f in read)]


def least_hashes(rows: DataFrame, n: int, total: int, spare: int = 8) -> list[Row]:
    """The ``n`` rows of least hash ``h`` of ``rows(h, text)``, one for each hash, out of a table of ``total`` rows.

    Only rows below a bound on the hash are sorted, about ``spare`` times ``n`` of all
    tasks together if ``rows`` are all of the table, so what comes to the driver does not
    grow with the number of tasks; copies of one text share a hash and count once. The
    bound is raised until enough rows lie below it.
    """
    share = spare * n / max(1, total)
    while True:
        some = rows if share >= 1 else rows.filter(F.col("h") < int(-(2**63) + share * 2**64))
        found = some.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(n).collect()
        if len(found) == n or share >= 1:
            return found
        share *= 8


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= _M1
        x ^= x >> np.uint64(27)
        x *= _M2
        x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IS_WORD = np.ones(256, bool)
IS_WORD[[ord(c) for c in WS]] = False
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_PIECE = 1 << 18
_ROWS = 1000


class _Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _P)]))
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _INVERSE)]))
        return self.up, self.down


_powers = _Powers()


def _word_hashes(data: np.ndarray, edges: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts ``data[edges[i]:edges[i + 1]]``, and the number of each text.

    A word's hash is its polynomial in a fixed odd base: one running sum over the
    bytes gives every word by a difference, moved to a common place by the inverse.
    """
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    fresh = edges[:-1][edges[:-1] < edges[1:]]  # a word never runs on into the next text
    begins[fresh] = inside[fresh]
    at = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[fresh[1:] - 1] = inside[fresh[1:] - 1]
    end = np.flatnonzero(stops) + 1
    up, down = _powers.of(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
        h = (total[end] - total[at]) * down[at] + (end - at).astype(np.uint64)
    return mix64(h), np.diff(np.searchsorted(at, edges))


def _shingles(words: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of each text, in order; a shorter text gives one for all its words."""
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    starts = np.cumsum(sizes) - sizes
    first = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
    width = np.repeat(np.minimum(sizes, k), counts)
    h = width.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    with np.errstate(over="ignore"):
        for i in range(k):
            h = np.where(i < width, h * _P + padded[first + i], h)
    return mix64(h), counts


def shingles(texts: pa.Array, k: int = SHINGLE, is_word: np.ndarray = IS_WORD) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shingle hashes of a column of texts: (first row, hashes in text order, number of each text).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the A-Z lower-cased text. Works on the UTF-8
    bytes of the column, about a quarter of a megabyte at a time; null counts as empty.
    ``is_word`` tells of each byte whether it belongs to a word.
    """
    for first in range(0, len(texts), _ROWS):
        part = pc.fill_null(texts.slice(first, _ROWS).cast(pa.large_string()), "")
        _, offsets, data = part.buffers()
        offsets = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        row = 0
        while row < len(part):
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _PIECE, "right")) - 1)
            low, high = int(offsets[row]), int(offsets[stop])
            if high - low <= 4 * _PIECE:
                words, sizes = _word_hashes(data[low:high], offsets[row : stop + 1] - low, is_word)
            else:  # one very long text, cut between words
                found = []
                while low < high:
                    cut = min(high, low + _PIECE)
                    gaps = np.flatnonzero(~is_word[data[low:cut]])
                    while cut < high and not len(gaps):
                        cut = min(high, cut + _PIECE)
                        gaps = np.flatnonzero(~is_word[data[low:cut]])
                    cut = low + int(gaps[-1]) + 1 if cut < high else high
                    found.append(_word_hashes(data[low:cut], np.array([0, cut - low]), is_word)[0])
                    low = cut
                words, sizes = np.concatenate(found), np.array([sum(map(len, found))])
            yield first + row, *_shingles(words, sizes, k)
            row = stop


def shingle_sets(texts: pa.Array, k: int = SHINGLE, is_word: np.ndarray = IS_WORD) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for row, hashes, counts in shingles(texts, k, is_word):
        for i, (n, end) in enumerate(zip(counts.tolist(), np.cumsum(counts).tolist(), strict=True)):
            s = np.sort(hashes[end - n : end])
            if n > 1:
                fresh = np.ones(n, bool)
                np.not_equal(s[1:], s[:-1], out=fresh[1:])
                s = s[fresh]
            yield row + i, s
