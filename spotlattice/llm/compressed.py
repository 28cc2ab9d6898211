"""Operator 13, a quality classifier by compression.

Two zstandard dictionaries are trained, one from good and one from bad labelled
text. A text like the good ones takes less room with the good dictionary. Every
whole text is compressed in pieces of ``PIECE`` bytes, each with the good
dictionary, with the bad one and without any, so that the dictionaries count as much at the
end of a long text as at its start. The difference bad - good, normalised by the
size without a dictionary and by the length, becomes the score: a logistic surface over the
difference, the text's own compressibility and its length tells how likely label 1 is, for
a small difference says less of a text that hardly needs a dictionary.

Learned from: rows with one label 0 or 1 that ``held_out`` leaves, at most
``SAMPLE_DOCS`` documents a label of the least hashes of their ids, ``SAMPLE_CHARS``
characters of each; every second one goes to the dictionaries, in equal amounts for both
labels, the others to the surface, where each label weighs as much as in the whole
table. Everything else runs over all whole texts, in one pass without a shuffle. Labels,
language, source and id are never inputs of a score.

Defined cases: null texts count as empty, and empty ones are scored like any other;
very long texts are compressed whole, piece by piece; documents with contradictory labels teach nothing; if
one label has no rows to learn from, all score the smoothed share of label 1; a null id is not held
out and not learned from; repeated rows are scored alike; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlattice.llm.common import table

SAMPLE_DOCS = 1200
SAMPLE_CHARS = 20_000
DICT_BYTES = 32_768
DICT_PIECE = 512
PIECE = 1024
LEVEL = 3
BAR = 0.3
_PRIOR = 1e-3


class Model(NamedTuple):
    """Contents of both dictionaries, and the surface: mean and deviation of the measures, and weights."""

    good: bytes
    bad: bytes
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray


class Scales:
    """Compressors with the good dictionary, with the bad one, and without any."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = []
        for content in (good, bad, b""):
            dictionary = zstandard.ZstdCompressionDict(content) if content else None
            if dictionary:
                dictionary.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False))

    def measures(self, text: str) -> tuple[float, float, float, float]:
        """(difference by compressed size, difference by length, compressed size by length, log length)."""
        data = memoryview(text.encode("utf-8", "surrogatepass"))
        good, bad, plain = (sum(len(c.compress(data[i : i + PIECE])) for i in range(0, max(1, len(data)), PIECE)) for c in self.by)
        n = max(1, len(data))
        return (bad - good) / plain, (bad - good) / n, plain / n, float(np.log(n))


def _pieces(texts: list[str]) -> list[bytes]:
    """Pieces of all texts, the first ones of each text first."""
    cut = [(i // DICT_PIECE, k, data[i : i + DICT_PIECE]) for k, data in enumerate(t.encode("utf-8", "surrogatepass") for t in texts) for i in range(0, len(data), DICT_PIECE)]
    return [p for _, _, p in sorted(cut, key=lambda x: x[:2])]


def dictionaries(good: list[str], bad: list[str]) -> tuple[bytes, bytes]:
    """A dictionary of each label from equally many pieces; of too few to train on, the pieces themselves."""
    pieces = [_pieces(good), _pieces(bad)]
    n = min(map(len, pieces))
    out = []
    for some in pieces:
        try:
            out.append(zstandard.train_dictionary(DICT_BYTES, some[:n]).as_bytes())
        except zstandard.ZstdError:
            out.append(b"".join(some[:n])[:DICT_BYTES])
    return out[0], out[1]


def _surface(x: np.ndarray) -> np.ndarray:
    """The measures, their squares, and the products of difference, compressibility and length."""
    return np.column_stack([x, x * x, x[:, 0] * x[:, 2], x[:, 0] * x[:, 3], x[:, 2] * x[:, 3]])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's steps for logistic regression with a small quadratic penalty: (mean, deviation, weights)."""
    mean, deviation = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / deviation])
    penalty = np.full(z.shape[1], _PRIOR * weight.sum())
    penalty[0] = 0
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p) + 1e-12)[:, None]) + np.diag(penalty + 1e-9), z.T @ (weight * (p - y)) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return mean, deviation, w


def train(good: list[str], bad: list[str], n_good: int, n_bad: int) -> Model:
    """The model of sampled texts of both labels, which number ``n_good`` and ``n_bad`` in the whole table."""
    if not good or not bad:
        return Model(b"", b"", np.zeros(0), np.zeros(0), np.array([np.log((n_good + 1) / (n_bad + 1))]))
    a, b = dictionaries(good[::2], bad[::2])
    scales = Scales(a, b)
    rest = [good[1::2] or good, bad[1::2] or bad]
    x = np.array([scales.measures(t) for texts in rest for t in texts])
    y = np.repeat([1.0, 0.0], list(map(len, rest)))
    weight = np.repeat([n_good / len(rest[0]), n_bad / len(rest[1])], list(map(len, rest)))
    return Model(a, b, *_logistic(_surface(x), y, weight * len(x) / weight.sum()))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, n: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[int, tuple[list[str], int]]:
    """For each label the texts of at most ``n`` documents that may be learned from, and how many rows have it.

    Ids below a bound on their hash are sent to all tasks, about four times ``n`` a label, and only their texts are read on.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality", F.xxhash64(F.col("doc_id").cast("long")).alias("h"))
    totals = {r.quality: r["count"] for r in usable.groupBy("quality").count().collect()}
    if not totals:
        return {}
    below = {q: int(min(2**63 - 1, -(2**63) + 4 * n / t * 2**64)) for q, t in totals.items()}
    ids = usable.filter(F.col("h") <= max(below.values())).groupBy("doc_id", "h").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most")
    bound = F.coalesce(*(F.when(F.col("quality") == q, F.lit(b)) for q, b in below.items()))
    ids = ids.filter(F.col("h") <= bound).select("doc_id", "h", "quality")
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", F.substring("text", 1, chars).alias("text")).join(F.broadcast(ids), "doc_id")
    once = texts.groupBy("quality", "h").agg(F.min("text").alias("text"))  # one of several texts of an id
    out = {}
    for q, t in totals.items():
        found = once.filter(F.col("quality") == q).orderBy("h").limit(n).collect()
        out[q] = ([r.text for r in found], t)
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    found = sample(docs, labels)
    (good, n_good), (bad, n_bad) = found.get(1, ([], 0)), found.get(0, ([], 0))
    return train(good, bad, n_good, n_bad)


_scales: dict[tuple[bytes, bytes], Scales] = {}


def scores(texts: list[str], model: Model) -> np.ndarray:
    """How likely label 1 is, of each text."""
    if not len(model.mean):
        z = np.full(len(texts), model.weights[0])
    else:
        key = (model.good, model.bad)
        if key not in _scales:
            _scales.clear()
            _scales[key] = Scales(*key)
        x = _surface(np.array([_scales[key].measures(t) for t in texts], float).reshape(-1, 4))
        z = model.weights[0] + (x - model.mean) / model.deviation @ model.weights[1:]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model, bar: float = BAR) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([np.empty(0), *(scores([batch.column(2)[i].as_py() or ""], model) for i in range(batch.num_rows))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= bar).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op13_quality_classifier": query}
SQL: dict[str, str] = {}
