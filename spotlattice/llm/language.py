"""Operator 4, language identification by cross-parsing entropy.

For each language a suffix automaton holds a sample of labelled text. A text is
parsed against it from left to right into the longest phrases that occur in the
sample; text of the same language needs fewer of them. With ``c`` phrases for
``N`` characters and ``n`` sampled characters the cross-parsing entropy is
``c log2(n) / N``; the language with the least wins.

Texts are lower-cased, runs of other characters than letters become one space,
and the parse starts anew every ``BLOCK`` characters, so blocks of one batch
advance together in numpy, one character a step, over transition tables that are dense
in the letters of their own language; letters that its sample lacks share one column.

Learned from: texts with a label that ``training_rows`` lets in, at most
``SAMPLE_DOCS`` documents and ``SAMPLE_CHARS`` characters a language, chosen by
the hash of their ids. Everything else runs over all whole texts, without a
shuffle. Label, source and id are never inputs of a prediction.

Defined cases: null texts and texts without a letter get ``und`` and score 0, as
all do if nothing can be learned; very long texts are parsed whole; an empty table gives an empty result; a single learned language wins with score 1;
ties go to the language first in alphabetical order; repeated rows are judged
alike; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlattice.llm.common import least_hashes, table

SAMPLE_DOCS = 64
SAMPLE_CHARS = 40_000
BLOCK = 1024
_BATCH = 4_000_000
UNKNOWN = "und"
_SPACE, _OTHER = 0, 1


@functools.cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


class Alphabet:
    """Codes of the letters of the samples; 0 is a space, 1 any other letter."""

    def __init__(self, texts: list[str]):
        seen = np.unique(np.concatenate([np.empty(0, np.uint32), *map(_points, texts)]))
        seen = seen[_letters()[seen]]
        self.size = len(seen) + 2
        self.code = np.where(_letters(), _OTHER, _SPACE).astype(np.int32)
        self.code[seen] = np.arange(2, self.size)

    def encode(self, text: str) -> np.ndarray:
        c = self.code[_points(text)]
        if len(c) == 0:
            return c
        keep = c != _SPACE
        keep[1:] |= c[:-1] != _SPACE
        return c[keep]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the states of the suffix automaton; state 0 is the root."""
    go, link, length = [{}], [-1], [0]
    last = 0
    for c in codes:
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return go


class Model:
    """Dense transition tables of all languages. ``samples``: language to sampled text."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        self.alphabet = Alphabet(list(samples.values()))
        self.tables, self.bits, self.columns = [], [], []
        for name in self.names:
            codes = self.alphabet.encode(samples[name])
            # columns of this language's table: its own letters, and one for all others
            own = np.unique(np.concatenate([codes, np.array([_SPACE, _OTHER], codes.dtype)]))
            column = np.full(self.alphabet.size, _OTHER, np.int32)
            column[own] = np.arange(len(own))
            codes, a = column[codes], len(own)
            self.columns.append(column)
            go = suffix_automaton(codes.tolist())
            # entries hold the row's offset; 0, the root, stands for no transition
            dense = np.zeros(len(go) * a, np.int32)
            at = np.repeat(np.arange(len(go), dtype=np.int64) * a, [len(g) for g in go]) + np.fromiter((c for g in go for c in g), np.int64)
            dense[at] = np.fromiter((t for g in go for t in g.values()), np.int64) * a
            self.tables.append(dense)
            self.bits.append(np.log2(max(2, len(codes))))

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Number of phrases of each encoded text in each language."""
        sizes = np.array([len(t) for t in texts], np.int64)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        length = np.minimum(BLOCK, sizes[owner] - place * BLOCK)
        order = np.argsort(-length, kind="stable")
        grid = np.zeros((len(owner), BLOCK), np.int32)
        flat = np.concatenate([np.empty(0, np.int32), *texts])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        row = np.repeat(rank, length)
        grid[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
        grid = np.ascontiguousarray(grid.T)
        active = np.searchsorted(-length[order], -np.arange(BLOCK), "left")
        out = np.zeros((len(texts), len(self.names)), np.int64)
        for k, (dense, column) in enumerate(zip(self.tables, self.columns, strict=True)):
            root = dense[: int(column.max()) + 1]
            state, count = np.zeros(len(owner), np.int32), np.zeros(len(owner), np.int32)
            for t in range(BLOCK):
                n = active[t]
                if n == 0:
                    break
                c, s = column.take(grid[t, :n]), state[:n]
                to = dense.take(s + c)
                fresh = to == 0
                count[:n] += fresh | (s == 0)
                state[:n] = np.where(fresh, root.take(c), to)
            np.add.at(out[:, k], owner[order], count)
        return out

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and a score of each text: how far the second falls behind."""
        codes = [self.alphabet.encode(t or "") for t in texts]
        counts = self.phrases(codes) * np.array(self.bits, float)
        out = []
        for c, h in zip(codes, counts, strict=True):
            if not len(self.names) or not (c != _SPACE).any():
                out.append((UNKNOWN, 0.0))
            elif len(h) == 1:
                out.append((self.names[0], 1.0))
            else:
                best = int(np.argmin(h))
                second = float(np.min(np.delete(h, best)))
                out.append((self.names[best], 1.0 - float(h[best]) / second))
        return out


_models: dict[tuple, Model] = {}


def _model(samples: tuple[tuple[str, str], ...]) -> Model:
    if samples not in _models:
        _models.clear()
        _models[samples] = Model(dict(samples))
    return _models[samples]


def training_rows(docs: DataFrame) -> DataFrame:
    """The documents that may be learned from: with a label and not held out."""
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """A bounded sample of text for each language of ``training_rows``."""
    rows = training_rows(docs)
    samples = {}
    for name, total in rows.groupBy("lang").count().collect():
        # the total is that of the language, the bound is on the hash of the id
        some = rows.filter(F.col("lang") == name).select(F.xxhash64("doc_id").alias("h"), F.substring("text", 1, sample_chars).alias("text"))
        samples[name] = " ".join(r.text for r in least_hashes(some, sample_docs, total))[:sample_chars]
    return samples


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(sorted(samples.items())))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent.value)
        for batch in batches:
            texts, size, start = [], 0, 0
            for i in range(batch.num_rows):
                texts.append(batch.column(2)[i].as_py())
                size += len(texts[-1] or "")
                if size >= _BATCH or i == batch.num_rows - 1:
                    found = model.judge(texts)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, len(texts)), batch.column(1).slice(start, len(texts)), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                        ["doc_id", "held_out", "lang_pred", "score"],
                    )
                    texts, size, start = [], 0, i + 1

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


QUERIES = {"op4_language_id": query}
SQL: dict[str, str] = {}
