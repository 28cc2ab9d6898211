"""Operator 7, SentencePiece encoding and decoding by batched Viterbi in numpy.

A text becomes words: an escaped space before it and for each space, words are
cut before each run of escaped spaces, which no piece crosses. Every distinct
word is encoded once. Words of equal length advance together, one character a
step: rolling hashes give the substrings that end there, the hashes probe the
sorted piece keys, and the chosen last piece of each prefix is the backpointer.

Which candidate is chosen depends on the kind of the model.

* Unigram: the largest sum of scores, ``max_k best[i - k] + score``.
* BPE (the given file is one): the largest sum is not what the format means, so
  a candidate counts only if it fits the piece before it. A sequence of pieces
  is the encoding of a word exactly when each two neighbours encode as
  themselves, so one candidate at each place fits, and the ids equal those of the
  public library. Two pieces fit unless undoing their merges from the latest back
  shows a merge over the border that would have come first.

Characters without a piece are written as their UTF-8 bytes. A few pieces (long
runs of one character) share one score; words with them, very long words and
lone long ones are encoded one by one with a heap.

Defined cases: null and empty texts have no ids and decode to the empty text; a
literal U+2581 counts as a space, as in the format; repeated rows are treated
alike; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlattice.llm.common import table

SPACE = "▁"
_CACHE = 400_000
_LONG, _FEW = 256, 4
_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)
_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _hash(s: str) -> int:
    h = 0
    for c in s:
        h = (h * int(_P) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


class Vocabulary:
    """Pieces of a model file with their keys; ``kind`` is ``bpe`` or ``unigram``."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.kind, self.unknown = kind, n
        self.pieces = [sp.id_to_piece(i) for i in range(n)] + [""]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.score = np.array([sp.get_score(i) for i in range(n)] + [sp.get_score(0) - 1e6], np.float64)
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.ids = {self.pieces[i]: i for i in range(n) if not special[i]}
        self.text = [b"" if special[i] else self.pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        for value, i in self.byte.items():
            self.text[i] = bytes([value])
        self.longest = max(map(len, self.ids))
        at = np.array(list(self.ids.values()), np.int64)
        key = np.array([_hash(p) for p in self.ids], np.uint64)
        order = np.argsort(key)
        self.keys, self.key_ids = key[order], at[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[((key * _M) >> np.uint64(44)).astype(np.int64)] = True
        self.power = np.ones(self.longest + 1, np.uint64)
        self.power[1:] = np.cumprod(np.full(self.longest, _P))
        self._splits(n)

    def _splits(self, n: int) -> None:
        """For each piece the two parts of its last merge, when it was made, and whether it encodes as itself."""
        levels = -np.unique(-self.score)
        self.rank = np.searchsorted(-levels, -self.score).astype(np.int64)
        self.hash = np.full(n + 1, 0x5DEECE66D1234567, np.uint64)
        self.size = np.ones(n + 1, np.int64)
        self.made = np.full(n + 1, -1, np.int64)
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        self.whole = np.zeros(n + 1, bool)
        self.whole[n] = True
        for p, i in self.ids.items():
            self.hash[i], self.size[i] = _hash(p), len(p)
            if len(p) == 1:
                self.whole[i] = True
                continue
            merges: list[tuple[int, int]] = []
            if self.kind == "bpe" and self.one_by_one(p, merges) == [i]:
                self.whole[i] = True
                self.left[i], self.right[i] = merges[-1]
                self.made[i] = self.rank[i]
        shared = {r for r, k in zip(*np.unique(self.rank[list(self.ids.values())], return_counts=True), strict=True) if k > 1}
        tied = [re.escape(p) for p, i in self.ids.items() if self.rank[i] in shared and len(p) > 1]
        self.tied = re.compile("|".join(sorted(tied, key=len))) if tied else None

    def one_by_one(self, word: str, merges: list | None = None) -> list[int]:
        """The plain method: merge the best pair, leftmost first, until none is left."""
        ids = [self.ids.get(c, self.unknown) for c in word]
        text = list(word)
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple] = []

        def offer(a: int) -> None:
            b = after[a] if a >= 0 else len(ids)
            if 0 <= a and b < len(ids):
                new = self.ids.get(text[a] + text[b])
                if new is not None:
                    heapq.heappush(heap, (-self.score[new], a, len(text[a]), len(text[b]), new))

        for a in range(len(ids) - 1):
            offer(a)
        while heap:
            _, a, x, y, new = heapq.heappop(heap)
            b = after[a]
            if b >= len(ids) or len(text[a]) != x or len(text[b]) != y or not x:
                continue
            if merges is not None:
                merges.append((ids[a], ids[b]))
            ids[a], text[a], text[b] = new, text[a] + text[b], ""
            after[a] = after[b]
            if after[b] < len(ids):
                before[after[b]] = a
            offer(a)
            offer(before[a])
        return [i for i, t in zip(ids, text, strict=True) if t]

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Piece ids of hashes, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        some = np.flatnonzero(self.maybe[((keys * _M) >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        hit = self.keys[at] == keys[some]
        out[some[hit]] = self.key_ids[at[hit]]
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces encodes as itself."""
        pairs, back = np.unique(a * len(self.pieces) + b, return_inverse=True)
        a, b = pairs // len(self.pieces), pairs % len(self.pieces)
        good = self.whole[a] & self.whole[b]
        live = np.flatnonzero(good)
        a, b = a[live], b[live]
        limit = np.full(len(live), 1 << 40, np.int64)
        while len(live):
            joint = self.size[a] + self.size[b]
            over = self.probe(np.where(joint <= self.longest, self.hash[a] * self.power[self.size[b]] + self.hash[b], np.uint64(0)))
            bad = (over >= 0) & (self.rank[over] < limit)
            good[live[bad]] = False
            first = self.made[a] > self.made[b]
            go = ~bad & (np.maximum(self.made[a], self.made[b]) >= 0)
            live, a, b, first = live[go], a[go], b[go], first[go]
            limit = np.where(first, self.made[a], self.made[b] + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return good[back]

    def encode_equal(self, words: list[str]) -> list[list[int]]:
        """Ids of words of one length; ``unknown`` stands for a character without a piece."""
        n, size = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32).reshape(n, size).T.astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((size + 1, n), np.uint64)
        for i in range(size):
            prefix[i + 1] = prefix[i] * _P + codes[i]
        last = np.full((size + 1, n), -1, np.int64)
        step = np.zeros((size + 1, n), np.int64)
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        for i in range(1, size + 1):
            reach = min(i, self.longest)
            ends = np.stack([prefix[i] - prefix[i - k] * self.power[k] for k in range(1, reach + 1)])
            ids = self.probe(ends.ravel()).reshape(reach, n)
            ids[0] = np.where(ids[0] < 0, self.unknown, ids[0])
            k, lane = np.nonzero(ids >= 0)
            piece = ids[k, lane]
            start = i - 1 - k
            if self.kind == "bpe":
                before = last[start, lane]
                ok = self.whole[piece] & ((start == 0) | (before >= 0))
                far = ok & (start > 0)
                ok[far] = self.fits(before[far], piece[far])
                k, lane, piece = k[ok], lane[ok], piece[ok]
                last[i, lane], step[i, lane] = piece, k + 1
            else:
                total = np.full((reach, n), -np.inf)
                total[k, lane] = best[start, lane] + self.score[piece]
                top = total.argmax(axis=0)
                lanes = np.arange(n)
                best[i], last[i], step[i] = total[top, lanes], ids[top, lanes], top + 1
        out: list[list[int]] = [[] for _ in words]
        place, lanes = np.full(n, size), np.arange(n)
        broken = (last[1:] < 0).any(axis=0)
        while len(lanes):
            for w, p in zip(lanes.tolist(), last[place, lanes].tolist(), strict=True):
                out[w].append(p)
            place = place - step[place, lanes]
            more = (place > 0) & (step[place, lanes] > 0)
            place, lanes = place[more], lanes[more]
        return [self.one_by_one(w) if bad else ids[::-1] for w, ids, bad in zip(words, out, broken.tolist(), strict=True)]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, with unknown characters as bytes."""
        found: dict[str, list[int]] = {}
        groups: dict[int, list[str]] = {}
        for w in words:
            if self.kind == "bpe" and (len(w) > _LONG or self.tied and self.tied.search(w)):
                found[w] = self.one_by_one(w)
            else:
                groups.setdefault(len(w), []).append(w)
        for size, some in groups.items():
            alone = self.kind == "bpe" and len(some) < _FEW and size > 24
            found |= dict(zip(some, map(self.one_by_one, some) if alone else self.encode_equal(some), strict=True))
        return [self._bytes(w, found[w]) for w in words]

    def _bytes(self, word: str, ids: list[int]) -> list[int]:
        if self.unknown not in ids:
            return ids
        out, at = [], 0
        for i in ids:
            if i == self.unknown:
                out += [self.byte.get(b, 0) for b in word[at].encode("utf-8", "replace")]
                at += 1
            else:
                out.append(i)
                at += len(self.pieces[i])
        return out


class _Words(dict):
    """Number of each word; words met for the first time are queued in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Whole texts to ids and back, by way of their distinct words."""

    def __init__(self, path: str, kind: str = "bpe"):
        self.vocabulary = Vocabulary(path, kind)
        self._reset()

    def _reset(self) -> None:
        self.at, self.flat = _Words(), np.empty(0, np.int32)
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts one after another, and the number of each."""
        if len(self.at) > _CACHE:
            self._reset()
        cut = []
        for t in texts:
            parts = t.replace(SPACE, " ").split(" ") if t else []
            if t and "" in parts:  # runs of spaces, or spaces at an end
                parts = [w[1:] for w in _RUNS.findall(SPACE + t.replace(" ", SPACE))]
            cut.append(parts)
        n = np.array([0, *map(len, cut)], np.int64)
        at = np.fromiter(map(self.at.__getitem__, (p for parts in cut for p in parts)), np.int64, int(n.sum()))
        if self.at.new:
            new, self.at.new = self.at.new, []
            ids = self.vocabulary.encode_words([SPACE + w for w in new])
            sizes = np.array(list(map(len, ids)), np.int64)
            self.starts = np.concatenate([self.starts, np.cumsum(sizes) - sizes + len(self.flat)])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(sizes.sum()))])
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.diff(np.concatenate([[0], ends])[np.cumsum(n)])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space that encoding put before it goes."""
        text = b"".join(map(self.vocabulary.text.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str = "bpe") -> Encoder:
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_crc32, round_trip (decoding gives the text again) and, if wanted, ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                flat, sizes = e.encode(texts)
                ends = np.cumsum(sizes)
                each = [flat[b - n : b] for n, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
                columns = [
                    part.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64()),
                    pa.array([e.decode(x) == t.replace(SPACE, " ") for x, t in zip(each, texts, strict=True)]),
                ]
                names = ["doc_id", "n_tokens", "ids_crc32", "round_trip"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat, pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows with ``ids``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            texts = [e.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


QUERIES = {"op7_sentencepiece": query}
SQL: dict[str, str] = {}
