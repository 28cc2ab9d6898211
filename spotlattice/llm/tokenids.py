"""Operator 10, token-id files: independent zstandard frames with a seek table.

One file (``.tok``) follows the public zstandard seekable format:

* data frames, each compressed on its own with a content checksum. A frame holds
  whole documents: ``u32 n``, then ``n`` document ids (``i64``), ``n`` lengths
  (``u32``), ``n`` flags (``u8``, 1 where the id is null) and all token ids (``u32``),
  little-endian;
* a skippable frame with the index of the documents that have an id:
  ``(i64 doc_id, u32 frame, u32 place)``;
* the seek table, a skippable frame with compressed size, decompressed size and
  the low half of the XXH64 of each frame, and the footer.

Any zstandard reader decodes the file in order. ``read_documents`` decompresses
only the frames that hold the requested documents.

Documents are range-partitioned and sorted by id, then by the hash of the text, so the
order of the files is the order of ids, and the rows of one id that many share are cut
into several files; one file per task. A task writes under a name of its own
attempt and reports it in the manifest, so a task that runs again after a lost
executor leaves an unlisted file at worst. Token totals of the files, summed in
file order, give every document its global start. Files are read back one in a task.

Defined cases: null text counts as empty and holds only the end id; rows with a null id
come first, carry a flag and come back as null; rows with one id follow each other,
ordered by the hash of the text; very long texts are written whole, as a frame of their
own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotlattice.llm.common import materialise, shared_dir, table

END_ID = 2
FRAME_BYTES = 1 << 18
LEVEL = 1
_SKIP_INDEX, _SKIP_SEEK, _SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_CACHE = 500_000
_GLUED = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Parts(dict):
    """Number of each part; parts met for the first time are queued in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self)
        self.new.append(part)
        return n


class Encoder:
    """Byte-level BPE of whole texts by way of their distinct parts.

    The pre-tokenizer always cuts before a space that follows a character other
    than white space, so the parts between such cuts are encoded independently
    of each other. Each distinct part is encoded once and remembered; new ones
    go to the tokenizer joined, and the byte lengths of the ids part them again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        n = self.tokenizer.get_vocab_size()
        # byte-level tokens are written with one character for each byte
        self.bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(n)], np.int64)
        self._reset()

    def _reset(self) -> None:
        self.at = _Parts()
        self.flat, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Encodes the queued parts, each with a space before it."""
        new, self.at.new = self.at.new, []
        open_end = np.array([not p or p[-1].isspace() for p in new], bool)
        order = np.argsort(~open_end, kind="stable")  # those that end in white space are encoded alone
        alone, joined = int(open_end.sum()), [p for p, x in zip(new, open_end.tolist(), strict=True) if not x]
        ids = self._ids([" " + new[i] for i in order[:alone]])
        sizes = [np.array([len(x) for x in ids], np.int64)]
        blocks = [joined[i : i + 1000] for i in range(0, len(joined), 1000)]
        for block, got in zip(blocks, self._ids([" " + " ".join(b) for b in blocks]), strict=True):
            spaces = np.flatnonzero(np.frombuffer((" ".join(block) + " ").encode(), np.uint8) == 32)
            # a part ends at the next space, unless parts hold spaces themselves
            ends = spaces + 1 if len(spaces) == len(block) else np.cumsum([len(p.encode()) + 1 for p in block])
            sizes.append(np.diff(np.searchsorted(np.cumsum(self.bytes[got]), ends) + 1, prepend=0))
            ids.append(got)
        size = np.concatenate(sizes)
        at = np.empty((2, len(new)), np.int64)
        at[0, order] = np.cumsum(size) - size + len(self.flat)
        at[1, order] = size
        self.starts, self.sizes = np.concatenate([self.starts, at[0]]), np.concatenate([self.sizes, at[1]])
        self.flat = np.concatenate([self.flat, *ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts one after another, and the number of each."""
        cut = [_CUT.split(t) if _GLUED.search(t) else t.split(" ") for t in texts]
        first = self._ids([parts[0] for parts in cut])
        if len(self.at) > _CACHE:
            self._reset()
        n = np.array([0, *(len(parts) - 1 for parts in cut)], np.int64)
        at = np.fromiter(map(self.at.__getitem__, chain.from_iterable(parts[1:] for parts in cut)), np.int64, int(n.sum()))
        if self.at.new:
            self._learn()
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        gathered = self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[np.cumsum(n)]
        out = [x for f, a, b in zip(first, edges[:-1], edges[1:], strict=True) for x in (f, gathered[a:b])]
        total = np.array([len(f) for f in first], np.int64) + np.diff(edges)
        return np.concatenate([np.empty(0, np.uint32), *out]), total


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Writer:
    """Writes one file in the format above to an open binary stream."""

    def __init__(self, out):
        self.out, self.frames, self.index = out, [], []
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.bytes = 0
        self.squeeze = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.docs and self.bytes + 4 * len(ids) > FRAME_BYTES:
            self._flush()
        if doc_id is not None:
            self.index.append((doc_id, len(self.frames), len(self.docs)))
        self.docs.append((doc_id, ids))
        self.bytes += 4 * len(ids)

    def _flush(self) -> None:
        n = len(self.docs)
        raw = b"".join(
            [
                struct.pack("<I", n),
                np.array([d or 0 for d, _ in self.docs], "<i8").tobytes(),
                np.array([len(x) for _, x in self.docs], "<u4").tobytes(),
                np.array([d is None for d, _ in self.docs], "u1").tobytes(),
                *(x.astype("<u4", copy=False).tobytes() for _, x in self.docs),
            ]
        )
        packed = self.squeeze.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.docs, self.bytes = [], 0

    def close(self) -> None:
        if self.docs:
            self._flush()
        index = b"".join(struct.pack("<qII", *x) for x in self.index)
        self.out.write(struct.pack("<II", _SKIP_INDEX, len(index)) + index)
        table_ = b"".join(struct.pack("<III", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIP_SEEK, len(table_)) + table_)
        self.out.close()


class Reader:
    """Random access to one file: a seekable binary stream."""

    def __init__(self, stream):
        self.stream = stream
        end = stream.seek(0, io.SEEK_END)
        stream.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", stream.read(9))
        if magic != _SEEKABLE or flags != 0x80:
            raise ValueError("no seek table with checksums")
        at = end - 9 - 12 * n - 8
        stream.seek(at)
        kind, size = struct.unpack("<II", stream.read(8))
        if kind != _SKIP_SEEK or size != 12 * n + 9:
            raise ValueError("broken seek table")
        self.frames = [struct.unpack("<III", stream.read(12)) for _ in range(n)]
        self.starts = np.concatenate([[0], np.cumsum([f[0] for f in self.frames])]).astype(np.int64)
        self.index_at = int(self.starts[-1])
        self.expand = zstandard.ZstdDecompressor()

    def index(self) -> list[tuple[int, int, int]]:
        self.stream.seek(self.index_at)
        kind, size = struct.unpack("<II", self.stream.read(8))
        if kind != _SKIP_INDEX:
            raise ValueError("no document index")
        return list(struct.iter_unpack("<qII", self.stream.read(size)))

    def frame(self, k: int) -> list[tuple[int | None, np.ndarray]]:
        packed, size, check = self.frames[k]
        self.stream.seek(int(self.starts[k]))
        raw = self.expand.decompress(self.stream.read(packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} does not match its checksum")
        (n,) = struct.unpack_from("<I", raw)
        docs = np.frombuffer(raw, "<i8", n, 4)
        sizes = np.frombuffer(raw, "<u4", n, 4 + 8 * n).astype(np.int64)
        null = np.frombuffer(raw, "u1", n, 4 + 12 * n)
        ids = np.frombuffer(raw, "<u4", int(sizes.sum()), 4 + 13 * n)
        ends = np.cumsum(sizes)
        return [(None if x else int(d), ids[e - s : e]) for d, x, s, e in zip(docs, null, sizes, ends, strict=True)]

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.frames)):
            yield from self.frame(k)


def _open(folder: str):
    """The file system and path of a folder given as a URI (any that Arrow knows)."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def read_documents(folder: str, file: str, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
    """The ids of the requested documents of one file; other frames stay packed."""
    fs, base = _open(folder)
    wanted = set(doc_ids)
    with fs.open_input_file(f"{base}/{file}") as stream:
        r = Reader(stream)
        found: dict[int, list] = {}
        for d, frame, place in r.index():
            if d in wanted:
                found.setdefault(frame, []).append((d, place))
        return {d: r.frame(frame)[place][1] for frame, docs in found.items() for d, place in docs}


def write(spark: SparkSession, docs: DataFrame, folder: str, path: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ``folder`` and returns its manifest: file_no, file, n_docs, n_tokens and start of each file."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    # the salt lets the range partition cut between equal rows, whose order does not matter
    rows = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange("doc_id", "h", "salt")
    ordered = rows.sortWithinPartitions("doc_id", "h", "salt").select("doc_id", "text")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        encode = encoder(path)
        fs, base = _open(folder)
        writer, n_docs, n_tokens, name = None, 0, 0, f"part-{number:06d}-{uuid.uuid4().hex}.tok"
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                ids, sizes = encode.encode([t or "" for t in some.column("text").to_pylist()])
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    writer = Writer(fs.open_output_stream(f"{base}/{name}", compression=None))
                at = 0
                for d, n in zip(some.column("doc_id").to_pylist(), sizes.tolist(), strict=True):
                    writer.add(d, np.append(ids[at : at + n], np.uint32(end_id)))
                    at += n
                    n_docs += 1
                    n_tokens += n + 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([number], pa.int32()), "file": [name], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    files = ordered.mapInArrow(save, "file_no int, file string, n_docs long, n_tokens long")
    files = materialise(spark, files, "token-manifest")
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the listed files: doc_id, start, n_tokens, ids_crc32."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows: list[tuple] = []
                with fs.open_input_file(f"{base}/{file}") as stream:
                    for d, ids in Reader(stream):
                        rows.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    # a stated number of partitions is never coalesced: one file in a task
    return manifest.repartition(max(1, manifest.count())).mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-ids")
    return read(write(spark, table(spark, sf_dir, "documents"), folder, vocabulary()), folder)


QUERIES = {"op10_token_ids": query}
SQL: dict[str, str] = {}
