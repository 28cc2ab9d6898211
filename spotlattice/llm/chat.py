"""Operator 3, chat formatting: a hidden Markov model recovers roles, then turns are rendered.

The hidden states are the roles. What is seen of a turn is its speaker marker
(a name before a colon on its first line), its length, its number of lines and
whether it ends with a question mark. Start, transition and feature
probabilities are counts over all labelled turns that may be learned from,
with one added to each, and a part ``NAMED`` of the marker's is fixed by its name; a conversation is decoded by Viterbi and each turn is
rendered in one canonical form.

A conversation may hold any share of the rows, so no task needs the texts of all
of it: turns get places in the order of (conversation, turn, text) by a range
partition, and blocks are runs of at most ``BLOCK`` places, whatever the turn
numbers are. Only small numbers are collected in blocks; texts meet their roles
again by place. Each block gives a role-by-role matrix of best path scores; the matrices of a conversation, one for
``BLOCK`` turns, are chained to find the roles at the borders of its blocks; then
each block is decoded between its borders. The path is the exact Viterbi path.

Defined cases: a null text counts as empty; a null turn comes first; turns with
one number follow each other by text; roles other than the known names are not
learned from but still recovered; ties go to the role first in ``ROLES``; if
nothing can be learned all probabilities are even; a null conversation is one
conversation; ids of conversations may be of any type that has an order; very long turns
are rendered whole; marks of turns inside a text are escaped; an empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlattice.llm.common import materialise, table

ROLES = ("system", "user", "assistant")
# Names of speakers in transcripts.
MARKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "me"),
    "assistant": ("assistant", "ai", "bot", "model", "agent", "answer", "a"),
}
BLOCK = 256
#: Weight of the belief that a marker names its own role, for data that show few markers.
NAMED = 0.1
_SIZES = {"marker": len(ROLES) + 2, "length": 24, "lines": 5, "asks": 2}
_MARK = r"^\s*[\[(<*#]*\s*([A-Za-z]+)\s*[\])>*]*\s*:"


def features(text: Column) -> dict[str, Column]:
    """Small whole numbers that describe a turn, by built-in functions."""
    text = F.coalesce(text, F.lit(""))
    name = F.lower(F.regexp_extract(text, _MARK, 1))
    marker = F.when(name == "", 0)
    for i, role in enumerate(ROLES):
        marker = marker.when(name.isin(*MARKERS[role]), i + 1)
    bits = F.floor(2 * F.log2(1.0 + F.length(text)))
    return {
        "marker": marker.otherwise(len(ROLES) + 1),
        "length": F.least(bits, F.lit(_SIZES["length"] - 1)).cast("int"),
        "lines": F.least(F.length(text) - F.length(F.translate(text, "\n", "")), F.lit(_SIZES["lines"] - 1)).cast("int"),
        "asks": F.trim(text).endswith("?").cast("int"),
    }


def body(text: Column) -> Column:
    """The text without its speaker marker, trimmed."""
    known = "|".join(n for names in MARKERS.values() for n in names)
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"^\s*[\[(<*#]*\s*(?i:{known})\s*[\])>*]*\s*:[*]*\s*", ""))


class Model(NamedTuple):
    """Log probabilities: start (S), transitions (S, S), and of each feature's values (S, n)."""

    start: np.ndarray
    move: np.ndarray
    emit: dict[str, np.ndarray]


def held_out(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % 5 == 0


def fit(turns: DataFrame) -> Model:
    """Counts over all turns with a known role in conversations that are not held out."""
    known = F.lower("role")
    state = F.lit(None).cast("int")
    for i, role in enumerate(ROLES):
        state = F.when(known.isin(role, *MARKERS[role]), i).otherwise(state)
    rows = turns.filter(~F.coalesce(held_out(F.col("conv_id")), F.lit(False))).select("conv_id", "turn", state.alias("s"), *(c.alias(n) for n, c in features(F.col("text")).items())).filter("s IS NOT NULL")
    emit = {n: np.ones((len(ROLES), size)) for n, size in _SIZES.items()}
    for r in rows.groupBy("s", *_SIZES).count().collect():  # bounded by the numbers of roles and feature values
        for n in _SIZES:
            emit[n][r.s, r[n]] += r["count"]
    first = rows.groupBy("conv_id").agg(F.min_by("s", "turn").alias("s")).groupBy("s").count().collect()
    # a step from one turn number to the next counts once, shared among the roles of rows that repeat a number
    shares = rows.groupBy("conv_id", "turn", "s").count()
    shares = shares.join(shares.groupBy("conv_id", "turn").agg(F.sum("count").alias("all")), ["conv_id", "turn"]).select("conv_id", "turn", "s", (F.col("count") / F.col("all")).alias("p"))
    before = shares.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("s").alias("a"), F.col("p").alias("q"))
    after = before.join(shares, ["conv_id", "turn"]).groupBy("a", "s").agg(F.sum(F.col("p") * F.col("q")).alias("p")).collect()
    start, move = np.ones(len(ROLES)), np.ones((len(ROLES), len(ROLES)))
    for r in first:
        start[r.s] += r["count"]
    for r in after:
        move[r.a, r.s] += r.p
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    named = np.full((len(ROLES), _SIZES["marker"]), 0.01)
    named[np.arange(len(ROLES)), np.arange(len(ROLES)) + 1] = 1
    seen = emit["marker"] - 1 + 0.01
    mixed = (1 - NAMED) * seen / seen.sum(axis=1, keepdims=True) + NAMED * named / named.sum(axis=1, keepdims=True)
    return Model(log(start), log(move), {n: log(x) for n, x in emit.items()} | {"marker": log(mixed)})


def emissions(model: Model, rows: list[dict]) -> np.ndarray:
    """(turns, S) log probabilities of what is seen."""
    return sum(model.emit[n][:, [r[n] for r in rows]] for n in _SIZES).T


def best_matrix(model: Model, e: np.ndarray) -> np.ndarray:
    """Best score of a path through a block from each role at its first turn to each at its last."""
    score = np.where(np.eye(len(e[0]), dtype=bool), e[0], -np.inf)
    for x in e[1:]:
        score = (score[:, :, None] + model.move[None]).max(axis=1) + x
    return score


def borders(model: Model, matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """Roles at the first and last turn of each block on the best path of the conversation."""
    scores, entries, exits = model.start, [], []
    for k, m in enumerate(matrices):
        into = scores if k == 0 else (scores[:, None] + model.move).max(axis=0)
        entries.append(np.arange(len(scores)) if k == 0 else (scores[:, None] + model.move).argmax(axis=0))
        through = into[:, None] + m
        exits.append(through.argmax(axis=0))
        scores = through.max(axis=0)
    out, last = [], int(scores.argmax())
    for k in range(len(matrices) - 1, -1, -1):
        first = int(exits[k][last])
        out.append((first, last))
        last = int(entries[k][first])
    return out[::-1]


def decode(model: Model, e: np.ndarray, first: int, last: int) -> list[int]:
    """The best path of one block between the given roles."""
    score = np.full(e.shape[1], -np.inf)
    score[first] = e[0][first]
    back = []
    for x in e[1:]:
        paths = score[:, None] + model.move
        back.append(paths.argmax(axis=0))
        score = paths.max(axis=0) + x
    path = [last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def recover(spark: SparkSession, turns: DataFrame, model: Model) -> DataFrame:
    """Per row of ``turns(conv_id, turn, text)``: conv_id, turn, role_pred, rendered."""
    turns = turns.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), *(c.alias(n) for n, c in features(F.col("text")).items()))
    # the salt lets the range partition cut between equal rows, whose order does not matter
    spread = turns.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange("conv_id", "turn", "text", "salt").sortWithinPartitions("conv_id", "turn", "text")
    # rises along the partitions and the rows of each; a partition starts at a multiple of BLOCK
    placed = materialise(spark, spread.drop("salt").withColumn("place", F.monotonically_increasing_id()), "chat-places")
    block = F.floor(F.col("place") / BLOCK)
    blocks = placed.groupBy("conv_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", *_SIZES))).alias("rows"))
    sent = spark.sparkContext.broadcast(model)
    kind = turns.schema["conv_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ms = [best_matrix(sent.value, emissions(sent.value, rows)).ravel().tolist() for rows in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ms, pa.list_(pa.float64()))], ["conv_id", "block", "m"])

    scored = blocks.mapInArrow(score, f"conv_id {kind}, block long, m array<double>")
    chains = scored.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "m"))).alias("chain"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for conv, links in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = borders(sent.value, [np.array(x["m"]).reshape(len(ROLES), -1) for x in links])
                out += [(conv, x["block"], i, j) for x, (i, j) in zip(links, found, strict=True)]
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.column(0).type), *(pa.array(c, pa.int64()) for c in columns[1:])], ["c", "b", "i", "j"])

    ends = chains.mapInArrow(chain, f"c {kind}, b long, i long, j long")
    both = blocks.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, roles = [], []
            for rows, i, j in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for r, s in zip(rows, decode(sent.value, emissions(sent.value, rows), i, j), strict=True):
                    places.append(r["place"])
                    roles.append(ROLES[s])
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(roles, pa.string())], ["place", "role_pred"])

    found = both.select("rows", "i", "j").mapInArrow(paths, "place long, role_pred string")
    out = placed.select("place", "conv_id", "turn", "text").join(found, "place")
    return out.select("conv_id", F.col("turn").cast("long"), "role_pred", rendered(F.col("role_pred"), body(F.col("text"))).alias("rendered"))


def rendered(role: Column, text: Column) -> Column:
    """The canonical turn. Where a text has ``<`` and ``|`` with nothing or only backslashes between them, one backslash more is set there, so that no text forges a mark."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|"), F.lit("\n<|end|>"))


def parsed(conversation: Column) -> Column:
    """Roles and texts of the rendered turns of a conversation, in their order, as ``rendered`` was given them."""
    turn = r"<\|([a-z]+)\|>\n([\s\S]*?)\n<\|end\|>"
    pairs = F.arrays_zip(F.regexp_extract_all(conversation, F.lit(turn), F.lit(1)).alias("role"), F.regexp_extract_all(conversation, F.lit(turn), F.lit(2)).alias("text"))
    return F.transform(pairs, lambda t: F.struct(t["role"].alias("role"), F.regexp_replace(t["text"], r"<(\\*)\\\|", r"<$1|").alias("text")))


def turns_of(transcripts: DataFrame) -> DataFrame:
    """(conv_id, turn, text) of whole transcripts ``(conv_id, text)``: a new turn at each line with a speaker marker."""
    lines = transcripts.select("conv_id", F.split(F.regexp_replace(F.coalesce("text", F.lit("")), rf"(?m)(?={_MARK})", "\u0001"), "\u0001").alias("parts"))
    parts = F.filter("parts", lambda p: F.trim(F.translate(p, "\n\r\t", "   ")) != "")
    return lines.select("conv_id", F.posexplode(parts).alias("turn", "text")).select("conv_id", F.col("turn").cast("long"), F.rtrim(F.col("text"), F.lit("\n")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return recover(spark, turns, fit(turns)).withColumn("held_out", held_out(F.col("conv_id")))


QUERIES = {"op3_chat_formatting": query}
SQL: dict[str, str] = {}
