"""Operator 11, the fill-in-middle transformation.

A text is cut into units, runs of ASCII letters or single other characters. The
places where a unit may end are held as a set of code-point offsets in the
manner of Roaring bitmaps: the offsets of one stretch of 65,536 lie in a
container that is a sorted array, a bitmap or a list of runs, whichever takes least room,
and the cumulative cardinalities of the containers are kept. The offset after ``k``
units is the ``k``-th member: a search of the cumulative cardinalities finds the container,
a select inside it the member. Both cuts of a document are two such selects.

Which units the cuts follow, and which form a document takes, are told by the
SHA-256 of a salt and its id, computed by Spark; the form and both cuts need
nothing but the row itself, so there is no shuffle. ``restored`` rebuilds the
text from output and form by built-in functions.

Defined cases: a null text counts as empty; an empty text, and one that holds a
mark, stays plain; very long texts are cut whole, with more containers; a null id
is hashed as an empty one; where both cuts fall together the middle is empty;
repeated rows are treated alike; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlattice.llm.common import table

# The marks of prefix, suffix and middle, and the shares of the forms in hundredths.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
SALT = "1:"

_SPAN = 1 << 16
_ARRAY_MOST = 4096


class ArrayContainer:
    """Sorted low halves of the offsets."""

    def __init__(self, present: np.ndarray):
        self.low = np.flatnonzero(present).astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """65,536 bits in words of 64, with the count of bits before each word."""

    def __init__(self, present: np.ndarray):
        bits = np.zeros(_SPAN, bool)
        bits[: len(present)] = present
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right"))
        rest = k - (int(self.before[word - 1]) if word else 0)
        bits = np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little")
        return word * 64 + int(np.flatnonzero(bits)[rest])


class RunContainer:
    """Starts of the runs of consecutive offsets, with the count of members before the end of each."""

    def __init__(self, present: np.ndarray):
        edge = np.diff(present.astype(np.int8), prepend=0, append=0)
        self.starts = np.flatnonzero(edge == 1)
        self.through = np.cumsum(np.flatnonzero(edge == -1) - self.starts)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.through, k, "right"))
        return int(self.starts[run]) + k - (int(self.through[run - 1]) if run else 0)


def container(present: np.ndarray) -> tuple[ArrayContainer | BitmapContainer | RunContainer, int]:
    """The smallest container of the offsets at which ``present`` is true, and how many they are."""
    n = int(np.count_nonzero(present))
    runs = int(present[:1].sum()) + int(np.count_nonzero(present[1:] & ~present[:-1]))
    if 4 * runs < min(2 * n, _SPAN // 8):
        return RunContainer(present), n
    return (ArrayContainer(present) if n <= _ARRAY_MOST else BitmapContainer(present)), n


class BoundarySet:
    """Where the units of a text may be cut: 0, and the end of each unit."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = ((points | np.uint32(32)) - np.uint32(97)) < 26
        present = np.ones(len(points) + 1, bool)
        np.logical_not(letter[1:] & letter[:-1], out=present[1:-1])
        made = [container(present[i : i + _SPAN]) for i in range(0, len(present), _SPAN)]
        self.containers = [c for c, _ in made]
        self.through = np.cumsum([n for _, n in made])

    @property
    def units(self) -> int:
        return int(self.through[-1]) - 1

    def select(self, k: int) -> int:
        """The offset after ``k`` units."""
        at = int(np.searchsorted(self.through, k, "right"))
        return at * _SPAN + self.containers[at].select(k - (int(self.through[at - 1]) if at else 0))


def cut(text: str, a: int, b: int) -> tuple[int, int, int]:
    """(units, first, second): how many units there are and the offsets of the two cuts that ``a`` and ``b`` draw."""
    ends = BoundarySet(text)
    low, high = sorted((a % (ends.units + 1), b % (ends.units + 1)))
    return ends.units, ends.select(low), ends.select(high)


def _draws(doc_id: Column, salt: str) -> list[Column]:
    """Four numbers below 2^32 from the salt and the id."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", salt: str = SALT, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """Per row: ``doc_id``, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``."""
    body = F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = _draws(F.col(key), salt)
    marked = body.contains(PREFIX) | body.contains(SUFFIX) | body.contains(MIDDLE)
    form = F.when((body == "") | marked | (h3 % 100 >= plain_from), "plain").when(h4 % 100 < spm_below, "spm").otherwise("psm")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cut(batch.column(4)[i].as_py(), batch.column(2)[i].as_py(), batch.column(3)[i].as_py()) for i in range(batch.num_rows)]
            n, first, second = (pa.array([f[i] for f in found], pa.int64()) for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, first, second, batch.column(4)], ["id", "form", "n", "first", "second", "body"])

    rows = docs.select(F.col(key).alias("id"), form.alias("form"), h1.alias("h1"), h2.alias("h2"), body.alias("body"))
    kind = docs.schema[key].dataType.simpleString()
    cuts = rows.mapInArrow(work, f"id {kind}, form string, n long, first long, second long, body string")
    body, first, second = F.col("body"), F.col("first").cast("int"), F.col("second").cast("int")
    parts = {PREFIX: F.substring(body, F.lit(1), first), MIDDLE: F.substring(body, first + 1, second - first), SUFFIX: F.substring(body, second + 1, F.length(body))}
    order = lambda *marks: F.concat(*(x for m in marks for x in (F.lit(m), parts[m])))
    plain = F.col("form") == "plain"
    return cuts.select(
        F.col("id").alias("doc_id"),
        "n",
        "form",
        F.when(~plain, F.col("first")).alias("prefix_chars"),
        F.when(~plain, F.col("second") - F.col("first")).alias("middle_chars"),
        F.when(plain, body).when(F.col("form") == "psm", order(PREFIX, SUFFIX, MIDDLE)).otherwise(order(SUFFIX, PREFIX, MIDDLE)).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text from the output and its form alone: no part holds a mark, so the first of each kind is the one that was set."""
    one, two, three = F.when(form == "psm", PREFIX).otherwise(SUFFIX), F.when(form == "psm", SUFFIX).otherwise(PREFIX), F.lit(MIDDLE)
    at_two, at_three, wide = F.instr(output, two), F.instr(output, three), F.length(one)
    head = F.substring(output, wide + 1, at_two - wide - 1)
    tail = F.substring(output, at_two + wide, at_three - at_two - wide)
    middle = F.substring(output, at_three + wide, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, tail)).otherwise(F.concat(tail, middle, head))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SALT}' || coalesce(doc_id::VARCHAR, '')) AS s,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
h AS (SELECT doc_id, text, u, len(u)::BIGINT AS n,
    ('0x' || s[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || s[9:16])::BIGINT % (len(u) + 1) AS b,
    ('0x' || s[17:24])::BIGINT % 100 AS c, ('0x' || s[25:32])::BIGINT % 100 AS e FROM d),
p AS (SELECT doc_id, text, n, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR c >= {PLAIN_FROM} THEN 'plain' WHEN e < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""

QUERIES = {"op11_fill_in_middle": query}
SQL = {"op11_fill_in_middle": ORACLE}
