"""Operator 1, quality rules: a threshold table compiled into one Spark projection.

Every rule is a row ``Rule(name, metric, op, threshold)``. ``measures`` turns a
text into a struct of counts with built-in functions only, ``failed`` compiles
the table into one array expression of the names of broken rules. There is no
Python code on the executors, no shuffle and no join: rows stay where they are.

Defined cases: null text counts as the empty text; empty text has no words and
fails the base rule; repeated rows are judged alike, row by row; extra columns
are ignored by ``judge`` and kept by ``keep``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlattice.llm.common import WS, table


class Rule(NamedTuple):
    """``metric op threshold`` must hold, else the rule is broken. Ratios are in thousandths."""

    name: str
    metric: str
    op: str
    threshold: int


# Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "are", "as", "with", "be", "by", "at", "this", "from", "an", "or"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "qui", "dans", "est", "pour", "au", "sur", "par", "pas", "avec"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "lo"],
}
STOP = sorted({w for words in STOP_WORDS.values() for w in words})

RULES = (
    Rule("short_words", "chars_per_word", ">=", 2000),
    Rule("long_words", "chars_per_word", "<=", 14000),
    Rule("symbols", "symbols_per_word", "<=", 300),
    Rule("shouting", "shouts_per_word", "<=", 300),
    Rule("stop_words", "stops_per_word", ">=", 60),
    Rule("repeated_lines", "dup_lines_per_line", "<=", 500),
    Rule("stutter", "stutters_per_word", "<=", 200),
)

BASE_MIN_WORDS = 20
BASE_MAX_REPEAT_PERCENT = 30
WINDOW = 8


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words whose content occurs twice or more in the text."""

    def covered(hashes: Column) -> Column:
        at = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def of_sorted(s: Column) -> Column:
            none = F.array(F.lit(None).cast("struct<h:bigint,p:int>"))
            before = F.concat(none, F.slice(s, 1, F.size(s) - 1))
            after = F.concat(F.slice(s, 2, F.size(s)), none)
            near = F.arrays_zip(s.alias("s"), before.alias("b"), after.alias("a"))
            near = F.filter(near, lambda t: (t["s"]["h"] == t["b"]["h"]) | (t["s"]["h"] == t["a"]["h"]))
            starts = F.array_sort(F.transform(near, lambda t: t["s"]["p"]))
            return _let(
                starts,
                lambda p: F.aggregate(
                    F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width)))),
                    F.lit(0).cast("long"),
                    lambda acc, x: acc + x,
                ),
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(at, of_sorted))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(F.size(words) < width, F.lit(0).cast("long")).otherwise(_let(windows, covered))


def measures(text: Column) -> Column:
    """A struct of counts of one text, all by built-in functions."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(F.translate(text, WS, " " * len(WS)), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, WS, "") != "")
    squeezed = F.translate(text, WS, "")

    def of_words(w: Column) -> Column:
        lowered = F.split(F.lower(F.array_join(w, " ")), " ")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(lowered, lambda x: F.rtrim(x, F.lit(".,")).isin(STOP))).cast("long").alias("n_stop"),
            F.size(F.filter(w, lambda x: x.endswith("!!") | x.endswith("!!!"))).cast("long").alias("n_shout"),
            F.aggregate(
                F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0))),
                F.lit(0).cast("long"),
                lambda acc, x: acc + x,
            ).alias("n_stutter"),
        )

    return F.struct(
        _let(words, of_words).alias("w"),
        F.length(squeezed).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    )


# Each metric as numerator and denominator, compared in thousandths without division.
METRICS = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "shouts_per_word": ("n_shout", "n_words"),
    "stops_per_word": ("n_stop", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "stutters_per_word": ("n_stutter", "n_words"),
}
_PLACES = {"n_words": "w.n_words", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_dup_lines": "l.n_dup_lines", "n_repeat_words": "w.n_repeat_words", "n_lines": "l.n_lines", "n_stop": "w.n_stop", "n_shout": "w.n_shout", "n_stutter": "w.n_stutter"}


def failed(counts: dict[str, Column], rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one expression: the names of broken rules, comma-joined."""
    broken = []
    for r in rules:
        top, bottom = (counts[c] for c in METRICS[r.metric])
        holds = 1000 * top >= r.threshold * bottom if r.op == ">=" else 1000 * top <= r.threshold * bottom
        broken.append(F.when(~holds, F.lit(r.name)))
    return F.concat_ws(",", *broken)


def _judged(docs: DataFrame, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(row, counts, base_failed, failed_rules, kept): the columns of ``docs`` in a struct, so that no name clashes."""
    out = docs.select(F.struct("*").alias("row"), measures(F.col(text)).alias("m"))
    counts = {c: F.col(f"m.{at}") for c, at in _PLACES.items()}
    base = (counts["n_words"] < BASE_MIN_WORDS) | (100 * counts["n_repeat_words"] > BASE_MAX_REPEAT_PERCENT * counts["n_words"])
    out = out.select("row", F.struct(*(v.alias(c) for c, v in counts.items())).alias("counts"), base.alias("base_failed"), failed(counts, rules).alias("failed_rules"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def judge(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row the columns ``keep``, the counts, ``base_failed``, ``failed_rules`` and ``kept``."""
    return _judged(docs, text, rules).select(*(F.col("row")[c].alias(c) for c in keep), "counts.*", "base_failed", "failed_rules", "kept")


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that every rule accepts, with their own columns only."""
    return _judged(docs, text, rules).filter("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def oracle(source: str = "documents") -> str:
    """The same rows in DuckDB's SQL, from the columns of ``source``."""
    kinds = METRICS
    broken = ", ".join(f"CASE WHEN NOT (1000 * {kinds[r.metric][0]} {r.op} {r.threshold} * {kinds[r.metric][1]}) THEN '{r.name}' END" for r in RULES)
    stop = ", ".join(f"'{w}'" for w in STOP)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM {source}),
a AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g') <> '') AS lines FROM t),
b AS (
  SELECT doc_id, words,
    len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(list_filter(words, lambda w: rtrim(lower(w), '.,') IN ({stop})))::BIGINT AS n_stop,
    len(list_filter(words, lambda w: ends_with(w, '!!')))::BIGINT AS n_shout,
    coalesce(list_sum(list_transform(list_zip(words[:-2], words[2:]), lambda p: (p[1] = p[2])::INT)), 0)::BIGINT AS n_stutter
  FROM a),
k AS (SELECT row_number() OVER () AS k, * FROM b),
win AS (SELECT k, unnest(range(1, n_words - {WINDOW - 2})) AS i, words FROM k WHERE n_words >= {WINDOW}),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS n FROM win) WHERE n > 1),
cov AS (SELECT k, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM rep) GROUP BY k),
c AS (SELECT k.*, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM k LEFT JOIN cov USING (k)),
d AS (SELECT *, (n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_MAX_REPEAT_PERCENT} * n_words) AS base_failed, concat_ws(',', {broken}) AS failed_rules FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND failed_rules = '') AS kept, failed_rules FROM d"""


QUERIES = {"op1_quality_rules": query}
SQL = {"op1_quality_rules": oracle()}
