"""Operator 5, URL filters: pattern rules fetched by their rarest literal token.

A rule is a host and path pattern. Its literal tokens are the runs of
``[a-z0-9]`` that a fitting URL must hold as whole tokens. One count over all
URLs finds how often each of the rules' tokens occurs; every rule is filed under
its rarest one. The index is a constant map ``token -> rules`` inside the
projection: the tokens of a URL fetch candidate rules from it, and only those run
their regular expression. No row moves, so a hot host costs nothing extra.

The default rules name a few public networks and kinds of sites by their words, no host of any
table; a user gives rules of their own as an argument or as a table.

Up to ``MAX_RULES`` rules go into the projection. More of them, or rules that come as a
table, are joined instead (``judge_by_table``): each distinct URL meets the rules filed
under its tokens in an equi join, and the longest that fits comes back to the pages.

Defined cases: null URLs and URLs without ``://`` have empty host and path, fit
no rule and are allowed; very long URLs are read whole; of fitting rules of one length the
greater text wins, of equal rules the one that blocks; repeated rows are judged alike; an
empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlattice.llm.common import table

MAX_RULES = 10_000


class Rule(NamedTuple):
    """``host`` fits itself and all subdomains, ``path`` is a prefix of the URL's path.

    A ``*`` in the host stands for any run of characters between its dots. Only
    base rules are reported in the column ``rule``.
    """

    host: str
    path: str
    verdict: str
    base: bool = True

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        host = "[^/.]*".join(re.escape(x) for x in self.host.split("*"))
        return rf"^([^/]*\.)?{host}" + (re.escape(self.path) if self.path else "(/|$)")

    @property
    def tokens(self) -> list[str]:
        """Runs that are whole tokens of every URL the rule fits: not next to ``*``, not cut off at the end of the path."""
        inside = self.host + (self.path or "/")
        return [m.group() for m in re.finditer(r"[a-z0-9]+", inside) if inside[m.end() : m.end() + 1] not in ("", "*") and inside[max(m.start() - 1, 0)] != "*"]


# The contract's rules.
BASE_RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)

# Sites of advertising and tracking networks, and words that name a kind of unwanted site in its host.
SITES = ("doubleclick.net", "googlesyndication.com", "googleadservices.com", "google-analytics.com", "scorecardresearch.com", "adnxs.com", "taboola.com", "outbrain.com", "criteo.*.*")
WORDS = ("ads", "adserver", "adult", "bets", "betting", "casino", "pills", "poker", "porn", "spam", "torrent", "tracker", "viagra", "warez", "xxx")
# A word is a label of the host, or stands at the start or the end of a label with a hyphen; the label is the last or the last but one before the end.
SITE_RULES = tuple(Rule(site, "", "block", False) for site in SITES) + tuple(
    Rule(f"{label}{end}", "", "block", False) for w in WORDS for label in (w, f"{w}-*", f"*-{w}") for end in (".*", ".*.*")
)
RULES = BASE_RULES + SITE_RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(target: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(target, "[^a-z0-9]+"), ""))


def rarest(targets: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """Each rule under the one of its tokens that occurs in the fewest URLs of ``targets(target)``.

    One pass; what comes back is one row per token of the rules at most.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    counts = dict(
        targets.select(F.explode(F.array_intersect(tokens_of(F.col("target")), F.array(*map(F.lit, wanted)))).alias("token"))
        .groupBy("token")
        .count()
        .collect()
    )
    index: dict[str, list[Rule]] = {}
    for r in rules:
        if not r.tokens:
            raise ValueError(f"rule {r.text!r} has no whole literal token")
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(r)
    return index


def judge(pages: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), rules: tuple[Rule, ...] = RULES, default: str = "allow") -> DataFrame:
    """Per row the columns ``keep`` with host, path, rule, verdict and the site pattern that decided, if any.

    The longest fitting base rule wins; without one the longest fitting site
    pattern does; without that the verdict is ``default``.
    """
    if len(rules) > MAX_RULES:
        return judge_by_table(pages, pages.sparkSession.createDataFrame(rules, "host string, path string, verdict string, base boolean"), url, keep, default)
    out = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    index = rarest(out.select(F.concat("host", "path").alias("target")), rules)
    entries = []
    for token, filed in sorted(index.items()):
        structs = [F.struct(F.lit(r.base).alias("base"), F.lit(len(r.text)).alias("n"), F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex")) for r in filed]
        entries += [F.lit(token), F.array(*structs)]
    lookup = F.create_map(*entries)
    known = F.array(*(F.lit(t) for t in sorted(index)))
    target = F.concat("host", "path")
    candidates = F.flatten(F.transform(F.array_intersect(tokens_of(target), known), lambda t: F.element_at(lookup, t)))
    # struct order decides: base rules before patterns, then length, then text
    best = F.array_max(F.filter(candidates, lambda r: F.rlike(target, r["regex"])))
    out = out.withColumn("_best", best)
    return out.select(
        *keep,
        "host",
        "path",
        F.when(F.col("_best.base"), F.col("_best.text")).alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
        F.when(~F.col("_best.base"), F.col("_best.text")).alias("pattern"),
    )


def judge_by_table(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """``judge`` for any number of rules ``(host, path, verdict, base)``; the rows of the pages meet one row a URL."""
    inside = F.concat("host", F.when(F.col("path") == "", "/").otherwise(F.col("path")))
    escape = lambda c: F.regexp_replace(c, r"([^A-Za-z0-9*])", r"\\$1")
    regex = F.concat(F.lit(r"^([^/]*\.)?"), F.replace(escape(F.col("host")), F.lit("*"), F.lit("[^/.]*")), F.when(F.col("path") == "", "(/|$)").otherwise(F.replace(escape(F.col("path")), F.lit("*"), F.lit("\\*"))))
    text = F.concat("host", "path")
    # whole tokens: not next to a star, not cut off at the end of the path
    filed = rules.distinct().select("base", F.length(text).alias("n"), text.alias("text"), "verdict", regex.alias("regex"), F.explode(F.array_distinct(F.regexp_extract_all(inside, F.lit(r"(?<![a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])"), F.lit(1)))).alias("token"))
    out = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    targets = out.select("host", "path").distinct()
    tokens = targets.select("host", "path", F.explode(tokens_of(F.concat("host", "path"))).alias("token"))
    counts = tokens.join(filed.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rule = ("base", "n", "text", "verdict", "regex")
    rarest_ = filed.join(counts, "token", "left").groupBy(*rule).agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    fits = tokens.join(rarest_, "token").filter(F.rlike(F.concat("host", "path"), F.col("regex")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(*rule)).alias("best"))
    out = out.join(best, ["host", "path"], "left")
    return out.select(
        *keep,
        "host",
        "path",
        F.when(F.col("best.base"), F.col("best.text")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.when(~F.col("best.base"), F.col("best.text")).alias("pattern"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def oracle() -> str:
    rules = ", ".join(f"({r.base}, {len(r.text)}, '{r.text}', '{r.verdict}', '{r.regex}')" for r in RULES)
    return f"""
WITH rules(base, n, text, verdict, regex) AS (VALUES {rules}),
p AS (SELECT row_number() OVER () AS k, page_id,
  translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
best AS (SELECT k, max({{'base': base, 'n': n, 'text': text, 'verdict': verdict}}) AS b FROM p JOIN rules ON regexp_matches(host || path, regex) GROUP BY k)
SELECT page_id, host, path, CASE WHEN b.base THEN b.text END AS rule, coalesce(b.verdict, 'allow') AS verdict, CASE WHEN NOT b.base THEN b.text END AS pattern
FROM p LEFT JOIN best USING (k)"""


QUERIES = {"op5_url_filters": query}
SQL = {"op5_url_filters": oracle()}
