"""Queries of the statistics and claim operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotlattice.functions.expr import erfc_sql, hash_number_sql, r6, r12
from spotlattice.operators import claims as C
from spotlattice.operators import stats as S
from spotlattice.plans.views import view, with_views

#: Resamples of the intervals of medians and of differences of medians.
ROUNDS, DIFF_ROUNDS = 5000, 1000
METRICS = ("coherence", "marker")
_LONG = "pl AS (SELECT method_id, sample_id, K, unnest(['coherence', 'marker']) AS metric, unnest([coherence, marker]) AS v FROM v_paired)"
DELTA_SQL = f"""{_LONG}, deltas AS (SELECT b.method_id AS baseline, a.metric, b.method_id || '|' || a.metric AS g, a.sample_id, avg(a.v - b.v) AS delta
  FROM pl a JOIN pl b ON a.sample_id = b.sample_id AND a.K = b.K AND a.metric = b.metric AND a.method_id = 'focal' AND b.method_id <> 'focal' GROUP BY 1, 2, 3, 4)"""


def _deltas(spark, d):
    return C.paired_delta(view(spark, d, "paired"), "focal", C.families_table(spark), METRICS)


def paired_delta(spark, d):
    return _deltas(spark, d).withColumn("delta", r12(F.col("delta")))


def _rank_sql(keys: str, rows: str) -> str:
    by = f"PARTITION BY {keys}" if keys else ""
    return f"SELECT *, rank() OVER ({by} ORDER BY m) + (count(*) OVER (PARTITION BY {keys + ', ' if keys else ''}m) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY {keys + ', ' if keys else ''}m) AS t FROM ({rows})"


def _wilcoxon_sql(rows: str, greater: bool) -> str:
    """From rows (g, d): g, n, v, z, p."""
    ranked = _rank_sql("g", f"SELECT g, d, abs(d) AS m FROM (SELECT g, round(d, 12) AS d FROM ({rows})) WHERE d <> 0")
    shift = "0.5::DOUBLE" if greater else "sign(v - n * (n + 1) / 4) * 0.5::DOUBLE"
    tail = f"CASE WHEN z >= 0 THEN {erfc_sql('a')} / 2 ELSE 1 - {erfc_sql('a')} / 2 END" if greater else f"least(1.0::DOUBLE, {erfc_sql('a')})"
    return f"""SELECT g, n::BIGINT AS n, v, z, {tail} AS p FROM (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS a FROM (
      SELECT g, n, v, (v - n * (n + 1) / 4 - {shift}) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48.0::DOUBLE) AS z FROM (
        SELECT g, count(*)::DOUBLE AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS v, sum(t * t - 1)::DOUBLE AS tie FROM ({ranked}) GROUP BY g)))"""


def wilcoxon_paired(spark, d):
    return S.wilcoxon(_deltas(spark, d), C.COMPARISON).select("baseline", "metric", "n", r6(F.col("v")).alias("v"), r6(F.col("z")).alias("z"), r6(F.col("p")).alias("p"))


def wilcoxon_greater(spark, d):
    units = view(spark, d, "paired").filter("method_id = 'focal'").withColumn("sample_group", F.col("K"))
    return S.wilcoxon(units, ("sample_group",), "coherence", "greater", 0.4).select(F.col("sample_group").alias("K"), "n", r6(F.col("v")).alias("v"), r6(F.col("z")).alias("z"), r6(F.col("p")).alias("p"))


def mann_whitney(spark, d):
    rows = view(spark, d, "spots").select("sample_id", (F.col("segment") == "BUILDING").alias("inside"), F.floor(F.col("x") / 500).alias("v"))
    return S.mann_whitney(rows, ("sample_id",), "inside", "v").select("sample_id", "n1", "n2", r6(F.col("u")).alias("u"), r6(F.col("z")).alias("z"), r6(F.col("p")).alias("p"))


MANN_SQL = with_views(
    f"""SELECT g AS sample_id, n1::BIGINT AS n1, n2::BIGINT AS n2, round(u, 6) AS u, round(z, 6) AS z, round(least(1.0::DOUBLE, {erfc_sql('a')}), 6) AS p FROM (
  SELECT *, z / sqrt(2.0::DOUBLE) AS a FROM (
  SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5::DOUBLE) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - tie / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM (
  SELECT g, n1, n2, tie, r1 - n1 * (n1 + 1) / 2 AS u FROM (
  SELECT g, count(*) FILTER (b)::DOUBLE AS n1, count(*) FILTER (NOT b)::DOUBLE AS n2, coalesce(sum(r) FILTER (b), 0)::DOUBLE AS r1, sum(t * t - 1)::DOUBLE AS tie
  FROM ({_rank_sql('g', "SELECT sample_id AS g, segment = 'BUILDING' AS b, floor(x / 500) AS m FROM v_spots")}) GROUP BY g))))""",
    "spots",
)


def bh_fdr(spark, d):
    rows = view(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment", ((F.col("c_custkey") * 37 % 1009) / 1009.0).alias("p"))
    return S.bh_fdr(rows, ("c_mktsegment",), "p", "id").select("c_mktsegment", "id", r6(F.col("p")).alias("p"), r6(F.col("q")).alias("q"))


BH_SQL = """WITH r AS (SELECT c_mktsegment, c_custkey AS id, (c_custkey * 37 % 1009) / 1009.0::DOUBLE AS p FROM customer),
k AS (SELECT *, p * count(*) OVER (PARTITION BY c_mktsegment) / row_number() OVER (PARTITION BY c_mktsegment ORDER BY p, id) AS raw FROM r)
SELECT c_mktsegment, id, round(p, 6) AS p, round(least(1.0::DOUBLE, min(raw) OVER (PARTITION BY c_mktsegment ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM k"""


def _draw_sql(rows: str, rounds: int) -> str:
    """From rows (g, x, o): (g, b, x) drawn by hash."""
    return f"""ix AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY x, o) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM ({rows})),
dr AS (SELECT g, b, {hash_number_sql("'11|' || b || '|' || i")} % n AS i FROM ix, (SELECT unnest(range(0, {rounds})) AS b)),
boot AS (SELECT g, b, x FROM dr JOIN ix USING (g, i))"""


def bootstrap_ci(spark, d):
    return S.bootstrap_ci(_deltas(spark, d), C.COMPARISON, "delta", "sample_id", ROUNDS).select("baseline", "metric", "n", *(r12(F.col(c)).alias(c) for c in ("median", "ci_low", "ci_high")))


BOOT_SQL = with_views(
    f"""WITH {DELTA_SQL}, {_draw_sql("SELECT g, delta AS x, sample_id AS o FROM deltas", ROUNDS)},
m AS (SELECT g, b, quantile_cont(x, 0.5) AS m FROM boot GROUP BY g, b)
SELECT baseline, metric, n, round(median, 12) AS median, round(ci_low, 12) AS ci_low, round(ci_high, 12) AS ci_high FROM (SELECT baseline, metric, g, count(*) AS n, quantile_cont(delta, 0.5) AS median FROM deltas GROUP BY ALL)
LEFT JOIN (SELECT g, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM m WHERE g IN (SELECT g FROM ix WHERE n > 1) GROUP BY g) USING (g)""",
    "paired",
)


def bootstrap_median_diff(spark, d):
    rows = view(spark, d, "spots").select("sample_id", (F.col("segment") == "BUILDING").alias("inside"), "x", "spot")
    return S.bootstrap_median_diff(rows, ("sample_id",), "inside", "x", "spot", DIFF_ROUNDS).select("sample_id", r6(F.col("ci_low")).alias("ci_low"), r6(F.col("ci_high")).alias("ci_high"))


DIFF_SQL = with_views(
    f"""WITH {_draw_sql("SELECT {'s': sample_id, 'b': segment = 'BUILDING'} AS g, x, spot AS o FROM v_spots", DIFF_ROUNDS)},
m AS (SELECT g.s AS s, b, quantile_cont(x, 0.5) FILTER (g.b) - quantile_cont(x, 0.5) FILTER (NOT g.b) AS m FROM boot GROUP BY g.s, b)
SELECT s AS sample_id, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM m GROUP BY s""",
    "spots",
)


def direction_coverage(spark, d):
    targets = view(spark, d, "paired").filter("method_id = 'focal'").agg(F.countDistinct("sample_id").alias("n_target"))
    return C.direction_coverage(_deltas(spark, d), targets).select("baseline", "metric", "n_samples", "n_target", r6(F.col("direction_consistency")).alias("direction_consistency"), r6(F.col("coverage")).alias("coverage"))


# Differences of two-decimal balances over 10,000 and their quantiles end in at most ten decimals, often in a five at the
# seventh: they are rounded where no such value is halfway. Other numbers are rounded to six places.
EXACT = ("effect_median", "ci_low", "ci_high")
_C1_COLUMNS = ("effect_median", "ci_low", "ci_high", "statistic", "p_value", "q_value", "direction_consistency", "coverage")


def _places(c):
    return 12 if c in EXACT else 6


def _rounded(c):
    return F.round(c, _places(c))


def _c1(spark, d):
    return C.gate_c1(view(spark, d, "paired"), "focal", C.families_table(spark), METRICS, ROUNDS)


def gate_c1(spark, d):
    """All six baselines on both metrics, corrected within each family."""
    gates = ("gate_significance", "gate_effect", "gate_direction", "gate_coverage", "gate_overall")
    return _c1(spark, d).select("baseline", "metric", "family", "n_samples", "n_target", *(_rounded(c).alias(c) for c in _C1_COLUMNS), *gates, "tier", "decision")


def _gate_sql(families: str, metrics: str, rounds: int) -> str:
    """From ``deltas`` (baseline, metric, g, sample_id, delta) and n_target in ``tg``: the comparisons with their gates, as ``c1``."""
    return f"""fam AS (SELECT baseline, family, metric, baseline || '|' || metric AS g FROM (VALUES {families}) AS v(baseline, family), (SELECT unnest({metrics}) AS metric)),
w AS ({_wilcoxon_sql("SELECT g, delta AS d FROM deltas", False)}),
{_draw_sql("SELECT g, delta AS x, sample_id AS o FROM deltas", rounds)},
mb AS (SELECT g, b, quantile_cont(x, 0.5) AS m FROM boot GROUP BY g, b),
ci AS (SELECT g, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM mb WHERE g IN (SELECT g FROM ix WHERE n > 1) GROUP BY g),
dc AS (SELECT g, count(*) AS n_samples, avg((delta > 0)::INT) AS direction_consistency, quantile_cont(delta, 0.5) AS effect_median FROM deltas GROUP BY 1),
qq AS (SELECT g, least(1.0::DOUBLE, min(raw) OVER (PARTITION BY family ORDER BY p, g ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM (
  SELECT fam.g, family, p, p * count(*) OVER (PARTITION BY family) / row_number() OVER (PARTITION BY family ORDER BY p, fam.g) AS raw FROM fam JOIN w ON fam.g = w.g WHERE p IS NOT NULL)),
s AS (SELECT baseline, metric, family, n_samples, CASE WHEN n_samples IS NULL THEN NULL ELSE n_target END AS n_target, effect_median, ci_low, ci_high, v AS statistic, p AS p_value, q AS q_value, direction_consistency, n_samples / n_target AS coverage
  FROM fam LEFT JOIN dc USING (g) LEFT JOIN w USING (g) LEFT JOIN ci USING (g) LEFT JOIN qq USING (g) CROSS JOIN tg),
gt AS (SELECT *, coalesce(q_value < 0.05, false) AS gate_significance, coalesce(effect_median >= 0.02, false) AS gate_effect, coalesce(direction_consistency >= 0.7, false) AS gate_direction, coalesce(coverage >= 0.8, false) AS gate_coverage FROM s),
c1 AS (SELECT *, gate_significance AND gate_effect AND gate_direction AND gate_coverage AS gate_overall,
  CASE WHEN gate_significance AND gate_effect AND gate_direction AND gate_coverage THEN 'supported' WHEN gate_effect AND gate_direction THEN 'suggestive' ELSE 'not supported' END AS tier FROM gt)"""


_TARGET = "tg AS (SELECT count(DISTINCT sample_id) AS n_target FROM v_paired WHERE method_id = 'focal')"
_C1_BODY = f"{DELTA_SQL}, {_TARGET}, " + _gate_sql(", ".join(f"('{b}', '{f}')" for b, f in C.FAMILIES.items()), "['coherence', 'marker']", ROUNDS)
_C1_SELECT = f"""SELECT baseline, metric, family, n_samples, n_target, {", ".join(f"round({c}, {_places(c)}) AS {c}" for c in _C1_COLUMNS)},
gate_significance, gate_effect, gate_direction, gate_coverage, gate_overall, tier, CASE WHEN gate_overall THEN 'pass' ELSE 'fail' END AS decision FROM c1"""
C1_SQL = with_views(f"WITH {_C1_BODY} {_C1_SELECT}", "paired")


def gate_families(spark, d):
    return _c1(spark, d).groupBy("family").agg(F.count(F.lit(1)).alias("n_comparisons"), r6(F.min("q_value")).alias("least_q"), F.sum(F.col("gate_overall").cast("bigint")).alias("n_pass"))


FAM_SQL = with_views(f"WITH {_C1_BODY} SELECT family, count(*) AS n_comparisons, round(min(q_value), 6) AS least_q, sum(gate_overall::INT)::BIGINT AS n_pass FROM c1 GROUP BY family", "paired")
_C2_SQL = f"""c2w AS ({_wilcoxon_sql("SELECT 1 AS g, coherence - 0.6::DOUBLE AS d FROM v_paired WHERE method_id = 'focal'", True)}),
c2 AS (SELECT *, coalesce(effect_median >= 0.6 AND share >= 0.7 AND iqr_share >= 0.8 AND p_value < 0.1, false) AS gate_overall FROM (
  SELECT count(*) AS n_samples, quantile_cont(coherence, 0.5) AS effect_median, avg((coherence >= 0.6::DOUBLE)::INT) AS share, avg((coherence / 2 <= 0.15::DOUBLE)::INT) AS iqr_share FROM v_paired WHERE method_id = 'focal'), (SELECT p AS p_value FROM c2w))"""


def _c2(spark, d):
    units = view(spark, d, "paired").filter("method_id = 'focal'").withColumn("half", F.col("coherence") / 2)
    return C.gate_c2(units, "coherence", "half")


def gate_c2(spark, d):
    return _c2(spark, d).select("n_samples", *(r6(F.col(c)).alias(c) for c in ("effect_median", "share", "iqr_share", "p_value")), "gate_overall")


def _c3(spark, d):
    return C.gate_c3(view(spark, d, "ledger").filter("method_id = 'purchase'"))


def gate_c3(spark, d):
    return _c3(spark, d).select("n_samples", *(r6(F.col(c)).alias(c) for c in ("effect_median", "share", "failure_free")), "gate_overall", "tier")


_C3_SQL = """c3 AS (SELECT *, coalesce(share >= 0.8 AND failure_free >= 1.0, false) AS gate_overall, CASE WHEN coalesce(share >= 0.8 AND failure_free >= 1.0, false) THEN 'suggestive' ELSE 'not supported' END AS tier FROM (
  SELECT count(*) AS n_samples, quantile_cont(sec, 0.5) AS effect_median, avg((sec <= 1800)::INT) AS share, avg((failed = 0)::INT) AS failure_free FROM (
    SELECT dataset_id, sample_id, K, quantile_cont(wall_time_sec, 0.5) FILTER (status = 'success') AS sec, avg((status <> 'success')::INT) AS failed FROM v_ledger WHERE method_id = 'purchase' GROUP BY 1, 2, 3)))"""


def gate_c4(spark, d):
    """External anchor: the same paired statistics on another metric, focal against M5 only."""
    one = C.families_table(spark).filter("baseline = 'M5'")
    units = view(spark, d, "paired").withColumn("edge", F.col("coherence") * F.col("coherence"))
    return C.gate_c1(units, "focal", one, "edge", ROUNDS).select("baseline", "n_samples", *(_rounded(c).alias(c) for c in ("effect_median", "ci_low", "ci_high", "p_value", "direction_consistency")))


_C4_BODY = f"""deltas AS (SELECT b.method_id AS baseline, 'edge' AS metric, b.method_id || '|edge' AS g, a.sample_id, avg(a.coherence * a.coherence - b.coherence * b.coherence) AS delta
  FROM v_paired a JOIN v_paired b ON a.sample_id = b.sample_id AND a.K = b.K AND a.method_id = 'focal' AND b.method_id = 'M5' GROUP BY 1, 2, 3, 4), {_TARGET}, """ + _gate_sql("('M5', 'F1')", "['edge']", ROUNDS)
C4_SQL = with_views(
    f"""WITH {_C4_BODY} SELECT baseline, n_samples, round(effect_median, 12) AS effect_median, round(ci_low, 12) AS ci_low, round(ci_high, 12) AS ci_high, round(p_value, 6) AS p_value, round(direction_consistency, 6) AS direction_consistency FROM c1""",
    "paired",
)


def claims(spark, d):
    c1 = _c1(spark, d).withColumn("comparison", F.concat(F.lit("focal_vs_"), F.col("baseline")))
    parts = {"C1": c1, "C2": _c2(spark, d).withColumn("metric", F.lit("stability")), "C3": _c3(spark, d).withColumn("metric", F.lit("runtime"))}
    out = C.assemble(parts)
    doubles = {c for c, k in out.dtypes if k == "double"}
    return out.select(*(_rounded(c).alias(c) if c in doubles else F.col(c) for c in C.CLAIM_COLUMNS))


_FILL = {"claim_id", "family", "comparison", "metric", "tier", "decision", "notes"}


def _claim_row(source: str, have: dict[str, str]) -> str:
    kind = lambda c: "VARCHAR" if c in _FILL else "BOOLEAN" if c.startswith("gate_") else "BIGINT" if c in ("n_samples", "n_target") else "DOUBLE"
    return "SELECT " + ", ".join(f"({have.get(c, 'NULL')})::{kind(c)} AS {c}" for c in C.CLAIM_COLUMNS) + f" FROM {source}"


_NUM = {c: f"round({c}, {_places(c)})" for c in _C1_COLUMNS}
CLAIM_SQL = with_views(
    f"WITH {_C1_BODY}, {_C2_SQL}, {_C3_SQL} "
    + _claim_row("c1", {"claim_id": "'C1'", "comparison": "'focal_vs_' || baseline", "metric": "metric", "family": "family", "n_samples": "n_samples", "n_target": "n_target", **_NUM, **{g: g for g in ("gate_significance", "gate_effect", "gate_direction", "gate_coverage", "gate_overall", "tier")}, "decision": "CASE WHEN gate_overall THEN 'pass' ELSE 'fail' END"})
    + " UNION ALL "
    + _claim_row("c2", {"claim_id": "'C2'", "metric": "'stability'", "n_samples": "n_samples", **{c: f"round({c}, {_places(c)})" for c in ("effect_median", "share", "iqr_share", "p_value")}, "gate_overall": "gate_overall"})
    + " UNION ALL "
    + _claim_row("c3", {"claim_id": "'C3'", "metric": "'runtime'", "n_samples": "n_samples", **{c: f"round({c}, {_places(c)})" for c in ("effect_median", "share")}, "gate_overall": "gate_overall", "tier": "tier"}),
    "paired", "ledger",
)

QUERIES = {
    "paired_delta": paired_delta, "wilcoxon_paired": wilcoxon_paired, "wilcoxon_greater": wilcoxon_greater, "mann_whitney": mann_whitney, "bh_fdr": bh_fdr,
    "bootstrap_ci": bootstrap_ci, "bootstrap_median_diff": bootstrap_median_diff, "direction_coverage": direction_coverage, "gate_c1": gate_c1,
    "gate_families": gate_families, "gate_c2": gate_c2, "gate_c3": gate_c3, "gate_c4": gate_c4, "claims": claims,
    # the names under which earlier versions registered the whole number of resamples
    "bootstrap_ci_whole": bootstrap_ci, "bootstrap_median_diff_whole": bootstrap_median_diff, "gate_c1_whole": gate_c1, "gate_c4_whole": gate_c4,
}
_W = "SELECT g AS {0}, n, round(v, 6) AS v, round(z, 6) AS z, round(p, 6) AS p FROM ({1})"
SQL = {
    "paired_delta": with_views(f"WITH {DELTA_SQL} SELECT baseline, metric, sample_id, round(delta, 12) AS delta FROM deltas", "paired"),
    "wilcoxon_paired": with_views(f"WITH {DELTA_SQL} " + "SELECT split_part(g, '|', 1) AS baseline, split_part(g, '|', 2) AS metric, n, round(v, 6) AS v, round(z, 6) AS z, round(p, 6) AS p FROM (" + _wilcoxon_sql("SELECT g, delta AS d FROM deltas", False) + ")", "paired"),
    "wilcoxon_greater": with_views(_W.format("K", _wilcoxon_sql("SELECT K AS g, coherence - 0.4::DOUBLE AS d FROM v_paired WHERE method_id = 'focal'", True)), "paired"),
    "mann_whitney": MANN_SQL,
    "bh_fdr": BH_SQL,
    "bootstrap_ci": BOOT_SQL,
    "bootstrap_median_diff": DIFF_SQL,
    "direction_coverage": with_views(f"WITH {DELTA_SQL} SELECT baseline, metric, count(*) AS n_samples, any_value(n_target) AS n_target, round(avg((delta > 0)::INT), 6) AS direction_consistency, round(count(*) / any_value(n_target), 6) AS coverage FROM deltas, (SELECT count(DISTINCT sample_id) AS n_target FROM v_paired WHERE method_id = 'focal') GROUP BY baseline, metric", "paired"),
    "gate_c1": C1_SQL,
    "gate_families": FAM_SQL,
    "gate_c2": with_views(f"WITH {_C2_SQL} SELECT n_samples, round(effect_median, 6) AS effect_median, round(share, 6) AS share, round(iqr_share, 6) AS iqr_share, round(p_value, 6) AS p_value, gate_overall FROM c2", "paired"),
    "gate_c3": with_views(f"WITH {_C3_SQL} SELECT n_samples, round(effect_median, 6) AS effect_median, round(share, 6) AS share, round(failure_free, 6) AS failure_free, gate_overall, tier FROM c3", "ledger"),
    "gate_c4": C4_SQL,
    "claims": CLAIM_SQL,
}
SQL |= {f"{name}_whole": SQL[name] for name in ("bootstrap_ci", "bootstrap_median_diff", "gate_c1", "gate_c4")}
