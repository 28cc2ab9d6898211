"""Paired statistics, gates and tiers of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlattice.operators.lineage import cut, tidy
from spotlattice.operators.stats import bh_fdr, bootstrap_ci, wilcoxon

# Thresholds of the gates.
GATES = {
    "c1": {"q": 0.05, "effect": 0.02, "direction": 0.70, "coverage": 0.80},
    "c2": {"level": 0.60, "median": 0.60, "share": 0.70, "iqr": 0.15, "iqr_share": 0.80, "p": 0.10},
    "c3": {"seconds": 1800.0, "share": 0.80, "failure_free": 1.00},
}
# The family in which each baseline is tested.
FAMILIES = {"M5": "F1", "M0": "F1_secondary", "M1": "F1_secondary", "M2": "F1_ext", "M3": "F1_ext2", "M4": "F1_ext3"}
# Columns of the claim table.
CLAIM_COLUMNS = (
    "claim_id", "family", "comparison", "metric", "n_samples", "n_target", "effect_median", "ci_low", "ci_high", "statistic", "p_value", "q_value",
    "direction_consistency", "coverage", "share", "iqr_share", "gate_significance", "gate_effect", "gate_direction", "gate_coverage", "gate_overall", "tier", "decision", "notes",
)


def gates_table(spark: SparkSession) -> DataFrame:
    rows = [(g, k, float(v)) for g, pairs in GATES.items() for k, v in pairs.items()]
    return spark.createDataFrame(rows, "gate string, name string, threshold double")


def families_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FAMILIES.items()), "baseline string, family string")


#: What makes a comparison: the baseline and the metric on which it is held against the focal method.
COMPARISON = ("baseline", "metric")


def _comparisons(families: DataFrame, metrics: str | tuple[str, ...]) -> DataFrame:
    """(baseline, family, metric): the families with their endpoints; all ``metrics`` where the table names none."""
    if "metric" in families.columns:
        return families
    names = (metrics,) if isinstance(metrics, str) else metrics
    return families.withColumn("metric", F.explode(F.array(*map(F.lit, names))))


def paired_delta(units: DataFrame, focal: str, baselines: DataFrame, metric: str | tuple[str, ...]) -> DataFrame:
    """(baseline, metric, sample_id, delta): focal minus baseline at the same sample and K, averaged over K."""
    names = (metric,) if isinstance(metric, str) else metric
    long = units.select("method_id", "sample_id", "K", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in names))).alias("m"))
    long = long.select("method_id", "sample_id", "K", "m.metric", "m.v").filter("v IS NOT NULL")
    a = long.filter(F.col("method_id") == focal).select("sample_id", "K", "metric", F.col("v").alias("_f"))
    b = long.join(baselines.select(F.col("baseline").alias("method_id")).distinct(), "method_id").select(F.col("method_id").alias("baseline"), "sample_id", "K", "metric", F.col("v").alias("_b"))
    return a.join(b, ["sample_id", "K", "metric"]).groupBy(*COMPARISON, "sample_id").agg(F.avg(F.col("_f") - F.col("_b")).alias("delta"))


def direction_coverage(deltas: DataFrame, targets: DataFrame) -> DataFrame:
    """Share of positive differences and of the target samples that have one; ``targets`` has one row, n_target."""
    g = deltas.groupBy(*COMPARISON).agg(F.count(F.lit(1)).alias("n_samples"), F.avg((F.col("delta") > 0).cast("double")).alias("direction_consistency"))
    return g.crossJoin(F.broadcast(targets)).withColumn("coverage", F.col("n_samples") / F.col("n_target"))


def gate_c1(units: DataFrame, focal: str, families: DataFrame, metric: str | tuple[str, ...], rounds: int = 5000, bars: dict | None = None) -> DataFrame:
    """One row per baseline and metric: test, q value, gates and tier; a comparison without overlap fails all.

    A family corrects over all of its comparisons, on every metric: with two
    metrics and one baseline it holds two tests, with two baselines four.
    """
    families = _comparisons(families, metric)
    names = tuple(sorted(r.metric for r in families.select("metric").distinct().collect()))  # a few names of columns
    return gate_deltas(paired_delta(units, focal, families, names), families, units.filter(F.col("method_id") == focal).agg(F.countDistinct("sample_id").alias("n_target")), rounds, bars)


@tidy
def gate_deltas(deltas: DataFrame, families: DataFrame, targets: DataFrame, rounds: int = 5000, bars: dict | None = None) -> DataFrame:
    """``gate_c1`` from differences ``(baseline, metric, sample_id, delta)`` and comparisons ``(baseline, family, metric)``."""
    bars, on = bars or GATES["c1"], list(COMPARISON)
    deltas = cut(deltas)  # read by three statistics
    test = wilcoxon(deltas, COMPARISON).select(*on, F.col("v").alias("statistic"), F.col("p").alias("p_value"))
    ci = bootstrap_ci(deltas, COMPARISON, "delta", "sample_id", rounds).select(*on, F.col("median").alias("effect_median"), "ci_low", "ci_high")
    stats = direction_coverage(deltas, targets).join(test, on, "left").join(ci, on, "left")
    # equal p values of a family get equal q values, so the order of ties is free
    q = bh_fdr(families.join(test, on).withColumn("_at", F.concat_ws("|", *on)), ("family",), "p_value", "_at").select(*on, F.col("q").alias("q_value"))
    out = families.join(stats, on, "left").join(q, on, "left")
    gates = {
        "gate_significance": F.col("q_value") < bars["q"],
        "gate_effect": F.col("effect_median") >= bars["effect"],
        "gate_direction": F.col("direction_consistency") >= bars["direction"],
        "gate_coverage": F.col("coverage") >= bars["coverage"],
    }
    out = out.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in gates.items()})
    out = out.withColumn("gate_overall", F.col("gate_significance") & F.col("gate_effect") & F.col("gate_direction") & F.col("gate_coverage"))
    tier = F.when(F.col("gate_overall"), "supported").when(F.col("gate_effect") & F.col("gate_direction"), "suggestive").otherwise("not supported")
    return out.withColumns({"tier": tier, "decision": F.when(F.col("gate_overall"), "pass").otherwise("fail")})


def gate_c2(units: DataFrame, score: str, spread: str, bars: dict | None = None) -> DataFrame:
    """Stability over units: test against a level, median, and the shares above the level and within the spread."""
    bars = bars or GATES["c2"]
    rows = units.filter(F.col(score).isNotNull()).withColumn("_all", F.lit(1))
    g = rows.groupBy("_all").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.percentile(score, 0.5).alias("effect_median"),
        F.avg((F.col(score) >= bars["level"]).cast("double")).alias("share"),
        F.avg((F.col(spread) <= bars["iqr"]).cast("double")).alias("iqr_share"),
    )
    test = wilcoxon(rows, ("_all",), score, "greater", bars["level"]).select("_all", F.col("p").alias("p_value"))
    out = g.join(test, "_all", "left").drop("_all")
    ok = (F.col("effect_median") >= bars["median"]) & (F.col("share") >= bars["share"]) & (F.col("iqr_share") >= bars["iqr_share"]) & (F.col("p_value") < bars["p"])
    return out.withColumn("gate_overall", F.coalesce(ok, F.lit(False)))


def gate_c3(runs: DataFrame, bars: dict | None = None) -> DataFrame:
    """Run time over units, descriptive: the best tier is suggestive."""
    bars = bars or GATES["c3"]
    unit = runs.groupBy("dataset_id", "sample_id", "K").agg(F.percentile(F.when(F.col("status") == "success", F.col("wall_time_sec")), 0.5).alias("sec"), F.avg((F.col("status") != "success").cast("double")).alias("failed"))
    g = unit.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.percentile("sec", 0.5).alias("effect_median"),
        F.avg((F.col("sec") <= bars["seconds"]).cast("double")).alias("share"),
        F.avg((F.col("failed") == 0).cast("double")).alias("failure_free"),
    )
    ok = (F.col("share") >= bars["share"]) & (F.col("failure_free") >= bars["failure_free"])
    return g.withColumn("gate_overall", F.coalesce(ok, F.lit(False))).withColumn("tier", F.when(F.col("gate_overall"), "suggestive").otherwise("not supported"))


def assemble(parts: dict[str, DataFrame]) -> DataFrame:
    """The claim table: rows of all gates under its fixed columns, what a gate does not have is null."""
    texts = {"claim_id", "family", "comparison", "metric", "tier", "decision", "notes"}
    flags = {c for c in CLAIM_COLUMNS if c.startswith("gate_")}
    kinds = {c: "string" if c in texts else "boolean" if c in flags else "bigint" if c in ("n_samples", "n_target") else "double" for c in CLAIM_COLUMNS}
    out = None
    for claim, df in parts.items():
        df = df.withColumn("claim_id", F.lit(claim))
        row = df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in CLAIM_COLUMNS))
        out = row if out is None else out.unionByName(row)
    return out
