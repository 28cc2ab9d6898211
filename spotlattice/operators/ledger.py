"""Aggregation of the run ledger: locking, deltas, medians, sensitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = ("dataset_id", "sample_id", "method_id", "K")


def median(c: str | Column) -> Column:
    return F.percentile(c, 0.5)


def is_locked(notes: Column) -> Column:
    """Rows of the rigor and replication runs."""
    return notes.rlike("^rigor-backfill") | notes.rlike("^stage3[a-z]-full-replication")


def filter_locked(ledger: DataFrame) -> DataFrame:
    return ledger.filter(is_locked(F.col("notes")))


def lock_rows(ledger: DataFrame, keys: tuple[str, ...] = UNIT) -> DataFrame:
    """Per unit the row with most seeds, the later one on a tie."""
    w = Window.partitionBy(*keys).orderBy(F.desc("seed_count"), F.desc("ingest_seq"))
    return filter_locked(ledger).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def quality_deltas(locked: DataFrame, focal: str, metrics: tuple[str, ...]) -> DataFrame:
    """Focal minus every other method in the same dataset, sample and K; rows with a missing metric go."""
    on = ["dataset_id", "sample_id", "K"]
    a = locked.filter(F.col("method_id") == focal).select(*on, *(F.col(m).alias(f"_{m}") for m in metrics))
    b = locked.filter(F.col("method_id") != focal).select(*on, F.col("method_id").alias("baseline"), *metrics)
    out = a.join(b, on).select(*on, "baseline", *((F.col(f"_{m}") - F.col(m)).alias(f"delta_{m}") for m in metrics))
    return out.dropna(subset=[f"delta_{m}" for m in metrics])


def dataset_medians(locked: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Medians per dataset, method and K with the number of distinct samples."""
    return locked.groupBy("dataset_id", "method_id", "K").agg(F.countDistinct("sample_id").alias("n_samples"), *(median(m).alias(f"median_{m}") for m in metrics))


def coverage(declared: DataFrame, locked: DataFrame, focal: str) -> DataFrame:
    """Per declared dataset: benchmarked samples, methods, and what the focal method covers."""
    seen = locked.groupBy("dataset_id").agg(
        F.countDistinct("sample_id").alias("n_benchmarked"),
        F.array_join(F.array_sort(F.collect_set("method_id")), ",").alias("methods"),
        F.countDistinct(F.when(F.col("method_id") == focal, F.col("sample_id"))).alias("n_focal"),
        F.count(F.when(F.col("method_id") == focal, 1)).alias("focal_rows"),
    )
    out = declared.join(seen, "dataset_id", "left").fillna({"n_benchmarked": 0, "methods": "", "n_focal": 0, "focal_rows": 0})
    return out.withColumn("focal_coverage", F.try_divide("n_focal", "n_declared"))


def spread(runs: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Per unit the median, range and quartile distance over configurations, then medians over units."""
    long = runs.unpivot(["dataset_id", "sample_id", "method_id", "K"], list(metrics), "metric", "value").filter("value IS NOT NULL")
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    unit = long.groupBy("dataset_id", "sample_id", "method_id", "K", "metric").agg(q.alias("q"), (F.max("value") - F.min("value")).alias("range"))
    return unit.groupBy("method_id", "K", "metric").agg(
        F.count(F.lit(1)).alias("n_units"),
        median(F.col("q")[1]).alias("median"),
        median("range").alias("range"),
        median(F.col("q")[2] - F.col("q")[0]).alias("iqr"),
    )


def last_of(rows: DataFrame, keys: tuple[str, ...], order: str = "ingest_seq") -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def depth_sensitivity(deep: DataFrame, shallow: DataFrame, reference: DataFrame) -> DataFrame:
    """Deep against shallow runs: differences, time ratio (null over zero) and the distance to a reference method."""
    on = ["dataset_id", "sample_id", "K"]
    pick = lambda df, p: df.select(*on, F.col("coherence").alias(f"{p}_coherence"), F.col("wall_time_sec").alias(f"{p}_sec"))
    out = pick(last_of(deep, (*on,)), "deep").join(pick(last_of(shallow, (*on,)), "shallow"), on).join(pick(last_of(reference, (*on,)), "ref"), on, "left")
    return out.select(
        *on,
        (F.col("deep_coherence") - F.col("shallow_coherence")).alias("delta_depth"),
        (F.col("deep_coherence") - F.col("ref_coherence")).alias("delta_reference"),
        F.when(F.col("shallow_sec") != 0, F.try_divide("deep_sec", "shallow_sec")).alias("time_ratio"),
    )


def relative_to_group(rows: DataFrame, metric: str, keys: tuple[str, ...]) -> DataFrame:
    """Absolute value over the median of absolute values in the group."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("abs_value", F.abs(F.col(metric))).withColumn("relative", F.try_divide("abs_value", F.percentile("abs_value", 0.5).over(w)))


def runtime_unit(ledger: DataFrame) -> DataFrame:
    ok = (F.col("status") == "success") & F.col("wall_time_sec").isNotNull() & ~F.isnan("wall_time_sec")
    return ledger.filter(ok).groupBy("method_id", "dataset_id", "sample_id", "K").agg(median("wall_time_sec").alias("runtime"))


def runtime_groups(primary: DataFrame, rest: DataFrame, names: dict[str, str]) -> DataFrame:
    """Primary runs, and the others that no primary run covers, under display names; finite values only."""
    on = ["dataset_id", "sample_id", "method_id", "K"]
    both = primary.withColumn("group", F.lit("primary")).unionByName(rest.join(primary, on, "left_anti").withColumn("group", F.lit("replicate")))
    shown = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("method_id")), F.col("method_id"))
    return both.filter(F.col("runtime").isNotNull() & ~F.isnan("runtime")).select(*on, shown.alias("method_name"), "group", "runtime")


def box_stats(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Quartiles and whiskers: the outermost values within 1.5 quartile distances."""
    w = Window.partitionBy(key)
    q = rows.withColumn("_q", F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(w))
    reach = 1.5 * (F.col("_q")[2] - F.col("_q")[0])
    inside = (F.col(value) >= F.col("_q")[0] - reach) & (F.col(value) <= F.col("_q")[2] + reach)
    q = q.withColumn("_in", F.when(inside, F.col(value)))
    return q.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min("_in").alias("whisker_low"), F.first(F.col("_q")[0]).alias("q1"), F.first(F.col("_q")[1]).alias("median"), F.first(F.col("_q")[2]).alias("q3"), F.max("_in").alias("whisker_high")
    )


def sensitivity_long(summary: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """One row per unit and metric with K as the factor."""
    long = summary.unpivot(list(UNIT), list(metrics), "metric_name", "metric_value")
    return long.select(*UNIT, F.lit("K").alias("sensitivity_factor"), F.col("K").cast("string").alias("factor_value"), "metric_name", "metric_value")


def rows_added(before: DataFrame, after: DataFrame, tag: str) -> DataFrame:
    """Rows per stage tag before and after; a stage that added none has failed."""
    a = after.groupBy(tag).agg(F.count(F.lit(1)).alias("n_after"))
    b = before.groupBy(tag).agg(F.count(F.lit(1)).alias("n_before"))
    out = a.join(b, tag, "left").select(tag, F.coalesce("n_before", F.lit(0)).cast("bigint").alias("n_before"), "n_after")
    return out.withColumn("added", F.col("n_after") - F.col("n_before")).withColumn("failed", F.col("added") <= 0)


def method_summary(runs: DataFrame) -> DataFrame:
    """Per unit: quartiles of the metrics, seeds asked for and the share of runs that failed."""
    q = lambda c: F.percentile(F.when(F.col("status") == "success", F.col(c)), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = runs.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n_runs"), F.sum((F.col("status") == "success").cast("bigint")).alias("n_ok"), q("coherence").alias("c"), q("marker").alias("m"), median("wall_time_sec").alias("sec"))
    return out.select(
        *UNIT,
        "n_runs",
        F.col("c")[1].alias("coherence_median"),
        (F.col("c")[2] - F.col("c")[0]).alias("coherence_iqr"),
        F.col("m")[1].alias("marker_median"),
        (F.col("m")[2] - F.col("m")[0]).alias("marker_iqr"),
        F.col("sec").alias("wall_time_median"),
        (1 - F.col("n_ok") / F.col("n_runs")).alias("failure_rate"),
    )


def feasibility(units: DataFrame, limit_mb: float = 6000.0) -> DataFrame:
    """Whether a unit fits a laptop or wants a larger machine, by its memory."""
    small = F.col("peak_rss_mb") < limit_mb
    return units.withColumns({"laptop_feasible": small.cast("int"), "cloud_recommended": (~small).cast("int"), "recommendation": F.when(small, "laptop").otherwise("cloud")})
