"""Queries of the sources, parsers and ledger operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotlattice.functions.expr import number, r6
from spotlattice.functions.parse import config, first_integer, noted_count
from spotlattice.operators import ledger as L
from spotlattice.operators.lineage import shared_dir
from spotlattice.sources import io
from spotlattice.plans.views import tasks_for, view, with_views

FOCAL = "purchase"
METRICS = ("coherence", "marker")
LOCKED = """locked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, sample_id, method_id, K ORDER BY seed_count DESC, ingest_seq DESC) AS rr
  FROM v_ledger WHERE regexp_matches(notes, '^rigor-backfill') OR regexp_matches(notes, '^stage3[a-z]-full-replication')) WHERE rr = 1)"""


def _rounded(df, *cols):
    return df.withColumns({c: r6(F.col(c)) for c in cols})


def _locked(spark, d):
    return L.lock_rows(view(spark, d, "ledger"))


def _folder(spark):
    return shared_dir(spark, "files")


def filter_locked(spark, d):
    return L.filter_locked(view(spark, d, "ledger")).select("dataset_id", "sample_id", "method_id", "K", "ingest_seq")


def lock_rows(spark, d):
    return _rounded(_locked(spark, d), "coherence").select("dataset_id", "sample_id", "method_id", "K", "seed_count", "ingest_seq", "coherence")


def parse_int(spark, d):
    return view(spark, d, "customer").select("c_custkey", first_integer(F.col("c_name")).alias("number"))


def _notes(spark, d):
    e = view(spark, d, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("done; n_samples="), F.col("user_id"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("n="), F.col("user_id"), F.lit(" n_sample_k=7"))).otherwise("none")
    return e.select("event_id", "event_type", "value", text.alias("notes"))


def claim_effects(spark, d):
    return _notes(spark, d).select("event_id", F.col("event_type").alias("claim_id"), r6(F.col("value")).alias("effect"), noted_count(F.col("notes")).alias("n"))


def config_parse(spark, d):
    e = view(spark, d, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("stagate_d"), F.col("user_id"), F.lit("_e500"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("spagcn_p0."), F.col("user_id") % 9 + 1)).otherwise("other")
    c = e.select("event_id", text.alias("config_id"))
    return c.select("event_id", "config_id", *(x.alias(n) for n, x in config(F.col("config_id")).items()))


def feasibility_flags(spark, d):
    return _flags(view(spark, d, "ledger"))


def _flags(led):
    return L.feasibility(led.select("ingest_seq", (F.col("peak_rss_mb") * 2).alias("peak_rss_mb"))).select("ingest_seq", "laptop_feasible", "cloud_recommended", "recommendation")


def nrep_sensitivity(spark, d):
    led = view(spark, d, "ledger")
    m = lambda x: led.filter(F.col("method_id") == x)
    return _rounded(L.depth_sensitivity(m("purchase"), m("view"), m("click")), "delta_depth", "delta_reference", "time_ratio")


def quality_deltas(spark, d):
    return _rounded(L.quality_deltas(_locked(spark, d), FOCAL, METRICS), "delta_coherence", "delta_marker")


def stability_extract(spark, d):
    return _rounded(_locked(spark, d).filter(F.col("dataset_id").isin("D0", "D1") & (F.col("method_id") == FOCAL)), "coherence", "marker").select("dataset_id", "sample_id", "K", "seed_count", "coherence", "marker")


def dataset_summary_medians(spark, d):
    return _rounded(L.dataset_medians(_locked(spark, d), METRICS), "median_coherence", "median_marker")


def dataset_coverage(spark, d):
    led = view(spark, d, "ledger")
    declared = led.groupBy("dataset_id").agg((F.countDistinct("sample_id") + 1).alias("n_declared"))
    return _rounded(L.coverage(declared, _locked(spark, d), FOCAL), "focal_coverage")


def hyperparam_spread(spark, d):
    return _rounded(L.spread(view(spark, d, "ledger"), METRICS), "median", "range", "iqr")


def relative_to_group_median(spark, d):
    return _rounded(L.relative_to_group(view(spark, d, "ledger"), "coherence", ("sample_id", "K")), "abs_value", "relative").select("ingest_seq", "sample_id", "K", "abs_value", "relative")


def runtime_unit(spark, d):
    return _rounded(L.runtime_unit(view(spark, d, "ledger")), "runtime")


def runtime_groups(spark, d):
    units = L.runtime_unit(view(spark, d, "ledger"))
    return _rounded(L.runtime_groups(units.filter("dataset_id = 'D0' OR method_id = 'view'"), units, {"view": "Baseline", "click": "Baseline 2"}), "runtime")


def box_stats(spark, d):
    return _rounded(L.box_stats(L.runtime_unit(view(spark, d, "ledger")), "method_id", "runtime"), "whisker_low", "q1", "median", "q3", "whisker_high")


def method_summary(spark, d):
    return _rounded(L.method_summary(view(spark, d, "ledger")), "coherence_median", "coherence_iqr", "marker_median", "marker_iqr", "wall_time_median", "failure_rate")


def sensitivity_long(spark, d):
    s = L.method_summary(view(spark, d, "ledger"))
    return _rounded(L.sensitivity_long(s, ("coherence_median", "marker_median")), "metric_value")


def rows_added(spark, d):
    led = view(spark, d, "ledger")
    return L.rows_added(led.filter("ingest_seq % 4 = 0 AND method_id <> 'view'"), led.filter("method_id = 'view' OR ingest_seq % 4 = 0"), "method_id")


def _paths(spark, d):
    """Made-up file paths of three layouts, one sample a nation, from the table of nations."""
    n = view(spark, d, "nation")
    k, s = F.col("n_nationkey"), F.concat(F.lit("S"), F.col("n_nationkey"))
    flat = F.array(*(F.concat(F.lit("/data/x/flat/"), s, F.lit(e)) for e in ("_matrix.mtx.gz", "_barcodes.tsv.gz", "_tissue_positions_list.csv", "_tissue_positions.csv")))
    h5 = F.array(*(F.concat(F.lit("/data/x/h5/"), s, F.lit(e)) for e in ("_filtered_feature_bc_matrix.h5", "_tissue_positions_list.csv", "_tissue_positions.csv")))
    each = F.when(k % 5 == 0, F.concat(flat, h5)).when(k % 3 == 0, h5).otherwise(flat)
    nested = F.array(F.concat(F.lit("/data/x/N"), k, F.lit("/"), s, F.lit("/raw/matrix.mtx")), F.concat(F.lit("/data/x/N"), k, F.lit("/"), s, F.lit("/raw/barcodes.tsv")), F.concat(F.lit("/data/x/N"), k, F.lit("/tissue_positions_a.csv")))
    return n.select(F.explode(F.concat(each, F.when(k % 2 == 0, nested).otherwise(F.array().cast("array<string>")))).alias("path"))


def sample_discovery(spark, d):
    return io.discover(_paths(spark, d), "/data/x")


DISCOVERY_SQL = """SELECT 'S' || n_nationkey AS sample_id,
CASE WHEN n_nationkey % 5 = 0 OR n_nationkey % 3 = 0 THEN 'h5' ELSE 'flat' END AS layout,
CASE WHEN n_nationkey % 5 = 0 OR n_nationkey % 3 = 0 THEN '/data/x/h5/S' || n_nationkey || '_filtered_feature_bc_matrix.h5' ELSE '/data/x/flat/S' || n_nationkey || '_matrix.mtx.gz' END AS matrix,
CASE WHEN n_nationkey % 5 = 0 OR n_nationkey % 3 = 0 THEN '/data/x/h5/S' || n_nationkey || '_tissue_positions_list.csv' ELSE '/data/x/flat/S' || n_nationkey || '_tissue_positions.csv' END AS positions FROM nation"""


def mtx_read(spark, d):
    """Writes each sample's counts as MatrixMarket text, in files of some of its spots each, and reads them back."""
    n = tasks_for(spark, d)
    c = view(spark, d, "counts").withColumn("block", F.pmod(F.xxhash64("spot"), F.lit(-(-n // 5))))
    line = F.concat_ws(" ", F.col("gene") + 1, F.col("spot") + 1, "n")
    head = c.groupBy("sample_id", "block").agg(F.concat(F.lit("%%MatrixMarket matrix coordinate integer general\n%\n"), F.concat_ws(" ", F.max("gene") + 1, F.max("spot") + 1, F.count(F.lit(1)))).alias("value")).select("sample_id", "block", F.lit(0).alias("o"), "value")
    body = c.select("sample_id", "block", F.lit(1).alias("o"), line.alias("value"))
    folder = _folder(spark)
    head.unionByName(body).repartition(n, "sample_id", "block").sortWithinPartitions("sample_id", "block", "o", "value").drop("o").write.partitionBy("sample_id", "block").text(folder)
    triplets, _ = io.read_mtx(spark, f"{folder}/*/*")
    return triplets.select(F.url_decode(F.regexp_extract("path", "sample_id=([^/]+)", 1)).alias("sample_id"), "gene", "spot", "n")


def csc_to_triplets(spark, d):
    """Counts of each spot's 16 neighbours in number as one small matrix, and back."""
    c = view(spark, d, "counts").withColumns({"block": F.floor(F.col("spot") / 16), "column": F.col("spot") % 16})
    m = c.repartition(tasks_for(spark, d), "sample_id", "block").groupBy("sample_id", "block").agg(F.sort_array(F.collect_list(F.struct("column", "gene", "n"))).alias("m"))
    ptr = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.size(F.filter("m", lambda x: x["column"] < i)))
    arrays = m.select(F.concat_ws("|", "sample_id", "block").alias("sample_id"), F.col("m.n").alias("data"), F.col("m.gene").alias("indices"), ptr.alias("indptr"))
    t = io.csc_to_triplets(arrays)
    parts = F.split("sample_id", r"\|")
    return t.select(parts[0].alias("sample_id"), "gene", (parts[1].cast("bigint") * 16 + F.col("spot")).alias("spot"), "n")


COUNTS_SQL = with_views("SELECT sample_id, gene, spot, n FROM v_counts", "counts")


def line_index(spark, d):
    c = view(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("c_custkey")), lambda x: F.concat(F.lit("BC-"), x)), "\n").alias("value"))
    return io.line_index(c.select(F.col("c_nationkey").cast("string").alias("path"), F.concat("value", F.lit("\n")).alias("value"))).select("path", F.col("ordinal").cast("bigint").alias("ordinal"), "value")


def _positions(spark, d):
    s = view(spark, d, "spots")
    rows = s.select("sample_id", F.concat(F.lit("BC-"), "spot").alias("barcode"), (F.col("spot") % 7 != 0).cast("int").cast("string").alias("in_tissue"), (F.col("spot") % 10).cast("string").alias("array_row"), F.lit("NA").alias("array_col"), F.col("y").cast("string").alias("pxl_row_in_fullres"), F.col("x").cast("string").alias("pxl_col_in_fullres"))
    head = rows.select("sample_id").distinct().select("sample_id", *(F.lit(c).alias(c) for c in io.POSITIONS))
    return rows.unionByName(head)


def positions_read(spark, d):
    return io.parse_positions(_positions(spark, d))


def _barcodes(spark, d):
    s = view(spark, d, "spots").filter("spot % 5 <> 0")
    return s.select("sample_id", F.concat(F.lit("BC-"), "spot").alias("barcode"), F.col("spot").alias("spot_idx"))


def spots_aligned(spark, d):
    return io.align(io.parse_positions(_positions(spark, d)), _barcodes(spark, d))


def guard_violations(spark, d):
    s = view(spark, d, "spots")
    shapes = s.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_spots"), F.lit(150).cast("bigint").alias("n_genes"))
    genes = view(spark, d, "counts").select("sample_id", "gene").distinct()
    return io.guard_violations(spots_aligned(spark, d), _barcodes(spark, d), genes, shapes, 250)


def gene_dedup(spark, d):
    return io.unique_names(view(spark, d, "features")).select("gene", "unique_name")


def tsv_read(spark, d):
    """Writes customers as a tab-separated table with missing spellings and reads it back."""
    c = view(spark, d, "customer")
    text = F.when(F.col("c_custkey") % 5 == 0, "NA").when(F.col("c_custkey") % 7 == 0, "nan").otherwise(F.col("c_acctbal").cast("string"))
    folder = _folder(spark)
    io.write_tsv(c.select("c_custkey", text.alias("score"), "c_mktsegment"), folder, ["c_custkey", "score", "c_mktsegment"])
    t = io.read_tsv(spark, folder)
    return t.select(number(F.col("c_custkey"), "bigint").alias("c_custkey"), r6(number(F.col("score"))).alias("score"), "c_mktsegment")


def ledger_append(spark, d):
    led = view(spark, d, "ledger").select("dataset_id", "sample_id", "method_id", "K")
    new = view(spark, d, "ledger").filter("ingest_seq % 2 = 0").select("dataset_id", "sample_id", F.when(F.col("ingest_seq") % 3 == 0, "fresh").otherwise(F.col("method_id")).alias("method_id"), "K")
    return io.new_rows(new, led.filter("method_id <> 'view'"))


def dedup_exact(spark, d):
    return io.dedup_exact(view(spark, d, "ledger").select("dataset_id", "sample_id", "method_id", "K"))[1]


def manifest_check(spark, d):
    s = view(spark, d, "supplier")
    name = F.concat(F.lit("bundle_"), F.col("s_suppkey"), F.lit(".tar"))
    files = s.filter("s_suppkey % 4 <> 0").select(F.concat(F.lit("/store/a/"), name).alias("path"), (F.col("s_suppkey") * 100 + F.when(F.col("s_suppkey") % 3 == 0, 1).otherwise(0)).alias("length"))
    return io.check_manifest(s.select(F.col("s_suppkey").alias("id"), name.alias("file_name"), (F.col("s_suppkey") * 100).alias("expected_bytes")), files)


def notes_backfill(spark, d):
    led = view(spark, d, "ledger").withColumn("notes", F.when(F.col("ingest_seq") % 4 == 0, "  ").when(F.col("ingest_seq") % 4 == 1, None).otherwise(F.col("notes")))
    return io.backfill_notes(led, {"D0": "stage3a", "D1": "stage3b"}, {"view": "-base", "click": ""}).select("ingest_seq", "notes")


def config_union(spark, d):
    """Writes one folder a method and reads all in one pattern."""
    led = view(spark, d, "ledger").select("method_id", "ingest_seq", "sample_id")
    folder = _folder(spark)
    led.write.partitionBy("method_id").option("sep", "\t").option("header", True).csv(folder)
    rows = io.union_configs(spark, f"{folder}/*")
    return rows.select(F.regexp_replace("config_id", "^method_id=", "").alias("config_id"), F.col("ingest_seq").cast("bigint").alias("ingest_seq"), "sample_id")


def failure_rows(spark, d):
    led = view(spark, d, "ledger")
    message = F.concat(F.lit("step "), "ingest_seq", F.lit("\n\tat "), "method_id", F.lit("\r\n"), F.repeat(F.lit("x"), (F.col("ingest_seq") % 700).cast("int")))
    return io.failure_rows(led.select("ingest_seq", "status", message.alias("message"))).select("ingest_seq", "message")


def run_summary(spark, d):
    led = view(spark, d, "ledger").withColumns({"stage_id": F.col("method_id"), "finished": F.col("started") + F.expr("INTERVAL 1 SECOND")})
    return io.run_summary(led).select("stage_id", "dataset_id", "discovered", "processed", "micros", "status")


QUERIES = {f.__name__: f for f in (
    filter_locked, lock_rows, parse_int, claim_effects, config_parse, feasibility_flags, nrep_sensitivity, quality_deltas, stability_extract, dataset_summary_medians,
    dataset_coverage, hyperparam_spread, relative_to_group_median, runtime_unit, runtime_groups, box_stats, method_summary, sensitivity_long, rows_added,
    sample_discovery, mtx_read, csc_to_triplets, line_index, positions_read, spots_aligned, guard_violations, gene_dedup, tsv_read, ledger_append, dedup_exact,
    manifest_check, notes_backfill, config_union, failure_rows, run_summary,
)}

_ALIGNED = "aligned AS (SELECT sample_id, 'BC-' || spot AS barcode, spot AS spot_idx, x, y FROM v_spots WHERE spot % 7 <> 0 AND spot % 5 <> 0)"
_UNIT = "dataset_id, sample_id, method_id, K"
_RT = "rt AS (SELECT method_id, dataset_id, sample_id, K, quantile_cont(wall_time_sec, 0.5) AS runtime FROM v_ledger WHERE status = 'success' AND wall_time_sec IS NOT NULL GROUP BY ALL)"
_MS = """ms AS (SELECT dataset_id, sample_id, method_id, K, count(*) AS n_runs, quantile_cont(coherence, 0.5) FILTER (status = 'success') AS coherence_median,
  quantile_cont(coherence, 0.75) FILTER (status = 'success') - quantile_cont(coherence, 0.25) FILTER (status = 'success') AS coherence_iqr, quantile_cont(marker, 0.5) FILTER (status = 'success') AS marker_median,
  quantile_cont(marker, 0.75) FILTER (status = 'success') - quantile_cont(marker, 0.25) FILTER (status = 'success') AS marker_iqr, quantile_cont(wall_time_sec, 0.5) AS wall_time_median, 1 - count(*) FILTER (status = 'success') / count(*) AS failure_rate FROM v_ledger GROUP BY ALL)"""


def _led(body: str) -> str:
    return with_views(body, "ledger")


def _last(method: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, sample_id, K ORDER BY ingest_seq DESC) AS rr FROM v_ledger WHERE method_id = '{method}') WHERE rr = 1)"


SQL = {
    "filter_locked": _led("SELECT dataset_id, sample_id, method_id, K, ingest_seq FROM v_ledger WHERE regexp_matches(notes, '^rigor-backfill') OR regexp_matches(notes, '^stage3[a-z]-full-replication')"),
    "lock_rows": _led(f"WITH {LOCKED} SELECT dataset_id, sample_id, method_id, K, seed_count, ingest_seq, round(coherence, 6) AS coherence FROM locked"),
    "parse_int": "SELECT c_custkey, regexp_extract(c_name, '(-?[0-9]+)', 1)::BIGINT AS number FROM customer",
    "claim_effects": "SELECT event_id, event_type AS claim_id, round(value, 6) AS effect, CASE event_id % 3 WHEN 0 THEN user_id WHEN 1 THEN 7 END::BIGINT AS n FROM events",
    "config_parse": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'stagate_d' || user_id || '_e500' WHEN 1 THEN 'spagcn_p0.' || (user_id % 9 + 1) ELSE 'other' END AS config_id, CASE event_id % 3 WHEN 0 THEN 'stagate' WHEN 1 THEN 'spagcn' ELSE 'unknown' END AS family, CASE WHEN event_id % 3 = 0 THEN user_id END::BIGINT AS latent, CASE WHEN event_id % 3 = 0 THEN 500 END::BIGINT AS epochs, CASE WHEN event_id % 3 = 1 THEN ('0.' || (user_id % 9 + 1))::DOUBLE END AS p FROM events",
    "feasibility_flags": _led("SELECT ingest_seq, (peak_rss_mb * 2 < 6000)::INT AS laptop_feasible, (peak_rss_mb * 2 >= 6000)::INT AS cloud_recommended, CASE WHEN peak_rss_mb * 2 < 6000 THEN 'laptop' ELSE 'cloud' END AS recommendation FROM v_ledger"),
    "nrep_sensitivity": _led(f"SELECT a.dataset_id, a.sample_id, a.K, round(a.coherence - b.coherence, 6) AS delta_depth, round(a.coherence - c.coherence, 6) AS delta_reference, round(CASE WHEN b.wall_time_sec <> 0 THEN a.wall_time_sec / b.wall_time_sec END, 6) AS time_ratio FROM {_last('purchase')} a JOIN {_last('view')} b USING (dataset_id, sample_id, K) LEFT JOIN {_last('click')} c USING (dataset_id, sample_id, K)"),
    "quality_deltas": _led(f"WITH {LOCKED} SELECT a.dataset_id, a.sample_id, a.K, b.method_id AS baseline, round(a.coherence - b.coherence, 6) AS delta_coherence, round(a.marker - b.marker, 6) AS delta_marker FROM locked a JOIN locked b ON a.dataset_id = b.dataset_id AND a.sample_id = b.sample_id AND a.K = b.K AND a.method_id = '{FOCAL}' AND b.method_id <> '{FOCAL}' WHERE a.marker - b.marker IS NOT NULL AND a.coherence - b.coherence IS NOT NULL"),
    "stability_extract": _led(f"WITH {LOCKED} SELECT dataset_id, sample_id, K, seed_count, round(coherence, 6) AS coherence, round(marker, 6) AS marker FROM locked WHERE dataset_id IN ('D0', 'D1') AND method_id = '{FOCAL}'"),
    "dataset_summary_medians": _led(f"WITH {LOCKED} SELECT dataset_id, method_id, K, count(DISTINCT sample_id) AS n_samples, round(quantile_cont(coherence, 0.5), 6) AS median_coherence, round(quantile_cont(marker, 0.5), 6) AS median_marker FROM locked GROUP BY dataset_id, method_id, K"),
    "dataset_coverage": _led(f"WITH {LOCKED}, dec AS (SELECT dataset_id, count(DISTINCT sample_id) + 1 AS n_declared FROM v_ledger GROUP BY 1), s AS (SELECT dataset_id, count(DISTINCT sample_id) AS n_benchmarked, string_agg(DISTINCT method_id, ',' ORDER BY method_id) AS methods, count(DISTINCT sample_id) FILTER (method_id = '{FOCAL}') AS n_focal, count(*) FILTER (method_id = '{FOCAL}') AS focal_rows FROM locked GROUP BY 1) SELECT dataset_id, n_declared, coalesce(n_benchmarked, 0) AS n_benchmarked, coalesce(methods, '') AS methods, coalesce(n_focal, 0) AS n_focal, coalesce(focal_rows, 0) AS focal_rows, round(coalesce(n_focal, 0) / n_declared, 6) AS focal_coverage FROM dec LEFT JOIN s USING (dataset_id)"),
    "hyperparam_spread": _led("WITH l AS (SELECT dataset_id, sample_id, method_id, K, 'coherence' AS metric, coherence AS value FROM v_ledger WHERE coherence IS NOT NULL UNION ALL SELECT dataset_id, sample_id, method_id, K, 'marker', marker FROM v_ledger WHERE marker IS NOT NULL), u AS (SELECT dataset_id, sample_id, method_id, K, metric, quantile_cont(value, 0.5) AS m, max(value) - min(value) AS r, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS i FROM l GROUP BY ALL) SELECT method_id, K, metric, count(*) AS n_units, round(quantile_cont(m, 0.5), 6) AS median, round(quantile_cont(r, 0.5), 6) AS range, round(quantile_cont(i, 0.5), 6) AS iqr FROM u GROUP BY method_id, K, metric"),
    "relative_to_group_median": _led("SELECT ingest_seq, sample_id, K, round(abs(coherence), 6) AS abs_value, round(CASE WHEN m <> 0 THEN abs(coherence) / m END, 6) AS relative FROM (SELECT *, quantile_cont(abs(coherence), 0.5) OVER (PARTITION BY sample_id, K) AS m FROM v_ledger)"),
    "runtime_unit": _led(f"WITH {_RT} SELECT method_id, dataset_id, sample_id, K, round(runtime, 6) AS runtime FROM rt"),
    "runtime_groups": _led(f"WITH {_RT} SELECT dataset_id, sample_id, method_id, K, CASE method_id WHEN 'view' THEN 'Baseline' WHEN 'click' THEN 'Baseline 2' ELSE method_id END AS method_name, CASE WHEN dataset_id = 'D0' OR method_id = 'view' THEN 'primary' ELSE 'replicate' END AS \"group\", round(runtime, 6) AS runtime FROM rt"),
    "box_stats": _led(f"WITH {_RT}, q AS (SELECT method_id, count(*) AS n, quantile_cont(runtime, 0.25) AS q1, quantile_cont(runtime, 0.5) AS median, quantile_cont(runtime, 0.75) AS q3 FROM rt GROUP BY 1) SELECT method_id, any_value(n) AS n, round(min(runtime) FILTER (runtime >= q1 - 1.5 * (q3 - q1) AND runtime <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_low, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, round(max(runtime) FILTER (runtime >= q1 - 1.5 * (q3 - q1) AND runtime <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high FROM rt JOIN q USING (method_id) GROUP BY method_id"),
    "method_summary": _led(f"WITH {_MS} SELECT {_UNIT}, n_runs, round(coherence_median, 6) AS coherence_median, round(coherence_iqr, 6) AS coherence_iqr, round(marker_median, 6) AS marker_median, round(marker_iqr, 6) AS marker_iqr, round(wall_time_median, 6) AS wall_time_median, round(failure_rate, 6) AS failure_rate FROM ms"),
    "sensitivity_long": _led(f"WITH {_MS} SELECT {_UNIT}, 'K' AS sensitivity_factor, K::VARCHAR AS factor_value, 'coherence_median' AS metric_name, round(coherence_median, 6) AS metric_value FROM ms UNION ALL SELECT {_UNIT}, 'K', K::VARCHAR, 'marker_median', round(marker_median, 6) FROM ms"),
    "rows_added": _led("SELECT method_id, count(*) FILTER (ingest_seq % 4 = 0 AND method_id <> 'view') AS n_before, count(*) AS n_after, count(*) - count(*) FILTER (ingest_seq % 4 = 0 AND method_id <> 'view') AS added, count(*) - count(*) FILTER (ingest_seq % 4 = 0 AND method_id <> 'view') <= 0 AS failed FROM v_ledger WHERE method_id = 'view' OR ingest_seq % 4 = 0 GROUP BY method_id"),
    "sample_discovery": DISCOVERY_SQL,
    "mtx_read": COUNTS_SQL,
    "csc_to_triplets": COUNTS_SQL,
    "line_index": "SELECT c_nationkey::VARCHAR AS path, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS ordinal, 'BC-' || c_custkey AS value FROM customer",
    "positions_read": with_views("SELECT sample_id, 'BC-' || spot AS barcode, (spot % 7 <> 0)::INT AS in_tissue, (spot % 10)::INT AS array_row, NULL::INT AS array_col, y AS pxl_row_in_fullres, x AS pxl_col_in_fullres FROM v_spots", "spots"),
    "spots_aligned": with_views(f"WITH {_ALIGNED} SELECT * FROM aligned", "spots"),
    "guard_violations": with_views(f"WITH {_ALIGNED}, sh AS (SELECT sample_id, count(*) AS n_spots, count(*) FILTER (spot % 5 <> 0) AS b, count(*) FILTER (spot % 5 <> 0 AND spot % 7 <> 0) AS s FROM v_spots GROUP BY 1), f AS (SELECT sample_id, count(DISTINCT gene) AS f FROM v_counts GROUP BY 1) SELECT sample_id, 'barcodes' AS guard, n_spots AS expected, b AS found FROM sh WHERE b <> n_spots UNION ALL SELECT sample_id, 'features', 150, f FROM sh JOIN f USING (sample_id) WHERE f <> 150 UNION ALL SELECT sample_id, 'spots', 250, s FROM sh WHERE s < 250", "spots", "counts"),
    "gene_dedup": "SELECT p_partkey AS gene, CASE WHEN n = 0 THEN p_name ELSE p_name || '.' || n END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS n FROM part)",
    "tsv_read": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN NULL ELSE round(c_acctbal, 6) END AS score, c_mktsegment FROM customer",
    "ledger_append": _led("SELECT DISTINCT dataset_id, sample_id, CASE WHEN ingest_seq % 3 = 0 THEN 'fresh' ELSE method_id END AS method_id, K FROM v_ledger WHERE ingest_seq % 2 = 0 EXCEPT SELECT dataset_id, sample_id, method_id, K FROM v_ledger WHERE method_id <> 'view'"),
    "dedup_exact": _led("SELECT count(*) AS n_before, count(DISTINCT (dataset_id, sample_id, method_id, K)) AS n_after, count(*) - count(DISTINCT (dataset_id, sample_id, method_id, K)) AS n_removed FROM v_ledger"),
    "manifest_check": "SELECT s_suppkey AS id, 'bundle_' || s_suppkey || '.tar' AS file_name, s_suppkey * 100 AS expected_bytes, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey * 100 + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END END AS found_bytes, s_suppkey % 4 <> 0 AND s_suppkey % 3 <> 0 AS size_ok FROM supplier",
    "notes_backfill": _led("SELECT ingest_seq, CASE WHEN ingest_seq % 4 > 1 THEN notes ELSE coalesce(CASE dataset_id WHEN 'D0' THEN 'stage3a' WHEN 'D1' THEN 'stage3b' END || '-full-replication' || CASE method_id WHEN 'view' THEN '-base' WHEN 'click' THEN '' END, CASE WHEN ingest_seq % 4 = 0 THEN '  ' END) END AS notes FROM v_ledger"),
    "config_union": _led("SELECT method_id AS config_id, ingest_seq, sample_id FROM v_ledger"),
    "failure_rows": _led("SELECT ingest_seq, substr(regexp_replace('step ' || ingest_seq || chr(10) || chr(9) || 'at ' || method_id || chr(13) || chr(10) || repeat('x', ingest_seq % 700), '[\\t\\r\\n]+', ' ', 'g'), 1, 500) AS message FROM v_ledger WHERE status <> 'success'"),
    "run_summary": _led("SELECT method_id AS stage_id, dataset_id, count(*) AS discovered, count(*) FILTER (status = 'success') AS processed, epoch_us(max(started)) + 1000000 - epoch_us(min(started)) AS micros, CASE WHEN count(*) FILTER (status = 'success') = count(*) THEN 'success' WHEN count(*) FILTER (status = 'success') > 0 THEN 'partial' ELSE 'failed' END AS status FROM v_ledger GROUP BY 1, 2"),
}
# the name under which an earlier version registered the whole table
QUERIES["feasibility_flags_whole"], SQL["feasibility_flags_whole"] = QUERIES["feasibility_flags"], SQL["feasibility_flags"]
