"""Queries of normalisation, graphs, metrics and comparisons over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotlattice.functions.expr import hash_number_sql, r6
from spotlattice.operators import compare as H
from spotlattice.operators import graph as G
from spotlattice.operators import metrics as Q
from spotlattice.operators import normalize as N
from spotlattice.plans.views import view, with_views

K = "sample_id"


def _v(spark, d, name):
    return view(spark, d, name)


def _spots(spark, d):
    return _v(spark, d, "spots").select(K, "spot", "x", "y")


def _expr(spark, d):
    return N.lognorm(_v(spark, d, "counts"))


def _embed(spark, d):
    e = _v(spark, d, "embeddings").select(F.col("vec_id").alias("spot"), F.col("embedding").cast("array<double>").alias("f"))
    return _spots(spark, d).join(e, "spot").select(K, "spot", "f", "x", "y")


def _labels(spark, d, seed=11):
    return _v(spark, d, "labels").filter(F.col("seed") == seed).select(K, "spot", "label")


def _sig(spark):
    rows = [("myeloid", ["G1", "G5", "G999"]), ("caf", ["G7", "G2"]), ("tcell", ["G11", "G3", "G4"])]
    return spark.createDataFrame(rows, "signature_id string, genes array<string>")


def _gene_names(spark, d):
    return _v(spark, d, "counts").select("gene").distinct().withColumn("name", F.concat(F.lit("G"), "gene"))


# --- queries -------------------------------------------------------------------


def library_size(spark, d):
    return N.library_size(_v(spark, d, "counts"), _spots(spark, d)).select(K, "spot", F.col("size").cast("bigint").alias("size"))


def lognorm(spark, d):
    return _expr(spark, d).select(K, "spot", "gene", r6(F.col("v")).alias("v"))


def hvg_select(spark, d):
    return N.hvg_select(_expr(spark, d), _spots(spark, d)).select(K, "gene", r6(F.col("variance")).alias("variance"), "rank")


def pca_variance(spark, d):
    """Variances of the first components per sample, in falling order, and whether they had stopped moving."""
    e = _expr(spark, d)
    top = N.hvg_select(e, _spots(spark, d)).select(K, "gene")
    _, variance = N.pca(e.join(F.broadcast(top), [K, "gene"], "left_semi"), _spots(spark, d))
    return variance.select(K, "part", r6(F.col("variance")).alias("variance"), "converged")


def coords_scaled(spark, d):
    return N.coords_scaled(_spots(spark, d)).select(K, "spot", r6(F.col("xs")).alias("xs"), r6(F.col("ys")).alias("ys"))


def spatial_features(spark, d):
    e = _embed(spark, d)
    f = N.spatial_features(e.select(K, "spot", "f"), N.coords_scaled(e).select(K, "spot", "xs", "ys"))
    return f.select(K, "spot", F.size("f").alias("n"), r6(F.col("f")[0]).alias("f0"), r6(F.element_at("f", -2)).alias("fx"), r6(F.element_at("f", -1)).alias("fy"))


def knn_exact(spark, d):
    return G.knn(_spots(spark, d), 7).select(K, "spot", "other", "rank", r6(F.col("d2")).alias("d2"))


def knn_rank2to7(spark, d):
    return G.coherence_neighbours(_spots(spark, d))


def _graph(spark, d):
    return G.symmetric_graph(G.knn(_spots(spark, d), 6), _spots(spark, d))


def graph_symmetric(spark, d):
    return _graph(spark, d)


def edges_undirected(spark, d):
    return G.undirected(G.coherence_neighbours(_spots(spark, d)))


def _weights(spark, d):
    e = _embed(spark, d)
    return G.edge_weights(G.symmetric_graph(G.knn(e, 6), e), e)


def edge_weights(spark, d):
    return _weights(spark, d).select(K, "src", "dst", r6(F.col("w")).alias("w"))


def boundary_mask(spark, d):
    return Q.boundary(G.knn(_spots(spark, d), 6), _labels(spark, d))


def _lattice(spark, d):
    s = _spots(spark, d)
    text = F.concat_ws(", ", F.col("spot") + 1, F.col("spot") + 5, F.lit("x"), F.col("spot") - 7, F.lit("-3"))
    edges = G.lattice_neighbours(s.select(K, "spot", text.alias("neighbours")), s)
    return edges


def neighbor_list_agreement(spark, d):
    return Q.agreement(_lattice(spark, d), _labels(spark, d)).withColumn("coherence", r6(F.col("coherence")))


def affinity_mass(spark, d):
    return G.affinity_mass(_spots(spark, d), [100.0, 250.0]).withColumn("mass", r6(F.col("mass")))


def bandwidth_search(spark, d):
    return G.bandwidth_search(_spots(spark, d), 0.5).select(K, r6(F.col("l")).alias("l"), r6(F.col("mass")).alias("mass"))


def _features(spark, d):
    return _embed(spark, d).select(K, "spot", F.posexplode("f").alias("feature", "v"))


def graph_smooth(spark, d):
    w = _weights(spark, d)
    return G.smooth(w, _features(spark, d)).select(K, "spot", "feature", r6(F.col("v")).alias("v"))


_LEFT, _RIGHT = [0.5, -0.25, 1.0, 0.75], [-0.5, 0.3, 0.2, 0.1]
#: Components of a vector; the four given weights repeat over them.
SIZE = 64


def edge_attention(spark, d):
    e = _embed(spark, d)
    out = G.edge_attention(G.symmetric_graph(G.knn(e, 6), e), e, _LEFT * (SIZE // 4), _RIGHT * (SIZE // 4))
    return out.select(K, "spot", "part", r6(F.col("v")).alias("v"))


def spatial_coherence(spark, d):
    labels = _v(spark, d, "labels")
    return Q.agreement(G.coherence_neighbours(_spots(spark, d)), labels, ("seed",)).withColumn("coherence", r6(F.col("coherence")))


def _diffs(spark, d):
    return Q.marker_differences(_expr(spark, d), _labels(spark, d))


def marker_separation(spark, d):
    return Q.marker_separation(_diffs(spark, d), [20]).select(K, r6(F.col("separation")).alias("separation"), "n_clusters")


def marker_topn(spark, d):
    return Q.marker_separation(_diffs(spark, d), [10, 20, 50]).select(K, "top_n", r6(F.col("separation")).alias("separation"))


def marker_by_domain(spark, d):
    return Q.marker_top(_diffs(spark, d), [20]).select(K, "label", r6(F.col("mean")).alias("mean"), r6(F.col("most")).alias("most"))


def ari(spark, d):
    return Q.ari(_v(spark, d, "labels"), 11, 23).withColumn("ari", r6(F.col("ari")))


def ari_seed_pairs(spark, d):
    return Q.ari_seed_pairs(_v(spark, d, "labels")).withColumn("ari", r6(F.col("ari")))


def control_random_labels(spark, d):
    s = _spots(spark, d)
    return Q.agreement(G.coherence_neighbours(s), Q.random_labels(s, 4, 20260211)).withColumn("coherence", r6(F.col("coherence")))


def control_shuffled_coords(spark, d):
    return Q.control_shuffled(_spots(spark, d), _labels(spark, d), 20260211).withColumn("coherence", r6(F.col("coherence")))


def label_align(spark, d):
    return Q.align(_v(spark, d, "labels"), 11, 4)


def label_align_greedy(spark, d):
    return Q.align_greedy(_v(spark, d, "labels"), 11, 4)


def _unstable(spark, d):
    labels = _v(spark, d, "labels")
    return Q.unstable_spots(Q.aligned(labels, Q.align(labels, 11, 4), 11))


def unstable_spots(spark, d):
    return _unstable(spark, d).select(K, "spot", "unstable", r6(F.col("diff_rate")).alias("diff_rate"))


def instability_summary(spark, d):
    values = _spots(spark, d).select(K, "spot", (F.col("x") / 7).alias("m1"), (F.col("y") / 11).alias("m2"), F.when(F.col("spot") % 9 != 0, F.col("x") / 13).alias("m3"))
    out = Q.instability_summary(_unstable(spark, d), values, ("m1", "m2", "m3"))
    return out.select(K, "unstable", "n", *(r6(F.col(c)).alias(c) for c in ("median_m1", "median_m2", "median_m3", "median_sum")))


def select_marker(spark, d):
    c = spark.createDataFrame([("epithelial", ["none", "red widget", "blue bolt"]), ("stromal", ["small ring"]), ("immune", ["nothing"])], "category string, candidates array<string>")
    return Q.select_marker(c, _v(spark, d, "features"))


def _scores(spark, d):
    return H.signature_score(_expr(spark, d), _spots(spark, d), _sig(spark), _gene_names(spark, d))


def signature_score(spark, d):
    return _scores(spark, d).withColumn("score", r6(F.col("score")))


def signature_contrast(spark, d):
    return H.signature_contrast(_scores(spark, d), ("caf", "myeloid"), ("tcell",)).withColumn("contrast", r6(F.col("contrast")))


def signature_seed_median(spark, d):
    """Per signature the median over seeds of the difference boundary less interior."""
    b = _v(spark, d, "labels").select(K, "spot", "seed", (F.col("label") == 1).alias("inside"))
    g = H.group_compare(_scores(spark, d).join(b, [K, "spot"]), (K, "signature_id", "seed"), "inside", "score")
    return g.groupBy(K, "signature_id").agg(F.percentile("delta_mean", 0.5).alias("m")).select(K, "signature_id", r6(F.col("m")).alias("median_delta"))


def group_compare(spark, d):
    rows = _v(spark, d, "spots").select(K, (F.col("segment") == "BUILDING").alias("inside"), (F.col("x") / 7 - 300).alias("v"))
    g = H.group_compare(rows, (K,), "inside", "v")
    return g.select(K, "n_a", "n_b", *(r6(F.col(c)).alias(c) for c in ("mean_a", "mean_b", "median_a", "median_b", "positive_a", "positive_b", "delta_mean", "delta_median", "delta_positive")))


_HEAT = [1, 2, 3, 5, 7, 11, 13, 17]


def domain_heatmap(spark, d):
    return H.domain_heatmap(_expr(spark, d), _labels(spark, d), _HEAT).select(K, "gene", "label", r6(F.col("mean")).alias("mean"), r6(F.col("z")).alias("z"))


def coord_label_join(spark, d):
    s = _spots(spark, d)
    moved = s.select(K, "x", "y", (F.col("spot") % 4).alias("label"), F.col("spot").alias("origin")).withColumn("x", F.when(F.col("origin") % 20 == 0, F.col("x") + 50000).otherwise(F.col("x") + 0.0))
    joined, _ = H.coord_label_join(moved, s)
    return joined.select(K, "spot", "label", "origin")


def _mask(spark, d):
    """Boundaries of labels that leave few spots of the second and third sample on one side."""
    labels = _labels(spark, d).withColumn("label", F.when(F.col(K) == "ASIA", 0).when(F.col(K) == "EUROPE", F.when(F.col("spot") % 400 == 7, 1).otherwise(0)).otherwise(F.col("label")))
    return Q.boundary(G.knn(_spots(spark, d), 6), labels)


def boundary_guard(spark, d):
    """Boundary and interior spots of the samples that have ten of both; a sample that has not gives its failure row."""
    kept, failures = Q.boundary_guard(_mask(spark, d))
    good = kept.groupBy(K).agg(F.sum("is_boundary").alias("n_boundary"), F.count_if(F.col("is_boundary") == 0).alias("n_interior")).withColumn("error_message", F.lit(None).cast("string"))
    return good.unionByName(failures.select(K, "n_boundary", "n_interior", "error_message"))


def domain_heatmap_wide(spark, d):
    kept, _ = H.heatmap_guard(_expr(spark, d), _HEAT)
    wide = H.heatmap_wide(H.domain_heatmap(kept, _labels(spark, d), _HEAT), [0, 1, 2, 3])
    return wide.select(K, "gene", *(r6(F.col(c)).alias(c) for c in wide.columns if c.startswith("domain_")))


def heatmap_guard(spark, d):
    """Failure rows of the samples with fewer than eight of the genes; one sample is given the first five genes only."""
    e = _expr(spark, d).filter((F.col(K) != "ASIA") | (F.col("gene") <= 5))
    return H.heatmap_guard(e, _HEAT)[1]


def coord_guard(spark, d):
    """Spots that found a label, per sample, and the failure of those below 95 %."""
    s = _spots(spark, d)
    far = F.when(F.col(K) == "ASIA", F.col("spot") % 19 == 0).otherwise(F.col("spot") % 25 == 0)
    moved = s.select(K, "x", "y", (F.col("spot") % 4).alias("label"), "spot").withColumn("x", F.when(far, F.col("x") + 50000).otherwise(F.col("x"))).drop("spot")
    _, rates, failures = H.coord_guard(moved, s)
    return rates.join(failures.select(K, "error_message"), K, "left")


def edge_failures(spark, d):
    e = G.symmetric_graph(G.knn(_spots(spark, d), 6), _spots(spark, d)).filter((F.col(K) != "ASIA") | (F.col("src") == F.col("dst")))
    return G.edge_failures(_spots(spark, d), e)


def _gradient(spark, d):
    return H.image_gradient(_v(spark, d, "pixels"))


def image_gradient(spark, d):
    return _gradient(spark, d).select("px", "py", r6(F.col("grad")).alias("grad"))


def _on_image(spark, d):
    return _spots(spark, d).select(K, "spot", ((F.col("x") + 1000) / 250).alias("x"), (F.col("y") / 100).alias("y"))


def gradient_at_spots(spark, d):
    return H.gradient_at_spots(_gradient(spark, d), _on_image(spark, d)).select(K, "spot", "px", "py", r6(F.col("grad")).alias("grad"))


_EDGE = ("edge_boundary", "edge_within", "delta_edge", "spot_boundary", "spot_interior", "delta_spot")


def edge_alignment(spark, d):
    values = H.gradient_at_spots(_gradient(spark, d), _on_image(spark, d).filter(F.col(K) != "ASIA"))
    out = H.edge_alignment(G.undirected(G.coherence_neighbours(_spots(spark, d))), _labels(spark, d), values)
    return out.select(K, "n_spots", "n_edges", "n_boundary_edges", *(r6(F.col(c)).alias(c) for c in _EDGE), "status")


def patch_features(spark, d):
    out = H.patch_features(_on_image(spark, d), _v(spark, d, "pixels"))
    return out.select(K, "spot", "n_pixels", *(r6(F.col(c)).alias(c) for c in ("gray_mean", "gray_sd", "grad_mean", "grad_q95")))


QUERIES = {f.__name__: f for f in (
    library_size, lognorm, hvg_select, pca_variance, coords_scaled, spatial_features, knn_exact, knn_rank2to7, graph_symmetric, edges_undirected, edge_weights,
    boundary_mask, neighbor_list_agreement, affinity_mass, bandwidth_search, graph_smooth, edge_attention, spatial_coherence, marker_separation, marker_topn,
    marker_by_domain, ari, ari_seed_pairs, control_random_labels, control_shuffled_coords, label_align, label_align_greedy, unstable_spots, instability_summary,
    select_marker, signature_score, signature_contrast, signature_seed_median, group_compare, domain_heatmap, domain_heatmap_wide, heatmap_guard, boundary_guard, coord_guard, edge_failures, coord_label_join, image_gradient, gradient_at_spots,
    edge_alignment, patch_features,
)}

# --- oracles -------------------------------------------------------------------


def _knn_sql(source: str, k: int) -> str:
    return f"""SELECT * FROM (SELECT a.sample_id, a.spot, b.spot AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2,
  row_number() OVER (PARTITION BY a.sample_id, a.spot ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.spot)::INT AS rank
  FROM {source} a JOIN {source} b ON a.sample_id = b.sample_id AND a.spot <> b.spot) WHERE rank <= {k}"""


def _graph_sql(source: str) -> str:
    return f"""(SELECT DISTINCT * FROM (SELECT sample_id, spot AS src, other AS dst FROM ({_knn_sql(source, 6)}) UNION ALL SELECT sample_id, other, spot FROM ({_knn_sql(source, 6)}) UNION ALL SELECT sample_id, spot, spot FROM {source}))"""


EMBEDDED_SQL = "emb AS (SELECT sample_id, spot, x, y, embedding::DOUBLE[] AS f FROM v_spots JOIN embeddings ON vec_id = spot)"
_NORM = "CASE WHEN sqrt(list_sum(list_transform({0}, lambda q: q * q))) = 0 THEN 1 ELSE sqrt(list_sum(list_transform({0}, lambda q: q * q))) END"
WEIGHTS_SQL = f"""wt AS (SELECT sample_id, src, dst, greatest(0, (1 + list_sum(list_transform(list_zip(fa, fb), lambda p: p[1] * p[2])) / ({_NORM.format('fa')} * {_NORM.format('fb')})) / 2)::DOUBLE AS w
  FROM (SELECT g.sample_id, src, dst, a.f AS fa, b.f AS fb FROM {_graph_sql('emb')} g JOIN emb a ON a.sample_id = g.sample_id AND a.spot = src JOIN emb b ON b.sample_id = g.sample_id AND b.spot = dst WHERE src < dst))"""
_COH = f"coh AS (SELECT sample_id, spot AS src, other AS dst, rank FROM ({_knn_sql('v_spots', 7)}) WHERE rank >= 2)"
_LN = "ln_ AS (SELECT sample_id, spot, gene, ln(1 + n * 10000.0::DOUBLE / sum(n) OVER (PARTITION BY sample_id, spot)) AS v FROM v_counts)"
_L11 = "l11 AS (SELECT sample_id, spot, label FROM v_labels WHERE seed = 11)"
_DIFF = f"""{_LN}, {_L11},
c AS (SELECT sample_id, label, nc, n FROM (SELECT sample_id, label, count(*) AS nc FROM l11 GROUP BY ALL) JOIN (SELECT sample_id, count(*) AS n FROM l11 GROUP BY ALL) USING (sample_id) WHERE nc >= 3 AND n - nc >= 3),
s AS (SELECT sample_id, label, gene, sum(v) AS s FROM ln_ JOIN l11 USING (sample_id, spot) GROUP BY ALL), t AS (SELECT sample_id, gene, sum(v) AS t FROM ln_ JOIN l11 USING (sample_id, spot) GROUP BY ALL),
df AS (SELECT sample_id, label, gene, coalesce(s, 0) / nc - (t - coalesce(s, 0)) / (n - nc) AS diff FROM c JOIN t USING (sample_id) LEFT JOIN s USING (sample_id, label, gene)),
rk AS (SELECT *, row_number() OVER (PARTITION BY sample_id, label ORDER BY diff DESC, gene) AS r FROM df),
tp AS (SELECT sample_id, label, top_n, avg(diff) AS mean, max(diff) AS most FROM rk, (SELECT unnest([10, 20, 50]) AS top_n) WHERE r <= top_n GROUP BY ALL)"""


def _ari_sql(pairs: str, keys: str) -> str:
    return f"""pr AS ({pairs}), ce AS (SELECT {keys}, la, lb, count(*)::DOUBLE AS n FROM pr GROUP BY ALL),
ca AS (SELECT {keys}, sum(n * (n - 1) / 2) AS a FROM (SELECT {keys}, la, sum(n) AS n FROM ce GROUP BY ALL) GROUP BY ALL), cb AS (SELECT {keys}, sum(n * (n - 1) / 2) AS b FROM (SELECT {keys}, lb, sum(n) AS n FROM ce GROUP BY ALL) GROUP BY ALL),
ar AS (SELECT {keys}, CASE WHEN (a + b) / 2 - a * b / (n * (n - 1) / 2) = 0 THEN 1.0 ELSE (i - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)) END AS ari FROM (SELECT {keys}, sum(n * (n - 1) / 2) AS i, sum(n) AS n FROM ce GROUP BY ALL) JOIN ca USING ({keys}) JOIN cb USING ({keys}))"""


_PERM = """pm AS (SELECT [a, b, c, d] AS perm FROM (SELECT unnest(range(4))::INT AS a), (SELECT unnest(range(4))::INT AS b), (SELECT unnest(range(4))::INT AS c), (SELECT unnest(range(4))::INT AS d) WHERE len(list_distinct([a, b, c, d])) = 4),
ov AS (SELECT a.sample_id, b.seed, b.label AS cur, a.label AS ref, count(*) AS n FROM v_labels a JOIN v_labels b ON a.sample_id = b.sample_id AND a.spot = b.spot AND a.seed = 11 AND b.seed <> 11 GROUP BY ALL),
sc AS (SELECT sample_id, seed, perm, sum(n) AS s FROM ov JOIN pm ON perm[cur + 1] = ref GROUP BY ALL),
bp AS (SELECT sample_id, seed, perm FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, seed ORDER BY s DESC, perm) AS r FROM sc) WHERE r = 1),
al AS (SELECT sample_id, seed, i::INT AS cur, perm[i + 1] AS ref FROM bp, (SELECT unnest(range(4)) AS i))"""
_UNST = f"""{_PERM}, un AS (SELECT r.sample_id, r.spot, max((al.ref <> r.label)::INT) AS unstable, avg((al.ref <> r.label)::INT) AS diff_rate
  FROM v_labels r JOIN v_labels c ON c.sample_id = r.sample_id AND c.spot = r.spot AND r.seed = 11 AND c.seed <> 11 JOIN al ON al.sample_id = c.sample_id AND al.seed = c.seed AND al.cur = c.label GROUP BY ALL)"""
_SIG = f"""{_LN}, sg(signature_id, place, gene) AS (VALUES ('myeloid', 0, 1), ('myeloid', 1, 5), ('caf', 0, 7), ('caf', 1, 2), ('tcell', 0, 11), ('tcell', 1, 3), ('tcell', 2, 4)),
us AS (SELECT signature_id, count(*) AS k, string_agg('G' || gene, ',' ORDER BY place) AS genes_used FROM sg WHERE gene IN (SELECT gene FROM v_counts) GROUP BY 1),
ss AS (SELECT s.sample_id, s.spot, u.signature_id, coalesce(t, 0) / k AS score, genes_used FROM v_spots s CROSS JOIN us u LEFT JOIN (SELECT sample_id, spot, signature_id, sum(v) AS t FROM ln_ JOIN sg USING (gene) GROUP BY ALL) t ON t.sample_id = s.sample_id AND t.spot = s.spot AND t.signature_id = u.signature_id)"""
_GRAD = """gr AS (SELECT px, py, sqrt(gx * gx + gy * gy) AS grad FROM (SELECT px, py, coalesce((lead(gray) OVER (PARTITION BY py ORDER BY px) - lag(gray) OVER (PARTITION BY py ORDER BY px)) / 2, 0) AS gx,
  coalesce((lead(gray) OVER (PARTITION BY px ORDER BY py) - lag(gray) OVER (PARTITION BY px ORDER BY py)) / 2, 0) AS gy FROM v_pixels))"""
_AT = f"""{_GRAD}, at_ AS (SELECT sample_id, spot, px, py, grad FROM (SELECT sample_id, spot, greatest(0, least(mx, round_even((x + 1000) / 250, 0)::BIGINT)) AS px, greatest(0, least(my, round_even(y / 100, 0)::BIGINT)) AS py
  FROM v_spots, (SELECT max(px) AS mx, max(py) AS my FROM gr)) JOIN gr USING (px, py))"""
_UND = f"{_COH}, ue AS (SELECT DISTINCT sample_id, least(src, dst) AS a, greatest(src, dst) AS b FROM coh WHERE src <> dst)"
_GC = ", ".join(f"count(v) FILTER ({c}) AS n_{n}, avg(v) FILTER ({c}) AS mean_{n}, quantile_cont(v, 0.5) FILTER ({c}) AS median_{n}, avg((v > 0)::INT) FILTER ({c}) AS positive_{n}" for n, c in (("a", "NOT inside"), ("b", "inside")))


def _agree(edges: str, labels: str, keys: str) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"SELECT {', '.join('a.' + k for k in keys.split(', '))}, round(avg((a.label = b.label)::INT), 6) AS coherence, count(*) AS n_pairs FROM {edges} e JOIN {labels} a ON a.sample_id = e.sample_id AND a.spot = e.src JOIN {labels} b ON {on} AND b.spot = e.dst GROUP BY ALL"


_ATT = f"""{EMBEDDED_SQL},
ee AS (SELECT * FROM {_graph_sql('emb')} UNION ALL SELECT sample_id, spot, spot FROM emb),
es AS (SELECT e.sample_id, src, dst, b.f AS f, list_dot_product(a.f, {_LEFT * (SIZE // 4)}::DOUBLE[]) + list_dot_product(b.f, {_RIGHT * (SIZE // 4)}::DOUBLE[]) AS raw FROM ee e JOIN emb a ON a.sample_id = e.sample_id AND a.spot = src JOIN emb b ON b.sample_id = e.sample_id AND b.spot = dst),
ex AS (SELECT *, exp(s - max(s) OVER (PARTITION BY sample_id, src)) AS x FROM (SELECT *, CASE WHEN raw > 0 THEN raw ELSE 0.2::DOUBLE * raw END AS s FROM es)),
aw AS (SELECT *, x / sum(x) OVER (PARTITION BY sample_id, src) AS a FROM ex)"""

def _greedy_sql(k: int) -> str:
    """The greedy alignment, its rounds written out."""
    steps = ["g0 AS (SELECT a.sample_id, b.seed, b.label AS cur, a.label AS ref, count(*) AS n FROM v_labels a JOIN v_labels b ON a.sample_id = b.sample_id AND a.spot = b.spot AND a.seed = 11 AND b.seed <> 11 GROUP BY ALL)"]
    for i in range(k):
        steps.append(f"b{i} AS (SELECT sample_id, seed, cur, ref FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, seed ORDER BY n DESC, ref DESC, cur DESC) AS r FROM g{i}) WHERE r = 1)")
        steps.append(f"g{i + 1} AS (SELECT g.* FROM g{i} g JOIN b{i} b USING (sample_id, seed) WHERE g.cur <> b.cur AND g.ref <> b.ref)")
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(k))


_HM = f"{_LN}, {_L11}, m AS (SELECT l.sample_id, gene, l.label, coalesce(s, 0) / n AS mean FROM (SELECT sample_id, label, count(*) AS n FROM l11 GROUP BY ALL) l CROSS JOIN (SELECT DISTINCT gene FROM ln_ WHERE gene IN {tuple(_HEAT)}) g LEFT JOIN (SELECT sample_id, label, gene, sum(v) AS s FROM ln_ JOIN l11 USING (sample_id, spot) GROUP BY ALL) x USING (sample_id, label, gene)), hm AS (SELECT *, (mean - avg(mean) OVER (PARTITION BY sample_id, gene)) / (stddev_pop(mean) OVER (PARTITION BY sample_id, gene) + 0.000001::DOUBLE) AS z FROM m)"
_WIDE = "SELECT sample_id, gene, " + ", ".join(f"round(max(mean) FILTER (label = {x}), 6) AS domain_{x}_mean_log1p, round(max(z) FILTER (label = {x}), 6) AS domain_{x}_z" for x in range(4)) + " FROM hm GROUP BY 1, 2"

SQL = {
    "label_align_greedy": with_views(_greedy_sql(4), "labels"),
    "library_size": with_views("SELECT s.sample_id, s.spot, CASE WHEN coalesce(sum(n), 0) = 0 THEN 1 ELSE sum(n) END::BIGINT AS size FROM v_spots s LEFT JOIN v_counts c ON c.sample_id = s.sample_id AND c.spot = s.spot GROUP BY s.sample_id, s.spot", "spots", "counts"),
    "lognorm": with_views(f"WITH {_LN} SELECT sample_id, spot, gene, round(v, 6) AS v FROM ln_", "counts"),
    "hvg_select": with_views(f"WITH {_LN}, va AS (SELECT sample_id, gene, greatest(sum(v * v) / any_value(n) - (sum(v) / any_value(n)) * (sum(v) / any_value(n)), 0) AS variance FROM ln_ JOIN (SELECT sample_id, count(*) AS n FROM v_spots GROUP BY 1) USING (sample_id) GROUP BY 1, 2) SELECT sample_id, gene, round(variance, 6) AS variance, rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY variance DESC, gene DESC)::INT AS rank FROM va) WHERE rank <= 2000", "counts"),
    "coords_scaled": with_views("SELECT sample_id, spot, round((x - avg(x) OVER (PARTITION BY sample_id)) / (stddev_pop(x) OVER (PARTITION BY sample_id) + 0.000001::DOUBLE), 6) AS xs, round((y - avg(y) OVER (PARTITION BY sample_id)) / (stddev_pop(y) OVER (PARTITION BY sample_id) + 0.000001::DOUBLE), 6) AS ys FROM v_spots", "spots"),
    "spatial_features": with_views(f"WITH {EMBEDDED_SQL} SELECT sample_id, spot, (len(f) + 2)::INT AS n, round(f[1], 6) AS f0, round(0.5 * (x - avg(x) OVER (PARTITION BY sample_id)) / (stddev_pop(x) OVER (PARTITION BY sample_id) + 0.000001::DOUBLE), 6) AS fx, round(0.5 * (y - avg(y) OVER (PARTITION BY sample_id)) / (stddev_pop(y) OVER (PARTITION BY sample_id) + 0.000001::DOUBLE), 6) AS fy FROM emb", "spots"),
    "knn_exact": with_views(f"SELECT sample_id, spot, other, rank, round(d2, 6) AS d2 FROM ({_knn_sql('v_spots', 7)})", "spots"),
    "knn_rank2to7": with_views(f"WITH {_COH} SELECT * FROM coh", "spots"),
    "graph_symmetric": with_views(f"SELECT * FROM {_graph_sql('v_spots')}", "spots"),
    "edges_undirected": with_views(f"WITH {_UND} SELECT * FROM ue", "spots"),
    "edge_weights": with_views(f"WITH {EMBEDDED_SQL}, {WEIGHTS_SQL} SELECT sample_id, src, dst, round(w, 6) AS w FROM wt", "spots"),
    "boundary_mask": with_views(f"WITH {_L11} SELECT k.sample_id, k.spot, max((a.label <> b.label)::INT)::INT AS is_boundary FROM ({_knn_sql('v_spots', 6)}) k JOIN l11 a ON a.sample_id = k.sample_id AND a.spot = k.spot JOIN l11 b ON b.sample_id = k.sample_id AND b.spot = k.other GROUP BY k.sample_id, k.spot", "spots", "labels"),
    "neighbor_list_agreement": with_views(f"WITH {_L11}, le AS (SELECT a.sample_id, a.spot AS src, b.spot AS dst FROM v_spots a JOIN v_spots b ON a.sample_id = b.sample_id AND b.spot - a.spot IN (1, 5, -7)) {_agree('le', 'l11', 'sample_id')}", "spots", "labels"),
    "affinity_mass": with_views("SELECT a.sample_id, l, round(sum(exp(-((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / (2 * l * l))) / count(DISTINCT a.spot) - 1, 6) AS mass FROM v_spots a JOIN v_spots b ON a.sample_id = b.sample_id JOIN (SELECT unnest([100.0::DOUBLE, 250.0::DOUBLE]) AS l) ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 36 * l * l GROUP BY a.sample_id, l", "spots"),
    "graph_smooth": with_views(f"WITH {EMBEDDED_SQL}, {WEIGHTS_SQL} SELECT wt.sample_id, src AS spot, feature, round(sum(w * f[feature + 1]), 6) AS v FROM wt JOIN emb ON emb.sample_id = wt.sample_id AND emb.spot = dst, (SELECT unnest(range({SIZE}))::INT AS feature) GROUP BY ALL", "spots"),
    "edge_attention": with_views(f"WITH {_ATT} SELECT sample_id, src AS spot, part, round(sum(a * f[part + 1]), 6) AS v FROM aw, (SELECT unnest(range({SIZE}))::INT AS part) GROUP BY ALL", "spots"),
    "spatial_coherence": with_views(f"WITH {_COH} {_agree('coh', 'v_labels', 'sample_id, seed')}", "spots", "labels"),
    "marker_separation": with_views(f"WITH {_DIFF} SELECT sample_id, round(quantile_cont(mean, 0.5), 6) AS separation, count(*) AS n_clusters FROM tp WHERE top_n = 20 GROUP BY 1", "counts", "labels"),
    "marker_topn": with_views(f"WITH {_DIFF} SELECT sample_id, top_n::INT AS top_n, round(quantile_cont(mean, 0.5), 6) AS separation FROM tp GROUP BY 1, 2", "counts", "labels"),
    "marker_by_domain": with_views(f"WITH {_DIFF} SELECT sample_id, label, round(mean, 6) AS mean, round(most, 6) AS most FROM tp WHERE top_n = 20", "counts", "labels"),
    "ari": with_views(f"WITH {_ari_sql('SELECT a.sample_id, a.label AS la, b.label AS lb FROM v_labels a JOIN v_labels b ON a.sample_id = b.sample_id AND a.spot = b.spot AND a.seed = 11 AND b.seed = 23', 'sample_id')} SELECT sample_id, round(ari, 6) AS ari FROM ar", "labels"),
    "ari_seed_pairs": with_views("WITH " + _ari_sql("SELECT a.sample_id, a.seed || '_vs_' || b.seed AS pair, a.label AS la, b.label AS lb FROM v_labels a JOIN v_labels b ON a.sample_id = b.sample_id AND a.spot = b.spot AND a.seed < b.seed", "sample_id, pair") + " SELECT sample_id, pair, round(ari, 6) AS ari FROM ar", "labels"),
    "control_random_labels": with_views(f"""WITH {_COH}, rl AS (SELECT sample_id, spot, {hash_number_sql("'20260211|' || spot")} % 4 AS label FROM v_spots) {_agree('coh', 'rl', 'sample_id')}""", "spots"),
    "control_shuffled_coords": with_views(f"""WITH {_L11}, sh AS (SELECT a.sample_id, a.spot, b.x, b.y FROM (SELECT sample_id, spot, row_number() OVER (PARTITION BY sample_id ORDER BY spot) AS i FROM v_spots) a JOIN (SELECT sample_id, x, y, row_number() OVER (PARTITION BY sample_id ORDER BY {hash_number_sql("'20260211|' || spot")}, spot) AS i FROM v_spots) b USING (sample_id, i)),
sc AS (SELECT sample_id, spot AS src, other AS dst FROM ({_knn_sql('sh', 7)}) WHERE rank >= 2) {_agree('sc', 'l11', 'sample_id')}""", "spots", "labels"),
    "label_align": with_views(f"WITH {_PERM} SELECT sample_id, seed, cur, ref FROM al", "labels"),
    "unstable_spots": with_views(f"WITH {_UNST} SELECT sample_id, spot, unstable::INT AS unstable, round(diff_rate, 6) AS diff_rate FROM un", "labels"),
    "instability_summary": with_views(f"WITH {_UNST}, vl AS (SELECT sample_id, spot, x / 7 AS m1, y / 11 AS m2, CASE WHEN spot % 9 <> 0 THEN x / 13 END AS m3 FROM v_spots) SELECT sample_id, unstable::INT AS unstable, count(*) AS n, round(quantile_cont(m1, 0.5), 6) AS median_m1, round(quantile_cont(m2, 0.5), 6) AS median_m2, round(quantile_cont(m3, 0.5), 6) AS median_m3, round(quantile_cont(m1 + m2 + m3, 0.5), 6) AS median_sum FROM un JOIN vl USING (sample_id, spot) GROUP BY ALL", "labels"),
    "select_marker": "SELECT category, any_value(name ORDER BY place) AS marker FROM (SELECT category, c.name, place, p_name FROM (VALUES ('epithelial', 'none', 0), ('epithelial', 'red widget', 1), ('epithelial', 'blue bolt', 2), ('stromal', 'small ring', 0), ('immune', 'nothing', 0)) AS c(category, name, place) LEFT JOIN (SELECT DISTINCT p_name FROM part) ON p_name = c.name)".replace("any_value(name ORDER BY place)", "arg_min(name, place) FILTER (p_name IS NOT NULL)") + " GROUP BY category",
    "signature_score": with_views(f"WITH {_SIG} SELECT sample_id, spot, signature_id, round(score, 6) AS score, genes_used FROM ss", "counts"),
    "signature_contrast": with_views(f"WITH {_SIG} SELECT sample_id, spot, round(sum(CASE WHEN signature_id = 'tcell' THEN -score ELSE score END), 6) AS contrast FROM ss GROUP BY 1, 2", "counts"),
    "signature_seed_median": with_views(f"WITH {_SIG}, gp AS (SELECT ss.sample_id, signature_id, seed, avg(score) FILTER (label = 1) - avg(score) FILTER (label <> 1) AS dm FROM ss JOIN v_labels l ON l.sample_id = ss.sample_id AND l.spot = ss.spot GROUP BY ALL) SELECT sample_id, signature_id, round(quantile_cont(dm, 0.5), 6) AS median_delta FROM gp GROUP BY 1, 2", "counts", "labels"),
    "group_compare": with_views(f"WITH g AS (SELECT sample_id, {_GC} FROM (SELECT sample_id, segment = 'BUILDING' AS inside, x / 7 - 300 AS v FROM v_spots) GROUP BY 1) SELECT sample_id, n_a, n_b, {', '.join(f'round({m}_{s}, 6) AS {m}_{s}' for m in ('mean', 'median', 'positive') for s in 'ab')}, {', '.join(f'round({m}_b - {m}_a, 6) AS delta_{m}' for m in ('mean', 'median', 'positive'))} FROM g", "spots"),
    "domain_heatmap": with_views(f"WITH {_HM} SELECT sample_id, gene, label, round(mean, 6) AS mean, round(z, 6) AS z FROM hm", "counts", "labels"),
    "coord_label_join": with_views("SELECT a.sample_id, b.spot, a.spot % 4 AS label, a.spot AS origin FROM (SELECT *, CASE WHEN spot % 20 = 0 THEN x + 50000 ELSE x END AS mx FROM v_spots) a JOIN v_spots b ON a.sample_id = b.sample_id AND round_even(a.mx, 0)::BIGINT = round_even(b.x, 0)::BIGINT AND round_even(a.y, 0)::BIGINT = round_even(b.y, 0)::BIGINT", "spots"),
    "domain_heatmap_wide": with_views(f"WITH {_HM}, {_WIDE}", "counts", "labels"),
    "heatmap_guard": with_views(f"WITH {_LN}, n AS (SELECT sample_id, count(DISTINCT gene) FILTER (gene IN {tuple(_HEAT)} AND (sample_id <> 'ASIA' OR gene <= 5)) AS n_genes FROM ln_ WHERE sample_id <> 'ASIA' OR gene <= 5 GROUP BY 1) SELECT sample_id, n_genes, 'marker_genes' AS failure_type, 'too few marker genes found: ' || n_genes AS error_message FROM n WHERE n_genes < 8", "counts"),
    "boundary_guard": with_views(f"""WITH {_L11}, l2 AS (SELECT sample_id, spot, CASE sample_id WHEN 'ASIA' THEN 0 WHEN 'EUROPE' THEN (spot % 400 = 7)::INT ELSE label END AS label FROM l11),
b AS (SELECT k.sample_id, k.spot, max((a.label <> b.label)::INT) AS o FROM ({_knn_sql('v_spots', 6)}) k JOIN l2 a ON a.sample_id = k.sample_id AND a.spot = k.spot JOIN l2 b ON b.sample_id = k.sample_id AND b.spot = k.other GROUP BY 1, 2),
n AS (SELECT sample_id, count(*) FILTER (o = 1) AS n_boundary, count(*) FILTER (o = 0) AS n_interior FROM b GROUP BY 1)
SELECT *, CASE WHEN least(n_boundary, n_interior) < 10 THEN 'too few boundary or interior spots: ' || n_boundary || ' and ' || n_interior END AS error_message FROM n""", "spots", "labels"),
    "coord_guard": with_views("""WITH p AS (SELECT DISTINCT sample_id, round_even(CASE WHEN spot % CASE sample_id WHEN 'ASIA' THEN 19 ELSE 25 END = 0 THEN x + 50000 ELSE x END, 0)::BIGINT AS ix, round_even(y, 0)::BIGINT AS iy FROM v_spots),
n AS (SELECT s.sample_id, count(*) AS n_spots, count(p.ix) AS n_matched FROM v_spots s LEFT JOIN p ON p.sample_id = s.sample_id AND p.ix = round_even(s.x, 0)::BIGINT AND p.iy = round_even(s.y, 0)::BIGINT GROUP BY 1)
SELECT *, CASE WHEN n_matched < floor(0.95::DOUBLE * n_spots) THEN 'label match rate too low: ' || n_matched || ' of ' || n_spots END AS error_message FROM n""", "spots"),
    "edge_failures": with_views("SELECT DISTINCT sample_id, 'no_edges' AS failure_type, 'the graph has no edges' AS error_message FROM v_spots WHERE sample_id = 'ASIA'", "spots"),
    "image_gradient": with_views(f"WITH {_GRAD} SELECT px, py, round(grad, 6) AS grad FROM gr", "pixels"),
    "gradient_at_spots": with_views(f"WITH {_AT} SELECT sample_id, spot, px, py, round(grad, 6) AS grad FROM at_", "pixels", "spots"),
    "edge_alignment": with_views(f"""WITH {_AT}, {_UND}, {_L11}, sv AS (SELECT l.sample_id, l.spot, label, CASE WHEN l.sample_id <> 'ASIA' THEN grad END AS g FROM l11 l LEFT JOIN at_ ON at_.sample_id = l.sample_id AND at_.spot = l.spot),
n AS (SELECT sample_id, count(*) AS n_spots, count(g) AS nv FROM sv GROUP BY 1), e AS (SELECT ue.sample_id, ue.a, ue.b, x.label <> y.label AS c, (x.g + y.g) / 2 AS g FROM ue JOIN sv x ON x.sample_id = ue.sample_id AND x.spot = ue.a JOIN sv y ON y.sample_id = ue.sample_id AND y.spot = ue.b),
ea AS (SELECT sample_id, count(*) AS n_edges, sum(c::INT)::BIGINT AS n_boundary_edges, avg(g) FILTER (c) AS edge_boundary, avg(g) FILTER (NOT c) AS edge_within FROM e GROUP BY 1),
bs AS (SELECT sample_id, spot, max(c::INT) AS o FROM (SELECT sample_id, a AS spot, c FROM e UNION ALL SELECT sample_id, b, c FROM e) GROUP BY 1, 2),
sp AS (SELECT sv.sample_id, avg(g) FILTER (o = 1) AS spot_boundary, avg(g) FILTER (coalesce(o, 0) = 0) AS spot_interior FROM sv LEFT JOIN bs ON bs.sample_id = sv.sample_id AND bs.spot = sv.spot GROUP BY 1)
SELECT sample_id, n_spots, n_edges, n_boundary_edges, round(edge_boundary, 6) AS edge_boundary, round(edge_within, 6) AS edge_within, round(edge_boundary - edge_within, 6) AS delta_edge, round(spot_boundary, 6) AS spot_boundary, round(spot_interior, 6) AS spot_interior, round(spot_boundary - spot_interior, 6) AS delta_spot, CASE WHEN nv > 0 THEN 'ok' ELSE 'missing_image' END AS status FROM n JOIN ea USING (sample_id) JOIN sp USING (sample_id) WHERE n_spots >= 50""", "pixels", "spots", "labels"),
    "patch_features": with_views("""WITH sz AS (SELECT max(px) AS mx, max(py) AS my FROM v_pixels), c AS (SELECT sample_id, spot, round_even((x + 1000) / 250, 0)::BIGINT AS cx, round_even(y / 100, 0)::BIGINT AS cy FROM v_spots),
p AS (SELECT sample_id, spot, px, py, gray FROM c, sz, v_pixels WHERE cx >= 0 AND cy >= 0 AND cx <= mx AND cy <= my AND abs(px - cx) <= 24 AND abs(py - cy) <= 24),
g AS (SELECT *, lead(gray) OVER (PARTITION BY sample_id, spot, py ORDER BY px) - lag(gray) OVER (PARTITION BY sample_id, spot, py ORDER BY px) AS gx, lead(gray) OVER (PARTITION BY sample_id, spot, px ORDER BY py) - lag(gray) OVER (PARTITION BY sample_id, spot, px ORDER BY py) AS gy FROM p)
SELECT sample_id, spot, count(*) AS n_pixels, (2 * sum((gray * 1000000)::DECIMAL(18,0))::HUGEINT + count(*)) // (2 * count(*)) / 1000000.0::DOUBLE AS gray_mean, round(stddev_pop(gray), 6) AS gray_sd, round(avg(sqrt(gx * gx + gy * gy)), 6) AS grad_mean, round(quantile_cont(sqrt(gx * gx + gy * gy), 0.95), 6) AS grad_q95 FROM g GROUP BY 1, 2 HAVING count(*) >= 25""", "pixels", "spots"),
}
# the names under which earlier versions registered the whole tables and vectors
WHOLE = ("library_size", "hvg_select", "graph_smooth", "edge_attention", "patch_features")
QUERIES |= {f"{n}_whole": QUERIES[n] for n in WHOLE}
SQL |= {f"{n}_whole": SQL[n] for n in WHOLE}
