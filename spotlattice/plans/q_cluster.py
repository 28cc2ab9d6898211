"""Queries of the clustering operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotlattice.functions.expr import r6
from spotlattice.operators import cluster as C
from spotlattice.operators import graph as G
from spotlattice.operators import normalize as N
from spotlattice.operators.lineage import cut
from spotlattice.plans.q_graph import EMBEDDED_SQL, WEIGHTS_SQL
from spotlattice.plans.views import view, with_views

K = "sample_id"
_SEEDS = ((11, 0), (23, 1), (37, 2))


def _points(spark, d, size=None):
    e = view(spark, d, "embeddings")
    f = F.col("embedding").cast("array<double>")
    e = e.select(F.col("vec_id").alias("spot"), (F.slice(f, 1, size) if size else f).alias("f"), F.col("label").alias("known"))
    return view(spark, d, "spots").select(K, "spot", "x", "y").join(e, "spot")


def _labels(spark, d):
    return view(spark, d, "labels")


#: Components of a vector.
SIZE = 64


def _start(spark, d, size=SIZE):
    """The vectors with known label below 4 give the first centroids of each sample."""
    p = _points(spark, d, size).filter("known < 4")
    return p.groupBy(K, F.col("known").alias("label")).agg(C._mean("f", size).alias("f"))


def kmeans_assign(spark, d, size=SIZE):
    return C.kmeans_assign(_points(spark, d, size), _start(spark, d, size)).select(K, "spot", "label", r6(F.col("d2")).alias("d2"))


def kmeans_update(spark, d, size=SIZE):
    p = _points(spark, d, size)
    out = C.kmeans_update(p, C.kmeans_assign(p, _start(spark, d, size)), size)
    return out.select(K, "label", *(r6(F.col("f")[i]).alias(f"f{i}") for i in range(size)))


def _plan(spark):
    return spark.createDataFrame([(k, seed) for k in (4, 6) for seed, _ in _SEEDS], "K int, seed int")


def kmeans_fit(spark, d):
    """Per sample, K and seed: inertia and number of labels, and whether the best start converged."""
    _, best = C.kmeans_fit(_points(spark, d), _plan(spark), SIZE)
    return best.select(K, "K", "seed", r6(F.col("inertia")).alias("inertia"), "n_labels", "converged")


def kmeans_fit_spatial(spark, d):
    p = _points(spark, d)
    f = N.spatial_features(p.select(K, "spot", "f"), N.coords_scaled(p).select(K, "spot", "xs", "ys"))
    _, best = C.kmeans_fit(f, _plan(spark), SIZE + 2)
    return best.select(K, "K", "seed", r6(F.col("inertia")).alias("inertia"), "n_labels", "converged")


def _coarse(spark, d):
    s = view(spark, d, "spots").select(K, (F.col("spot") % 12).alias("id"), (F.col("x") / 1000).alias("a"), (F.col("y") / 1000).alias("b"))
    return s.groupBy(K, "id").agg(F.count(F.lit(1)).alias("n"), F.array(F.avg("a"), F.avg("b")).alias("f"))


def ward_round(spark, d):
    c = _coarse(spark, d)
    near = c.select(K, F.col("id").alias("a")).withColumn("b", F.explode(F.array(*(F.col("a") + i for i in (1, 2, 3))))).filter("b < 12")
    return C.ward_round(C.ward_costs(c, near)).withColumn("cost", r6(F.col("cost")))


def ward_fit(spark, d):
    """Per sample the number of labels and of spots after merging 6-neighbour graphs down to 4 clusters."""
    p = view(spark, d, "spots").select(K, "spot", "x", "y").withColumn("f", F.array(F.col("x") / 1000, F.col("y") / 1000))
    edges = G.undirected(G.symmetric_graph(G.knn(p, 6), p))
    out = C.ward_fit(p, edges, 4, 2)
    return out.groupBy(K).agg(F.countDistinct("label").alias("n_labels"), F.count(F.lit(1)).alias("n_spots"))


def _weights(spark, d):
    p = _points(spark, d)
    return G.edge_weights(G.symmetric_graph(G.knn(p, 6), p), p)


def rb_modularity(spark, d):
    labels = _labels(spark, d).filter("seed = 11").select(K, "spot", "label")
    return C.rb_modularity(_grid(spark, d), labels, 1.0).withColumn("modularity", r6(F.col("modularity")))


def _grid(spark, d):
    """Edges between spots whose numbers differ by 5 or 10 in the same sample, weighted by segment agreement."""
    s = view(spark, d, "spots").select(K, "spot", "segment")
    e = s.select(K, F.col("spot").alias("src"), F.col("segment").alias("sa"), F.explode(F.array(F.col("spot") + 5, F.col("spot") + 10)).alias("dst"))
    return e.join(s.select(K, F.col("spot").alias("dst"), F.col("segment").alias("sb")), [K, "dst"]).select(K, "src", "dst", F.when(F.col("sa") == F.col("sb"), 1.0).otherwise(0.25).alias("w"))


def community_fit(spark, d):
    """Per sample and resolution: spots, and whether there are several communities, each connected, that beat one community for all."""
    e = cut(_weights(spark, d))
    out = cut(C.community_fit(e, [0.5, 1.0]))
    found = out.groupBy(K, "gamma").agg(F.count_distinct("label").alias("n_labels"), F.count(F.lit(1)).alias("n_spots"))
    # one community for all has the inner weight m less gamma (2m)^2 / 4m
    total = e.groupBy(K).agg(F.sum("w").alias("m"))
    scores = [C.rb_modularity(e, out.filter(F.col("gamma") == g), g).withColumn("gamma", F.lit(g)) for g in (0.5, 1.0)]
    beats = scores[0].unionByName(scores[1]).join(total, K).select(K, "gamma", (F.col("modularity") > F.col("m") * (1 - F.col("gamma"))).alias("beats_one"))
    at = lambda c, name: out.select(K, "gamma", F.col("spot").alias(c), F.col("label").alias(name))
    inner = e.join(at("src", "a"), [K, "src"]).join(at("dst", "b"), [K, "gamma", "dst"]).filter("a = b")
    both = inner.select(K, "gamma", F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(inner.select(K, "gamma", F.col("dst").alias("node"), F.col("src").alias("other")))
    pieces = G.components(both, out.select(K, "gamma", F.col("spot").alias("node")), [K, "gamma"]).groupBy(K, "gamma").agg(F.count_distinct("part").alias("n_pieces"))
    return found.join(beats, [K, "gamma"]).join(pieces, [K, "gamma"]).select(K, "gamma", "n_spots", (F.col("n_labels") > 1).alias("several"), (F.col("n_labels") == F.col("n_pieces")).alias("connected"), "beats_one")


def resolution_select(spark, d):
    return _selected(view(spark, d, "customer"))


def _selected(customers):
    c = customers.select((F.col("c_nationkey") % 5).cast("string").alias(K), (F.col("c_custkey") / 100.0).alias("gamma"), (F.col("c_custkey") % 23 + 2).alias("n_labels"), F.col("c_custkey").alias("place"))
    return C.resolution_select(c, 6).select(K, r6(F.col("gamma")).alias("gamma"), "n_labels", "exact")


def resolution_search(spark, d):
    """Per sample the resolution whose communities number 6, or come nearest, of measured label counts, and its spots."""
    choice, labels = C.resolution_search(_weights(spark, d), 6)
    n = labels.groupBy(K, "gamma").agg(F.count(F.lit(1)).alias("n_spots"))
    return choice.join(n, [K, "gamma"]).select(K, r6(F.col("gamma")).alias("gamma"), "n_labels", "exact", "n_spots")


def _soft(spark, d, size=SIZE):
    p = _points(spark, d, size)
    centroids = p.filter("known < 4").groupBy(F.col("known").alias("label")).agg(C._mean("f", size).alias("f"))
    return C.soft_assign(p, centroids)


def dec_soft_assign(spark, d, size=SIZE):
    return _soft(spark, d, size).select(K, "spot", "label", r6(F.col("q")).alias("q"), r6(F.col("p")).alias("p"))


def dec_kl(spark, d, size=SIZE):
    return C.kl(_soft(spark, d, size)).withColumn("kl", r6(F.col("kl")))


def label_change_rate(spark, d):
    l = _labels(spark, d)  # noqa: E741
    return C.change_rate(l.filter("seed = 11"), l.filter("seed = 23")).withColumn("rate", r6(F.col("rate")))


def exact_k_check(spark, d):
    return C.exact_k_failures(_labels(spark, d).filter("NOT (seed = 23 AND sample_id = 'ASIA' AND label = 2)"), 4)


def _requested(spark):
    return spark.createDataFrame(list(_SEEDS), "seed int, place int")


def run_plan(spark, d):
    methods = view(spark, d, "ledger").select("method_id").distinct().withColumn("n_seeds", F.when(F.col("method_id") == "view", 1).when(F.col("method_id") == "click", 2))
    return C.run_plan(methods, view(spark, d, "ledger").select("K").distinct(), _requested(spark))


def reference_seed(spark, d):
    runs = view(spark, d, "ledger").withColumn("seed", F.when(F.col("ingest_seq") % 7 == 0, 11).when(F.col("ingest_seq") % 7 < 3, 23).otherwise(F.col("ingest_seq") % 5).cast("int"))
    return C.reference_seed(runs, _requested(spark), ("sample_id", "method_id"))


def domain_map_import(spark, d):
    s = view(spark, d, "spots").join(_labels(spark, d).filter("seed = 11"), [K, "spot"])
    raw = s.select("dataset_id", K, F.lit("ext").alias("method_id"), F.lit("4").alias("K"), F.concat(F.lit("BC-"), "spot").alias("barcode"), F.col("x").cast("string").alias("x"), F.col("label").cast("string").alias("domain_label"))
    good, _ = C.import_domain_map(raw)
    return good.select("dataset_id", K, "method_id", "K", "barcode", "x", "domain_label")


def domain_map_export(spark, d):
    labels = _labels(spark, d).select(K, "spot", "seed", "label")
    reference = labels.select(K).distinct().withColumn("reference_seed", F.when(F.col(K) == "ASIA", 37).otherwise(11))
    return C.export_domain_map(labels, view(spark, d, "spots"), reference)


QUERIES = {f.__name__: f for f in (
    kmeans_assign, kmeans_update, kmeans_fit, kmeans_fit_spatial, ward_round, ward_fit, rb_modularity, community_fit, resolution_select, resolution_search, dec_soft_assign,
    dec_kl,
    label_change_rate, exact_k_check, run_plan, reference_seed, domain_map_import, domain_map_export,
)}

_EMB = "emb AS (SELECT sample_id, spot, embedding::DOUBLE[] AS f, label AS known FROM v_spots JOIN embeddings ON vec_id = spot)"
_MEANS = ", ".join(f"avg(f[{i}]) AS c{i}" for i in range(1, SIZE + 1))
_D2 = " + ".join(f"(f[{i}] - c{i}) * (f[{i}] - c{i})" for i in range(1, SIZE + 1))
_ROUNDED = ", ".join(f"round(avg(f[{i + 1}]), 6) AS f{i}" for i in range(SIZE))
_ASSIGN = f"""{_EMB}, ct AS (SELECT sample_id, known AS label, {_MEANS} FROM emb WHERE known < 4 GROUP BY ALL),
ag AS (SELECT sample_id, spot, label, d2, f FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, spot ORDER BY d2, label) AS r FROM (SELECT emb.sample_id, spot, label, f, {_D2} AS d2 FROM emb JOIN ct USING (sample_id))) WHERE r = 1)"""
_SOFT = f"""{_EMB}, ct AS (SELECT known AS label, {_MEANS} FROM emb WHERE known < 4 GROUP BY ALL),
q0 AS (SELECT sample_id, spot, label, pow(1 / (1 + ({_D2}) / 0.2::DOUBLE + 0.00000001::DOUBLE), 0.6::DOUBLE) AS raw FROM emb, ct),
q1 AS (SELECT sample_id, spot, label, raw / sum(raw) OVER (PARTITION BY sample_id, spot) AS q FROM q0), q2 AS (SELECT *, q * q / sum(q) OVER (PARTITION BY sample_id, label) AS t FROM q1),
so AS (SELECT *, t / sum(t) OVER (PARTITION BY sample_id, spot) AS p FROM q2)"""
SQL = {
    "kmeans_assign": with_views(f"WITH {_ASSIGN} SELECT sample_id, spot, label, round(d2, 6) AS d2 FROM ag", "spots"),
    "kmeans_update": with_views(f"WITH {_ASSIGN} SELECT sample_id, label, {_ROUNDED} FROM ag GROUP BY 1, 2", "spots"),
    "ward_round": with_views("""WITH c AS (SELECT sample_id, spot % 12 AS id, count(*) AS n, avg(x / 1000) AS a, avg(y / 1000) AS b FROM v_spots GROUP BY 1, 2),
co AS (SELECT p.sample_id, p.id AS x, q.id AS y, p.n * q.n / (p.n + q.n) * ((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)) AS cost FROM c p JOIN c q ON p.sample_id = q.sample_id AND p.id <> q.id AND abs(p.id - q.id) <= 3),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, x ORDER BY cost, y) AS r FROM co) WHERE r = 1)
SELECT m.sample_id, m.x AS a, m.y AS b, round(m.cost, 6) AS cost FROM be m JOIN be o ON m.sample_id = o.sample_id AND m.x = o.y AND m.y = o.x WHERE m.x < m.y""", "spots"),
    "rb_modularity": with_views("""WITH l AS (SELECT sample_id, spot, label FROM v_labels WHERE seed = 11), e AS (SELECT a.sample_id, a.spot AS src, b.spot AS dst, CASE WHEN a.segment = b.segment THEN 1.0 ELSE 0.25 END::DOUBLE AS w FROM v_spots a JOIN v_spots b ON a.sample_id = b.sample_id AND b.spot - a.spot IN (5, 10)),
st AS (SELECT sample_id, label, sum(w) AS s FROM (SELECT sample_id, src AS spot, w FROM e UNION ALL SELECT sample_id, dst, w FROM e) JOIN l USING (sample_id, spot) GROUP BY 1, 2),
i AS (SELECT e.sample_id, sum(w) FILTER (a.label = b.label) AS inner_w, sum(w) AS m FROM e JOIN l a ON a.sample_id = e.sample_id AND a.spot = src JOIN l b ON b.sample_id = e.sample_id AND b.spot = dst GROUP BY 1)
SELECT sample_id, round(coalesce(any_value(inner_w), 0) - sum(s * s) / (4 * any_value(m)), 6) AS modularity FROM st JOIN i USING (sample_id) GROUP BY 1""", "spots", "labels"),
    "community_fit": with_views(f"WITH {EMBEDDED_SQL}, {WEIGHTS_SQL}, t AS (SELECT sample_id, src AS spot FROM wt UNION SELECT sample_id, dst FROM wt) SELECT sample_id, gamma, count(*) AS n_spots, true AS several, true AS connected, true AS beats_one FROM t, (SELECT unnest([0.5::DOUBLE, 1.0::DOUBLE]) AS gamma) GROUP BY 1, 2", "spots"),
    "ward_fit": with_views("SELECT sample_id, least(4, count(*)) AS n_labels, count(*) AS n_spots FROM v_spots GROUP BY 1", "spots"),
    "resolution_select": """SELECT sample_id, round(gamma, 6) AS gamma, n_labels, n_labels = 6 AS exact FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY abs(n_labels - 6), CASE WHEN n_labels = 6 THEN place ELSE 0 END, gamma) AS r
FROM (SELECT (c_nationkey % 5)::VARCHAR AS sample_id, c_custkey / 100.0::DOUBLE AS gamma, c_custkey % 23 + 2 AS n_labels, c_custkey AS place FROM customer)) WHERE r = 1""",
    "dec_soft_assign": with_views(f"WITH {_SOFT} SELECT sample_id, spot, label, round(q, 6) AS q, round(p, 6) AS p FROM so", "spots"),
    "dec_kl": with_views(f"WITH {_SOFT} SELECT sample_id, round(avg(dd), 6) AS kl FROM (SELECT sample_id, spot, sum(p * ln(p / (q + 0.000001::DOUBLE))) AS dd FROM so GROUP BY 1, 2) GROUP BY 1", "spots"),
    "label_change_rate": with_views("SELECT sample_id, round(avg((a.label <> b.label)::INT), 6) AS rate, avg((a.label <> b.label)::INT) < 0.005 AS stop FROM v_labels a JOIN v_labels b USING (sample_id, spot) WHERE a.seed = 11 AND b.seed = 23 GROUP BY 1", "labels"),
    "exact_k_check": with_views("SELECT sample_id, seed, count(DISTINCT label) AS n_labels, 'exact_k' AS failure_type, 'expected 4 labels, found ' || count(DISTINCT label) AS error_message FROM v_labels WHERE NOT (seed = 23 AND sample_id = 'ASIA' AND label = 2) GROUP BY 1, 2 HAVING count(DISTINCT label) <> 4", "labels"),
    "run_plan": with_views("SELECT method_id, K, seed::INT AS seed FROM (SELECT DISTINCT method_id FROM v_ledger), (SELECT DISTINCT K FROM v_ledger), (VALUES (11, 1), (23, 2), (37, 3)) AS s(seed, r) WHERE r <= CASE method_id WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END", "ledger"),
    "reference_seed": with_views("SELECT sample_id, method_id, coalesce(arg_min(seed, CASE seed WHEN 11 THEN 0 WHEN 23 THEN 1 WHEN 37 THEN 2 END), min(seed))::INT AS reference_seed FROM (SELECT *, CASE WHEN ingest_seq % 7 = 0 THEN 11 WHEN ingest_seq % 7 < 3 THEN 23 ELSE ingest_seq % 5 END AS seed FROM v_ledger WHERE status = 'success') GROUP BY 1, 2", "ledger"),
    "domain_map_import": with_views("SELECT dataset_id, s.sample_id, 'ext' AS method_id, 4::INT AS K, 'BC-' || spot AS barcode, x, label::INT AS domain_label FROM v_spots s JOIN v_labels l USING (sample_id, spot) WHERE seed = 11 AND label >= 1", "spots", "labels"),
    "domain_map_export": with_views("SELECT l.sample_id, seed, spot, x, y, label + 1 AS domain_label FROM v_labels l JOIN v_spots s USING (sample_id, spot) WHERE seed = CASE WHEN l.sample_id = 'ASIA' THEN 37 ELSE 11 END", "spots", "labels"),
}
# the names under which earlier versions registered the whole vectors and tables
WHOLE = ("kmeans_assign", "kmeans_update", "dec_soft_assign", "dec_kl", "resolution_select")
QUERIES |= {f"{n}_whole": QUERIES[n] for n in WHOLE}
SQL |= {f"{n}_whole": SQL[n] for n in WHOLE}
