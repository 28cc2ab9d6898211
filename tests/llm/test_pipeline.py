"""The pipeline's run against plain versions of its stages."""

import corpus_pipeline
from pyspark.sql import functions as F
from spotlattice.llm import pieces, pii, quality
from tests.llm.test_ops import components, shingle_sets

DIR = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    found = components(sorted(text.items()))
    text = {i: t for i, t in text.items() if found[i][1] == i}
    items = [shingle_sets(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    clean = {i: t for i, t in text.items() if not any(100 * len(s & shingle_sets(t)) >= 75 * len(s) for s in items if s)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DIR).collect()}
    assert set(got) == set(clean) and len(clean) < len(text) and all(r.round_trip for r in got.values())
    e = pieces.encoder(pieces.vocabulary())
    for i, t in clean.items():
        base = pii.base_spans(t)
        if not base and not pii._ASK.search(t):
            assert e.decode(__import__("numpy").array(got[i].ids)) == t.replace("▁", " ")
        else:
            shown = e.decode(__import__("numpy").array(got[i].ids))
            assert not pii.base_spans(shown)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("b", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "b"]
    assert docs.count() > 0


def test_stages_on_odd_tables(spark):
    base = "The cat and the dog went to the market in the morning, and it was a good day for all of them at home."
    rows = [(1, None), (2, ""), (3, "one two"), (4, base), (4, base), (4, base + " Call +1 212 555 0147."), (None, base), (None, None), (9, "The house of the old man is on the hill by the sea, and it was built in the year of the great storm. " * 900)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key int, row string, kept_id int, h int"
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "r", 2, 3) for i, t in rows], schema)
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
        assert docs.columns == odd.columns
    assert sorted((r.doc_id, r.key) for r in docs.collect()) == [(4, 1)]
    docs = corpus_pipeline.near_duplicates(spark, odd, DIR)
    assert sorted((r.doc_id or 0, (r.text or "")[:7]) for r in docs.collect()) == [(0, ""), (1, ""), (2, ""), (3, "one two"), (4, "The cat"), (9, "The hou")]
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        assert docs.count() == 0
