"""The driver's tables seen as spots, counts, labels, run ledger and pixels.

Each view is one SQL text that Spark and the oracle engine both read; braces
name other views or tables. Only ``counts`` is made in Spark by a plan of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

VIEWS = {
    # a region is a sample: statistical views use the nation instead
    "spots": """SELECT r_name AS dataset_id, r_name AS sample_id, c_custkey AS spot, c_acctbal AS x,
        CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS y, n_name AS nation, c_mktsegment AS segment
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "counts": """SELECT s.sample_id, o.o_custkey AS spot, l.l_partkey % 150 AS gene, CAST(SUM(l.l_quantity) AS BIGINT) AS n
        FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey JOIN {spots} s ON s.spot = o.o_custkey
        GROUP BY s.sample_id, o.o_custkey, l.l_partkey % 150""",
    "features": "SELECT p_partkey AS gene, p_name AS name, p_brand AS brand, p_type AS kind FROM {part}",
    "labels": """SELECT sample_id, spot, 11 AS seed, l AS label FROM {label11}
        UNION ALL SELECT sample_id, spot, 23 AS seed, CASE WHEN spot % 11 = 0 THEN (l + 1) % 4 ELSE l END AS label FROM {label11}
        UNION ALL SELECT sample_id, spot, 37 AS seed, (CASE WHEN spot % 11 = 0 THEN l + 2 ELSE l + 1 END + CASE WHEN spot % 13 = 0 THEN 1 ELSE 0 END) % 4 AS label FROM {label11}""",
    "label11": "SELECT sample_id, spot, GREATEST(0, LEAST(3, CAST(FLOOR((x + 1000) / 2750) AS INT))) AS l FROM {spots}",
    "ledger": """SELECT CASE user_id % 3 WHEN 0 THEN 'D0' WHEN 1 THEN 'D1' ELSE 'D2' END AS dataset_id, CAST(user_id AS VARCHAR(20)) AS sample_id,
        event_type AS method_id, CASE WHEN user_id % 2 = 0 THEN 4 ELSE 6 END AS K, CAST(event_id % 4 + 1 AS INT) AS seed_count,
        CASE event_id % 3 WHEN 0 THEN 'rigor-backfill run' WHEN 1 THEN 'stage3b-full-replication' ELSE 'draft' END AS notes,
        value / 97.0E0 AS coherence, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value / 131.0E0 END AS marker,
        CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'success' END AS status, value AS wall_time_sec, 40 * value AS peak_rss_mb,
        ts AS started, props, event_id AS ingest_seq FROM {events}""",
    "pixels": "SELECT p_partkey % 40 AS px, CAST(FLOOR(p_partkey / 40.0E0) AS BIGINT) AS py, p_retailprice + 7.0E0 * ((p_partkey * 31) % 17) AS gray FROM {part}",
    # one baseline of the families, M4, has no rows
    "paired": """SELECT sample_id, method_id, K, AVG(acctbal / 10000.0E0) AS coherence, AVG((custkey * 37 % 1009) / 1009.0E0) AS marker FROM (
        SELECT n_name AS sample_id, c_acctbal AS acctbal, c_custkey AS custkey, CASE WHEN c_custkey % 2 = 0 THEN 4 ELSE 6 END AS K,
        CASE FLOOR(c_custkey / 2.0E0) % 6 WHEN 0 THEN 'focal' WHEN 1 THEN 'M5' WHEN 2 THEN 'M0' WHEN 3 THEN 'M1' WHEN 4 THEN 'M2' ELSE 'M3' END AS method_id
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey) GROUP BY sample_id, method_id, K""",
}


def _needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


#: Order lines that one task is meant to take.
PER_TASK = 500_000


def tasks_for(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for the order lines: as many as their number asks for, and for few lines no more than the session's."""
    n = view(spark, sf_dir, "lineitem").count()
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-n // PER_TASK), min(usual, n // 20_000))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view ``counts``, dealt by spot to tasks whose number grows with the lines, so that a task's share does not."""
    n = tasks_for(spark, sf_dir)
    spots = view(spark, sf_dir, "spots").select("sample_id", "spot").repartition(n, "spot")
    orders = view(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("spot")).repartition(n, "spot").join(spots, "spot")
    lines = view(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") % 150).alias("gene"), "l_quantity")
    rows = lines.repartition(n, "o_orderkey").join(orders.repartition(n, "o_orderkey"), "o_orderkey")
    return rows.repartition(n, "sample_id", "spot").groupBy("sample_id", "spot", "gene").agg(F.sum("l_quantity").cast("bigint").alias("n"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame."""
    if name == "counts":
        return _counts(spark, sf_dir)
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    return spark.sql(text, **{x: view(spark, sf_dir, x) for x in _needs(text)})


def with_views(body: str, *names: str) -> str:
    """``body`` after the definitions of the named views, as one SQL text for the oracle."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in TABLES and name not in order:
            for x in _needs(VIEWS[name]):
                add(x)
            order.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"v_{n} AS ({re.sub(chr(123) + r'(\w+)' + chr(125), lambda m: m[1] if m[1] in TABLES else f'v_{m[1]}', VIEWS[n])})" for n in order)
    joined = f"WITH {ctes}" if ctes else ""
    if body.lstrip().upper().startswith("WITH "):
        return f"{joined},\n{body.lstrip()[5:]}" if joined else body
    return f"{joined}\n{body}"
