"""Every query with an oracle gives the oracle's rows, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from spotlattice import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
#: Samples of about 30 spots: converging fits are tested on small fixtures instead.
SLOW = {"ward_fit", "community_fit", "kmeans_fit", "kmeans_fit_spatial", "pca_variance", "bandwidth_search"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def shown(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if isinstance(v, float) or v is None or v is pd.NA or v is pd.NaT:
            return "null" if pd.isna(v) else repr(float(v) + 0.0)
        return str(v)

    df = df[sorted(df.columns)].astype(object)
    ints = {c for c in df.columns if not df[c].dropna().map(lambda v: isinstance(v, (bool, str))).any() and df[c].dropna().map(lambda v: float(v).is_integer()).all()}
    return sorted(tuple(("null" if pd.isna(v) else str(int(v))) if c in ints else one(v) for c, v in zip(df.columns, row)) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql())))
def test_matches_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, DIR).toPandas()
    want = pd.DataFrame(duck.sql(catalog.oracle_sql()[name]).df())
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got) == shown(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DIR).count() > 0
