"""Every query with SQL gives the rows that DuckDB gives."""

import datetime
import os

import pytest

from quillframe.plans import catalogue

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float) or hasattr(v, "quantize"):
        return round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows(spark, db, name):
    df = catalogue.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = ordered([r[c] for c in names] for r in df.collect())
    sql = db.sql(catalogue.ORACLE[name])
    assert sorted(sql.columns) == names
    at = [sql.columns.index(c) for c in names]
    assert got == ordered([r[i] for i in at] for r in sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() >= 0


def test_flagship(spark):
    assert catalogue.flagship(spark, DATA).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
