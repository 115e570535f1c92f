import os

import duckdb
import pytest

import __spark_entry__
from verisift.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, db, name):
    a, b = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = lambda d: sorted(map(tuple, d[cols].astype(str).values.tolist()))
    assert rows(a) == rows(b)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_planned_query_asks_for_all_entities(spark, db):
    got = {r.entity for r in QUERIES["planned_query"](spark, SF).collect()}
    assert got == {r[0] for r in db.execute(f"SELECT entity FROM ({ORACLES['two_step_query']})").fetchall()} and max(got) > 5


def test_profile_of_blank_texts(spark, tmp_path):
    rows = [("a", "x"), ("a", ""), ("a", "  "), ("a", None), ("b", "y")]
    spark.createDataFrame(rows, "source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["profile_all_sources"](spark, str(tmp_path)).collect())
    assert got == [("a", 4, 1, 0.75), ("b", 1, 1, 0.0)]
