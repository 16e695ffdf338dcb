"""Every named query of the library against its SQL, on the smallest tables."""

import math
import os
import sys
import zipfile

import duckdb
import pytest

import __spark_entry__
from speechgrain.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations", "clicks", "sales", "sale_lines", "clients", "client_changes", "vendors", "items", "stamps")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def same(spark, db, name, query, sql):
    df = query(spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    known = db.execute(sql)
    names = [d[0] for d in known.description]
    assert sorted(names) == columns, name
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in known.fetchall()), key=repr)
    assert got == want, name


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    same(spark, db, name, catalogue.queries()[name], catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_stay_where_the_optional_part_cannot_be_imported(monkeypatch):
    for name in ("corpus_pipeline", "speechgrain.llm.registry"):
        with monkeypatch.context() as m:
            m.setitem(sys.modules, name, None)  # importing it raises
            found = __spark_entry__.queries()
            assert set(found) == set(catalogue.queries()) and set(__spark_entry__.oracle_sql()) == set(catalogue.oracle_sql())


def test_the_package_reaches_other_machines():
    class Context:
        environment, master, listFiles = {}, "spark://far:7077", []

        def addPyFile(self, path):  # noqa: N802
            self.listFiles = [*self.listFiles, f"spark://far/files/{os.path.basename(path)}"]
            self.names = zipfile.ZipFile(path).namelist()

    class Session:
        sparkContext = Context()

    for _ in range(2):
        __spark_entry__._ship(Session)
    found = Session.sparkContext
    assert len(found.listFiles) == 1 and "speechgrain/plans/catalogue.py" in found.names and not found.environment
    found.master, found.environment = "local[4]", {}
    __spark_entry__._ship(Session)
    assert found.environment["PYTHONPATH"] == os.path.dirname(os.path.abspath(__spark_entry__.__file__))
