"""Queries of this subpackage that have SQL, against it."""

import duckdb

from speechgrain.llm import registry

SF = "/root/testdata/sf0.001"


def test_queries_equal_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings", "benchmark", "sales", "sale_lines", "clients"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, SF)
        columns = sorted(df.columns)
        known = con.execute(sql)
        names = [d[0] for d in known.description]
        assert sorted(names) == columns
        assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[names.index(c)] for c in columns) for r in known.fetchall()), key=repr)
