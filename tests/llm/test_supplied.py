"""The queries on the supplied tables: equal to their SQL where they have some, and results that are not empty."""

import duckdb
import pytest

from waymark.llm import registry

SF = "/root/testdata/{}"
SQL = registry.oracle_sql()


def value(x):
    return f"{x:.6f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name, table):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations", "pages"):
        con.sql(f"create view {t} as select * from '{SF.format(table)}/{t}.parquet'")
    df = registry.queries()[name](spark, SF.format(table))
    cols = sorted(df.columns)
    got = sorted(tuple(value(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got and got == sorted(tuple(value(r[i]) for i in at) for r in cur.fetchall())


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_pipeline_has_rows(spark, table):
    docs = spark.read.parquet(f"{SF.format(table)}/documents.parquet")
    got = registry.queries()["pipeline"](spark, SF.format(table))
    assert got.columns == ["doc_id", "ids"]
    n = got.count()
    assert docs.count() * 0.3 < n < docs.count() * 2
