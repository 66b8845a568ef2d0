"""Queries of this subpackage against their SQL."""

import duckdb
import pytest

from fringeflow.llm import oracles, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(oracles.ORACLES[name])
    df = queries.QUERIES[name](spark, SF)
    assert sorted(rel.columns) == sorted(df.columns)
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    types = dict(zip(rel.columns, map(str, rel.types)))
    assert {c: kinds[k] for c, k in df.dtypes} == types
    want = sorted((tuple(r) for r in rel.select(*df.columns).fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == want
