import duckdb
import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("pages", "documents", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = c.execute(queries.ORACLES[name])
    names = [x[0] for x in cur.description]
    got = queries.QUERIES[name](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(cur.fetchall(), key=repr)
