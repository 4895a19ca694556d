"""The corpus queries that SQL can express equal DuckDB's results."""

import duckdb
import pytest

from parcelight.llm import registry
from tests.test_catalog import rows_of


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(registry.ORACLES[name])
    want = rows_of([d[0] for d in found.description], found.fetchall())
    df = registry.QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0] and len(got[1]) == len(want[1]) > 0
    different = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    assert not different, different[:3]
