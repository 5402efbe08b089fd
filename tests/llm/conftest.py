import duckdb
import pytest


@pytest.fixture(scope="session")
def small():
    """The folder of the smallest tables, and DuckDB with them as views."""
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return d, con
