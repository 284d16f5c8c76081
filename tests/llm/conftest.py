import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def sql():
    """Runs SQL on the smallest tables."""
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    return lambda text: con.execute(text).fetchall()
