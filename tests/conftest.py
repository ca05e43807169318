import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    """Runs SQL over the named test tables of a folder."""
    import duckdb

    def run(sql: str, sf_dir: str) -> list[tuple]:
        con = duckdb.connect()
        for p in Path(sf_dir).glob("*.parquet"):
            con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        found = con.sql(sql)
        order = sorted(found.columns)
        return order, con.sql(f"SELECT {', '.join(order)} FROM ({sql})").fetchall()

    return run


def alike(rows) -> list[tuple]:
    """Rows as sortable, comparable tuples."""

    def plain(v):
        if isinstance(v, float):
            return float(f"{v:.9g}") + 0.0
        if isinstance(v, (list, tuple)):
            return tuple(plain(x) for x in v)
        return v

    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])
