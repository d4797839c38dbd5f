import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame) -> tuple[list[str], list[str]]:
    """Column names and rows as text in one order; whole numbers look alike whatever their type."""
    names = sorted(frame.columns)
    plain = lambda x: None if x is None or x != x else int(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and x == int(x) else x
    values = frame[names].astype(object).where(frame[names].notna(), None)
    return names, sorted(repr(tuple(plain(x.item() if hasattr(x, "item") else x) for x in r)) for r in values.itertuples(index=False, name=None))


def oracle(sql: str, sf_dir: str = SMALL):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).fetchdf()
