from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of text, columns by name: what two engines must agree on."""
    frame = frame[sorted(frame.columns)].astype(object)
    show = lambda v: "null" if v is None or v is pd.NA or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in row) for row in frame.itertuples(index=False))


def same(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    ours, theirs = df.toPandas(), con.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)
