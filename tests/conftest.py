import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    """sql -> sorted rows as text, over the smallest tables."""
    import duckdb

    con = duckdb.connect()
    for n in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {n} as select * from '{SMALL}/{n}.parquet'")
    return lambda sql: comparable(con.execute(sql).df())


def comparable(df):
    import pandas as pd

    df = df[sorted(df.columns)]
    text = lambda x: "null" if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x) else f"{x + 0.0:.6f}" if isinstance(x, float) else str(x)
    return list(df.columns), sorted(tuple(map(text, r)) for r in df.itertuples(index=False, name=None))
