import os
import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def rows(frame) -> list[tuple]:
    """Rows in order, columns by name, floats to five digits."""

    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
            return "null"
        return f"{float(x) + 0.0:.5f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    names = sorted(frame.columns)
    return sorted(tuple(cell(x) for x in r) for r in frame[names].astype(object).itertuples(index=False))
