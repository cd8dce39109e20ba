from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v != v:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(v)


@pytest.fixture(scope="session")
def same():
    """Whether a DataFrame and SQL over a folder of Parquet have equal columns and rows, in any order."""
    import duckdb

    def check(df, sql, sf_dir):
        import pandas as pd

        con = duckdb.connect()
        for name in os.listdir(sf_dir):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
        want, got = con.execute(sql).fetch_df(), df.toPandas()
        assert sorted(want.columns) == sorted(got.columns)
        rows = lambda p: sorted(str(tuple(None if not isinstance(v, (list, tuple)) and not hasattr(v, "tolist") and pd.isna(v) else _plain(v) for v in r)) for r in p[sorted(p.columns)].itertuples(index=False, name=None))
        assert rows(got) == rows(want)

    return check


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL
