import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tmp_path_factory.mktemp("shared").as_uri())
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        if name.endswith(".parquet"):
            con.sql(f"CREATE VIEW {name[:-8]} AS FROM '{DATA}/{name}'")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, data, duck):
    """Whether a registered query and its SQL give the same columns and rows."""

    def check(query, sql):
        df = query(spark, data)
        got, want = df.collect(), duck.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(want.columns)
        order = [want.columns.index(c) for c in columns]
        assert sorted(repr([r[c] for c in columns]) for r in got) == sorted(repr([r[k] for k in order]) for r in want.fetchall())

    return check
