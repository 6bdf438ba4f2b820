"""The relational tables with the column types of their schema: money as decimals, days as dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = {"l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice", "c_acctbal", "s_acctbal", "p_retailprice"}
DAYS = {"l_shipdate", "o_orderdate"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Casts are expressions over the scan: unused columns aren't read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("decimal(15,2)" if c in MONEY else "date") for c in df.columns if c in MONEY | DAYS})


#: The same in SQL.
def m(column: str) -> str:
    return f"CAST({column} AS DECIMAL(15,2))"


def d(column: str) -> str:
    return f"CAST({column} AS DATE)"
