"""Wiki dumps (XML) to the page, revision, content and user relations.

The text gets | as ~, " as ', and line ends as blanks, so that it fits a .tbl file;
revisions without text are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .copying import write_separated

SCHEMA = "id long, title string, revision array<struct<id: long, parentid: long, contributor: struct<id: long, username: string>, text: string>>"


def clean(c):
    return F.regexp_replace(F.translate(c, '|"', "~'"), r"[\r\n]+", " ")


def read_wiki(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    pages = spark.read.format("xml").option("rowTag", "page").option("valueTag", "_VALUE").schema(SCHEMA).load(path)
    each = pages.select("id", "title", F.explode("revision").alias("r")).where(F.length(F.trim("r.text")) > 0)
    revision = each.select(F.col("r.id").alias("id"), F.coalesce("r.parentid", F.lit(0).cast("long")).alias("parentid"), F.col("id").alias("pageid"), F.col("r.id").alias("textid"), F.coalesce("r.contributor.id", F.lit(0).cast("long")).alias("userid"))
    return {
        "page": each.select("id", clean(F.col("title")).alias("title")).distinct(),
        "revision": revision,
        "content": each.select(F.col("r.id").alias("id"), clean(F.col("r.text")).alias("text")),
        "user": each.where("r.contributor.id is not null").select(F.col("r.contributor.id").alias("id"), clean(F.col("r.contributor.username")).alias("name")).distinct(),
    }


def convert(spark: SparkSession, path: str, folder: str) -> None:
    """The four relations as .tbl."""
    for name, df in read_wiki(spark, path).items():
        write_separated(df, f"{folder}/{name}.tbl", "tbl")
