"""From raw documents to token ids: five stages, each an operator of forkline.llm.

Every stage works on all that the one before kept, and is written as Parquet before the
next reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from forkline.llm.bpe import bpe_encode
from forkline.llm.common import remove, shared_dir
from forkline.llm.decontaminate import decontaminate
from forkline.llm.exact_dedup import exact_dedup
from forkline.llm.language_id import keep_identified, train
from forkline.llm.ngram_join import near_dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    return keep_identified(docs, train(docs))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    return near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, beside its columns."""
    return bpe_encode(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("bpe_encoding", encoding),
]

#: SQL can't express the codes, the seeds or the transducer; tests/llm compares the stages
#: with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage wrote. A stage's rows are deleted once the next one's are written;
    the last ones stay while the session may read them. Nulls, empty texts and repeated rows
    go as the stages' functions say; an empty table gives no rows."""
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    atexit.register(remove, spark, folder)
    return docs
