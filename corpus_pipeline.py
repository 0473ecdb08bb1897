"""A corpus pipeline in five stages: quality rules, near-duplicate removal, decontamination, personal data, subwords.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next
stage's docs.  All but the last keep the columns of documents.  A stage's own result rows decide: quality and
decontamination drop rows, near-dedup keeps the least doc_id of each group, the personal-data stage rewrites texts.

Defined cases: a null or empty text fails the quality rules, so later stages see none, though each takes them as its
operator says; rows that repeat an id and its text leave the near-duplicate stage once; a null doc_id is in no group
and passes it; further columns pass through all stages but the last, whatever their names; an empty table gives an
empty result; a very long text is handled whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from typoforge.llm.base import documents, remove, shared_dir
from typoforge.llm.decontaminate import decontaminate
from typoforge.llm.near_dedup import drop_near_duplicates
from typoforge.llm.pii import redact_pii
from typoforge.llm.quality import keep_good
from typoforge.llm.subwords import pieces_digest


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility bands of their language or script."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return redact_pii(docs)


def subwords(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, sizes, checksums and ids of the texts' seeded segmentation, decoded again and compared."""
    return pieces_digest(docs, with_ids=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("subwords", subwords),
]

#: SQL can't express tokenisers, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the documents of a folder."""
    docs = documents(spark, sf_dir)
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return docs
