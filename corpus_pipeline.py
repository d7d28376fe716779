"""Cleans ``documents``: five stages, each written as Parquet and read again by the next one.

A stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of ``documents``; a stage never changes a row but for the text where that is its purpose. Stages decide by row, not by id: null
and repeated ids are rows like others, and so are null and empty texts, which are clean and stay. An empty table
stays an empty table. ``docs`` needs doc_id and text; other columns, whatever their names, are carried.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from grovekit.llm import decontaminate, jaccard_join, toxicity
from grovekit.llm.common import shared_folder, table
from grovekit.llm.line_dedup import without_repeated_lines
from grovekit.llm.piece_codec import encode_digests


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines of 50 words or more that repeat an earlier document's are cut out of the text; n_chars, if there, follows the text."""
    return without_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at 0.8, directly or through others, the one with the smallest id stays. Texts without words stay."""
    return jaccard_join.distinct_documents(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's five-word shingles go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as digests of its ids and of the text that they decode to."""
    return encode_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("piece_codec", encode),
]

#: The classifier, the first occurrences by text hash and the library's encoding can't be said in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the tables between them go to the shared checkpoint folder, and each goes when the next one is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            at = spark._jvm.org.apache.hadoop.fs.Path(before)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        before = path
    return docs
