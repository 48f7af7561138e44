"""A corpus pipeline: quality classifier, line dedup, near-dedup, PII sanitisation, packing.

Each stage works on all rows that the stage before it kept and is written as Parquet in the shared folder
before the next one reads it. All stages but the last return the columns of documents, whatever extra columns
there are and however they are named. An empty table passes all stages and gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard, linededup, packing, pii, quality
from tidemark.llm.common import ensure_checkpoint_dir, table
from tidemark.llm.queries import word_tokenizer_file


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; null and empty texts are scored like any other, repeated rows alike."""
    return quality.keep_quality(spark, docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that later documents repeat; null texts stay null, repeated rows lose the same lines."""
    return linededup.drop_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are similar to 0.8 or more; of null and empty texts one."""
    return jaccard.drop_near_duplicates(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and disclosing terms replaced; rows without any, nulls included, stay as they are."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences; null and empty texts are one piece of the end id."""
    return packing.pack_documents(docs, word_tokenizer_file())


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("pii", sanitise),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over documents.

    A stage's table is deleted once the next one is written; the result reads the last table, which stays.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = f"{folder}/{i}-{name}"
        out.write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
