"""A corpus pipeline: quality rules, near-dedup, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.

Defined results: a null or empty text has no words and goes at the quality stage; null ids come after all others, and
rows of one id with different texts are different documents; of equal rows the near-dedup stage keeps one; columns other
than those of documents go through all stages but the last; an empty table gives an empty result; a very long text is
worked on whole, and what a task holds grows with the longest one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import mixing, packing, quality, simhash, substrings
from tabloom.llm.common import shared_dir
from tabloom.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.kept_documents(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of texts with a similarity of 0.8 over five-word shingles."""
    return simhash.one_of_each(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of words that start earlier elsewhere."""
    return substrings.trimmed_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source at its target: whole documents, repeated by epoch, and one cut at the budget."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary length, each a sequence of its own."""
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Stages hash and tokenize, which SQL can't express; tests/llm/ compares them with brute force.
ORACLE_SQL = None


def _removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again. A stage's folder is
    removed once the next one's is complete; that of the last written stage is what the result reads, and stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _removed(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
