"""A corpus pipeline of operators of netfathom.llm: quality, near copies, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir), and its result is written as Parquet and read again as the next one's docs. All
but the last return the columns of ``documents`` (doc_id, text, lang, source, n_chars). Nulls, empty and long texts, ties
and repeated rows are handled as the operators' docstrings say; an empty table passes through empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netfathom.llm import pii, quality_classifier
from netfathom.llm.decontamination import decontaminate
from netfathom.llm.jaccard_join import keep_one
from netfathom.llm.packing import pack
from netfathom.llm.shared import shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are probably not of the top grade (toxic or poor)."""
    return quality_classifier.select(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles."""
    return keep_one(docs, k=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold ten consecutive words of a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars counts the new text."""
    clean = pii.redact(docs, pii.learn(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents, packed into sequences of 2048 tokens."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark), ("PII", personal_data), ("packing", packing)]
#: The trained stages can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage has read is removed once its result is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                _remove(spark, f"{folder}/{k - 1}")
    return docs
