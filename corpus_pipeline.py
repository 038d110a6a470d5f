"""The corpus pipeline: five operators in a row, each over all that the one before kept.

Each stage takes any table with the columns of documents, whatever others it has besides:
null, empty and very long texts, null ids, ties, repeated rows and empty tables have the
results that the operator behind it states, and none makes it fail.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm.curriculum import mixed
from loomtext.llm.lines import drop_repeated_lines
from loomtext.llm.minhash import drop_near_duplicates
from loomtext.llm.pieces import encoded_in_order
from loomtext.llm.quality import drop_low_quality
from loomtext.llm.shared import checkpoint_dir, lean, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of good quality is under a half go; null, empty and blank texts stay."""
    lean(spark)
    return drop_low_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that stand elsewhere go from the texts, and documents with nothing left; null and empty texts stay."""
    lean(spark)
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, and of repeated rows one; null texts all stay."""
    lean(spark)
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order under the natural schedule, once for each epoch they are placed in; what a source has beyond its demand goes."""
    lean(spark)
    return mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of each row, another sample for each epoch of a document, whether they decode to its text, and its place in the training order (part, place)."""
    lean(spark)
    return encoded_in_order(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: The stages' models and samples are beyond SQL; a test holds run() on a small table against plain Python that shares no code with it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written to the shared folder and read by the next, and go once that has written its own."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    of = spark._jvm.org.apache.hadoop.fs.Path
    files = of(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            files.delete(of(f"{folder}/{k - 1}.parquet"), True)
    return docs
