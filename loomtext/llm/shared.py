"""Session helpers of the corpus operators: reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only if its counted rows need no more than this.
BROADCAST_BYTES = 64 << 20


#: Rows of a batch that goes to Python, where the session leaves it at Spark's own 10,000: texts are long.
BATCH_ROWS = 2048


def lean(spark: SparkSession) -> None:
    """Smaller batches of rows for Python, which bound what an executor and its workers hold of texts."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; where it names none (tests), a folder of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage with a reliable checkpoint, which outlives executors."""
    checkpoint_dir(df.sparkSession)
    lean(df.sparkSession)
    return df.checkpoint(eager=True)


def fits(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a materialised df may be broadcast: its counted rows, or their summed sizes where rows have no fixed one."""
    total = F.count("*") * row_bytes if isinstance(row_bytes, int) else F.sum(row_bytes)
    return (df.agg(total).first()[0] or 0) <= limit


def join_checked(big: DataFrame, side: DataFrame, on: Column | list[str], how: str, row_bytes: int | Column) -> DataFrame:
    """Joins a materialised side: broadcast if its counted size allows, else by shuffling both.

    row_bytes are those of a row in a hashed relation: about 48 for one long, and 8 a column
    in key and value each, with the lengths of what has no fixed one.
    """
    return big.join(F.broadcast(side) if fits(side, row_bytes) else side, on, how)


def content_key(text: Column) -> Column:
    """64 bits of a text's MD5, to tell apart texts of one doc_id; null for a null text."""
    return F.when(text.isNotNull(), F.xxhash64(F.md5(text)))


def text_key(text: Column) -> Column:
    """A text's whole MD5: what equal texts share, and no two others of a corpus; null for a null text."""
    return F.unhex(F.md5(text))


def own_names(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Renames columns of docs that begin with two underscores while step, whose own they might be, is at work."""

    @wraps(step)
    def run(docs: DataFrame, *args, **more) -> DataFrame:
        hidden = {c: f"{'kept ' * (1 + max(x.count('kept ') for x in docs.columns))}{i}" for i, c in enumerate(docs.columns) if c.startswith("__")}
        back = {v: k for k, v in hidden.items()}
        return step(docs.withColumnsRenamed(hidden), *args, **more).withColumnsRenamed(back)

    return run
