"""Reading tables, and a folder for what a job writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a batch that goes to Python, where the session leaves it at Spark's own 10,000, and of what is held as Python objects at once: texts are long.
BATCH_ROWS, SLICE_ROWS = 1000, 128


def lean(spark: SparkSession) -> None:
    """Smaller batches of rows for Python, so that what a worker holds of texts doesn't grow with a task's rows."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared one that the cluster names; only local sessions without one use their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named or tempfile.mkdtemp(prefix='loomtext-')}/{purpose}-{uuid.uuid4().hex}"
