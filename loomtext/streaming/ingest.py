"""Changes as a stream: each micro-batch is applied to the engine's stored tables once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomtext.config import EngineConfig
from loomtext.operators import index
from loomtext.operators.engine import Engine, Registration

CHANGES = "op string, seq long, pk string, old_text string, new_text string, at timestamp"


def change_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Change files of a folder, with all that is delivered, late and twice; ingest() sorts that out."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files).parquet(folder)


def ingest(engine: Engine, r: Registration, stream: DataFrame, checkpoint: str, now) -> StreamingQuery:
    """Applies what is there and ends.

    A batch's id is its stream's own, which the checkpoint keeps, with its number: so a batch
    that is replayed does nothing, and those of another stream or a new checkpoint are others.
    What a new checkpoint delivers again does nothing either, as seq tells of each change,
    whenever it comes, whether it was applied. The batch is read in any case, so that a
    replayed one also commits the state of operators before it.
    """
    import json

    def one(batch: DataFrame, number: int) -> None:
        log = engine.store(r).log
        stream_id = json.loads(log.read_text(f"{checkpoint}/metadata"))["id"]
        if not engine.apply(r, f"stream-{stream_id}-{number}", batch, now, once=True):
            batch.write.format("noop").mode("overwrite").save()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunk_stream(documents: DataFrame, pk: str, column: str, strategy: str | None = None, size: int | None = None, overlap: int | None = None, config: EngineConfig | None = None) -> DataFrame:
    """index.chunks on a stream: stateless, so it needs neither watermark nor shuffle."""
    return index.chunks(documents, pk, column, strategy, size, overlap, config)


def written_chunks(spark: SparkSession, schema: str, path: str, out: str, size: int, overlap: int) -> DataFrame:
    """Chunks of the documents in path by a stream into Parquet, and read back."""
    found = chunk_stream(spark.readStream.schema(schema).parquet(path), "doc_id", "text", "token_based", size, overlap)
    run = found.writeStream.format("parquet").option("path", f"{out}/chunks").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    return spark.read.parquet(f"{out}/chunks").select(F.col("source_id").alias("doc_id"), "chunk_index", "content", "token_count")
