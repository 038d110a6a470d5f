"""The work queue as a table: what may be claimed, how items move on, and the monitoring views.

Columns: id, chunk_id, chunk_table, content, status (pending, processing, completed or
failed), attempts, max_attempts, error_message, created_at, processing_started_at,
processed_at, next_retry_at, metadata (JSON). The present time is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = "id long, chunk_id long, chunk_table string, content string, status string, attempts int, max_attempts int, error_message string, created_at timestamp, processing_started_at timestamp, processed_at timestamp, next_retry_at timestamp, metadata string"
ERROR_BYTES = 1023


def at(now: str | Column) -> Column:
    return F.to_timestamp(F.lit(now)) if isinstance(now, str) else now


def seconds(a: Column, b: Column) -> Column:
    return (F.unix_micros(a) - F.unix_micros(b)) / F.lit(1e6)


def sparse_only(metadata: Column) -> Column:
    return F.coalesce(F.get_json_object(metadata, "$.sparse_only") == "true", F.lit(False))


def enqueue(rows: DataFrame, chunk_table: str, now: str | Column, max_retries: int = 3) -> DataFrame:
    """Pending items for chunk rows (id, content); a column sparse_only marks those that need no dense vector."""
    only = F.col("sparse_only") if "sparse_only" in rows.columns else F.lit(False)
    none = lambda t: F.lit(None).cast(t)
    return rows.select(
        F.xxhash64(F.lit(chunk_table), F.col("id"), F.col("content")).alias("id"), F.col("id").alias("chunk_id"), F.lit(chunk_table).alias("chunk_table"), "content", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(max_retries).alias("max_attempts"),
        none("string").alias("error_message"), at(now).alias("created_at"), none("timestamp").alias("processing_started_at"), none("timestamp").alias("processed_at"), none("timestamp").alias("next_retry_at"), F.when(only, F.to_json(F.struct(F.lit(True).alias("sparse_only")))).alias("metadata"),
    )


def claimable(queue: DataFrame, now: str | Column) -> DataFrame:
    return queue.where((F.col("status") == "pending") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= at(now))))


def claim(queue: DataFrame, now: str | Column, batch: int = 10) -> DataFrame:
    """The oldest claimable items, whatever their attempts."""
    return claimable(queue, now).orderBy("created_at", "id").limit(batch)


def start(queue: DataFrame, claimed: DataFrame, now: str | Column) -> DataFrame:
    """queue with the claimed items (id) in work."""
    mine = claimed.select("id").distinct().withColumn("__mine", F.lit(True))
    live = F.coalesce("__mine", F.lit(False)) & (F.col("status") == "pending")
    moved = {"status": F.when(live, "processing").otherwise(F.col("status")), "processing_started_at": F.when(live, at(now)).otherwise(F.col("processing_started_at"))}
    return queue.join(mine, "id", "left").select(*[moved.get(c, F.col(c)).alias(c) for c in queue.columns])


def batches(claimed: DataFrame) -> DataFrame:
    """claimed with batch: 0 for all, or each item its own if one of them was retried or is sparse-only."""
    alone = F.broadcast(claimed.agg(F.coalesce(F.max((F.col("attempts") > 0) | sparse_only(F.col("metadata"))), F.lit(False)).alias("__alone")))
    return claimed.crossJoin(alone).withColumn("batch", F.when(F.col("__alone"), F.col("id")).otherwise(F.lit(0))).drop("__alone")


def clipped(message: Column) -> Column:
    """At most ERROR_BYTES bytes, cut between characters."""
    # A character takes four bytes at most; so only the last few candidates of a length need looking at.
    lengths = F.sequence(F.lit(ERROR_BYTES // 4), F.lit(ERROR_BYTES))
    fitting = F.array_max(F.filter(lengths, lambda n: F.octet_length(F.left(message, n)) <= ERROR_BYTES))
    return F.when(F.octet_length(message) <= ERROR_BYTES, message).otherwise(F.left(message, fitting))


def transition(queue: DataFrame, results: DataFrame, now: str | Column) -> DataFrame:
    """queue after results (id, error): without error completed, else failed for good or due again.

    The n-th failure waits n minutes; with max_attempts failures an item is failed for good.
    Results of ids that aren't processing or pending change nothing.
    """
    told = results.groupBy("id").agg(F.max("error").alias("__error"), F.lit(True).alias("__told"))
    live = F.coalesce("__told", F.lit(False)) & F.col("status").isin("pending", "processing")
    bad, tries = F.col("__error").isNotNull(), F.col("attempts") + 1
    over = tries >= F.col("max_attempts")
    later = at(now) + F.make_interval(mins=tries)
    moved = {
        "status": F.when(live & ~bad, "completed").when(live & over, "failed").when(live, "pending").otherwise(F.col("status")),
        "attempts": F.when(live & bad, tries).otherwise(F.col("attempts")),
        "error_message": F.when(live & bad, clipped(F.col("__error"))).otherwise(F.col("error_message")),
        "next_retry_at": F.when(live & bad & ~over, later).when(live & bad, F.lit(None)).otherwise(F.col("next_retry_at")),
        "processed_at": F.when(live & ~bad, at(now)).otherwise(F.col("processed_at")),
    }
    return queue.join(told, "id", "left").select(*[moved.get(c, F.col(c)).alias(c) for c in queue.columns])


def dimension_guard(results: DataFrame, dims: int) -> DataFrame:
    """results (id, embedding) with error where the embedding has another size than the table's."""
    wrong = F.size("embedding") != dims
    return results.select("id", F.when(~wrong, F.col("embedding")).alias("embedding"), F.when(wrong, F.format_string(f"Dimension mismatch: model=%d, table={dims}", F.size("embedding"))).alias("error"))


def fail_mismatched(queue: DataFrame, guarded: DataFrame) -> DataFrame:
    """Items of the wrong dimension fail at once; their attempts stay as they are."""
    bad = guarded.where("error IS NOT NULL").select("id", F.col("error").alias("__error"))
    return queue.join(bad, "id", "left").select(*[{"status": F.when(F.col("__error").isNotNull(), "failed").otherwise(F.col("status")), "error_message": F.coalesce("__error", "error_message")}.get(c, F.col(c)).alias(c) for c in queue.columns])


def retryable(now: str | Column, max_age_hours: int = 24, force: bool = False) -> Column:
    fits = (F.col("status") == "failed") & (F.col("created_at") > at(now) - F.make_interval(hours=F.lit(max_age_hours)))
    return F.coalesce(fits if force else fits & (F.col("attempts") < F.col("max_attempts")), F.lit(False))


def retry_failed(queue: DataFrame, now: str | Column, max_age_hours: int = 24, force: bool = False) -> DataFrame:
    """Failed items of the last hours, with attempts left (or all with force), pending again."""
    fits = retryable(now, max_age_hours, force)
    reset = {"status": F.lit("pending"), "attempts": F.lit(0), "error_message": F.lit(None).cast("string"), "next_retry_at": F.lit(None).cast("timestamp")}
    return queue.withColumn("__fits", fits).select(*[F.when(F.col("__fits"), reset[c]).otherwise(F.col(c)).alias(c) if c in reset else F.col(c) for c in queue.columns])


def outdated(now: str | Column, older_than_hours: int = 24) -> Column:
    old = (F.col("status") == "completed") & (F.col("processed_at") < at(now) - F.make_interval(hours=F.lit(older_than_hours)))
    return F.coalesce(old, F.lit(False))


def clear_completed(queue: DataFrame, now: str | Column, older_than_hours: int = 24) -> DataFrame:
    """queue without the completed items that were processed before then."""
    return queue.where(~outdated(now, older_than_hours))


def auto_cleanup(queue: DataFrame, now: str | Column, hours: int = 24) -> DataFrame:
    """Retention as configured; 0 hours keep everything."""
    return clear_completed(queue, now, hours) if hours else queue


def queue_status(queue: DataFrame, now: str | Column) -> DataFrame:
    took = F.avg(seconds(F.coalesce(F.col("processed_at"), at(now)), F.col("created_at")))
    return queue.groupBy("chunk_table", "status").agg(F.count("*").alias("count"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"), took.alias("avg_processing_time_secs")).orderBy("chunk_table", "status")


def failed_items(queue: DataFrame) -> DataFrame:
    return queue.where("status = 'failed'").select("id", "chunk_table", F.left("content", F.lit(100)).alias("content_preview"), "attempts", "error_message", "created_at", "next_retry_at").orderBy(F.desc("created_at"), "id")


def pending_count(queue: DataFrame) -> DataFrame:
    return queue.where("status = 'pending'").agg(F.count("*").alias("pending_items"), F.count_distinct("chunk_table").alias("tables_with_pending"))


def reprocess(queue: DataFrame, table: DataFrame, chunk_table: str, now: str | Column, hybrid: bool = False, max_retries: int = 3) -> DataFrame:
    """New items for chunks that lack a vector and aren't waiting already."""
    lacks = F.col("embedding").isNull() | (F.col("sparse_embedding").isNull() if hybrid else F.lit(False))
    waiting = queue.where((F.col("chunk_table") == chunk_table) & F.col("status").isin("pending", "processing")).select(F.col("chunk_id").alias("id"))
    rows = table.where(lacks).join(waiting, "id", "left_anti").select("id", "content", F.col("embedding").isNotNull().alias("sparse_only"))
    return enqueue(rows, chunk_table, now, max_retries)


class Backoff:
    """Waits after failures that no item can be blamed for: 5 seconds, doubling to 300."""

    def __init__(self, first: float = 5, most: float = 300) -> None:
        self.first, self.most, self._next = first, most, first

    def failed(self) -> float:
        wait, self._next = self._next, min(self._next * 2, self.most)
        return wait

    def succeeded(self) -> None:
        self._next = self.first


def rotation(waiting: list[str], running: dict[str, float], slots: int, now: float, quantum: float) -> tuple[list[str], list[str]]:
    """(to stop, to start) of one sweep over databases: those past their quantum give way while others wait; slots fill in turn."""
    idle = [d for d in waiting if d not in running]
    free = slots - len(running)
    due = sorted((d for d, since in running.items() if now - since >= quantum), key=lambda d: running[d])
    stop = due[: max(0, len(idle) - max(free, 0))]
    return stop, idle[: max(free, 0) + len(stop)]
