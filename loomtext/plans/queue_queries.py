"""Queries of the work queue, which the events table stands in for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.config import EngineConfig, show_config
from loomtext.functions.text import cleanup_name
from loomtext.operators import index, queue
from loomtext.plans.index_queries import doc_chunks
from loomtext.sources.tables import table

NOW = "2024-01-15 12:00:00"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    id_, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    turn, none = id_ % 4, F.lit(None)
    return e.select(
        id_.alias("id"), id_.alias("chunk_id"), F.concat(F.lit("chunks_"), (F.col("user_id") % 3).cast("string")).alias("chunk_table"), F.repeat("props", 12).alias("content"),
        F.when(turn == 0, "pending").when(turn == 1, "processing").when(turn == 2, "completed").otherwise("failed").alias("status"), (id_ % 5).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"),
        F.when(turn == 3, F.concat(F.lit("error: "), F.col("event_type"))).alias("error_message"), ts.alias("created_at"), none.cast("timestamp").alias("processing_started_at"), F.when(turn == 2, ts + F.expr("INTERVAL 30 MINUTES")).alias("processed_at"),
        F.when(id_ % 8 == 0, ts + F.expr("INTERVAL 1 DAY")).alias("next_retry_at"), F.when(id_ % 7 == 0, F.lit('{"sparse_only":true}')).alias("metadata"),
    )


ITEMS = """items as (select event_id id, event_id chunk_id, 'chunks_' || (user_id % 3) chunk_table, repeat(props, 12) content,
  case event_id % 4 when 0 then 'pending' when 1 then 'processing' when 2 then 'completed' else 'failed' end status, (event_id % 5)::int attempts, 3 max_attempts,
  case when event_id % 4 = 3 then 'error: ' || event_type end error_message, ts created_at, case when event_id % 4 = 2 then ts + interval 30 minute end processed_at,
  case when event_id % 8 = 0 then ts + interval 1 day end next_retry_at, case when event_id % 7 = 0 then '{"sparse_only":true}' end metadata from events)"""
_NOW = f"timestamp '{NOW}'"


def spelled(name: str, to: str | None = None) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(to or name)


def _spelled_sql(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f') {name}"


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.queue_status(items(spark, sf_dir), NOW).select("chunk_table", "status", "count", spelled("oldest"), spelled("newest"), F.round("avg_processing_time_secs", 3).alias("avg_processing_time_secs"))


def failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.failed_items(items(spark, sf_dir)).select("id", "chunk_table", "content_preview", "attempts", "error_message", spelled("created_at"))


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.pending_count(items(spark, sf_dir))


def claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.claim(items(spark, sf_dir), NOW, 50).select("id", "chunk_table", spelled("created_at"))


def claim_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that may be claimed, with the batch that each item is sent in."""
    return queue.batches(queue.claimable(items(spark, sf_dir), NOW)).select("id", "batch")


def _moved(df: DataFrame) -> DataFrame:
    return df.select("id", "status", "attempts", "error_message", spelled("next_retry_at"), spelled("processed_at"))


def transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third item succeeded, every other third failed, nothing is known of the rest."""
    q = items(spark, sf_dir)
    told = q.where("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 1, F.lit("it's broken")).alias("error"))
    return _moved(queue.transition(q, told, NOW))


def guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items get vectors of as many dimensions as their id tells; four are right."""
    q = items(spark, sf_dir)
    told = q.select("id", F.array_repeat(F.lit(0.5), (F.col("id") % 6).cast("int")).alias("embedding"))
    return _moved(queue.fail_mismatched(q, queue.dimension_guard(told, 4)))


def retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moved(queue.retry_failed(items(spark, sf_dir), NOW, 240))


def clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.clear_completed(items(spark, sf_dir), NOW, 48).select("id", "status")


def cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.auto_cleanup(items(spark, sf_dir), NOW, EngineConfig().auto_cleanup_hours).select("id", "status")


def reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lack a dense vector unless the embeddings table has one, and each fifth lacks a sparse one."""
    have = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    chunks = doc_chunks(spark, sf_dir).join(have, "id", "left").withColumn("sparse_embedding", F.when(F.col("id") % 5 != 0, F.lit("{}/65536")))
    more = queue.reprocess(items(spark, sf_dir), chunks, "chunks_1", NOW, True, 7)
    return more.select("chunk_id", "status", "attempts", "max_attempts", "metadata")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("documents_of_the_source_"), F.col("source"))
    return table(spark, sf_dir, "documents").select("source").distinct().select("source", cleanup_name(t, F.lit("a_column_with_a_rather_long_name"), "_cleanup").alias("name"))


def terms_of_claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without a dense vector that no item waits for, as rows only."""
    q = items(spark, sf_dir).where("status IN ('pending', 'processing')").select(F.col("chunk_id").alias("id"))
    return doc_chunks(spark, sf_dir).where(index.has_text(F.col("content"), True)).join(q, "id", "left_anti").select("id", "token_count")


QUERIES = {
    "queue_status": status,
    "failed_items": failed,
    "pending_count": pending,
    "queue_claim": claim,
    "queue_claim_batches": claim_batches,
    "queue_transition": transition,
    "queue_dimension_guard": guard,
    "retry_failed": retry,
    "clear_completed": clear,
    "auto_cleanup": cleanup,
    "reprocess_chunks": reprocess,
    "not_queued": terms_of_claimed,
    "cleanup_trigger_name": names,
    "show_config": lambda spark, sf_dir: show_config(spark),
}

_OUT = f"id, status, attempts, error_message, {_spelled_sql('next_retry_at')}, {_spelled_sql('processed_at')}"
_TIME = "coalesce(processed_at, " + _NOW + ")"
SQL = {
    "queue_status": f"with {ITEMS}, g as (select chunk_table, status, count(*) count, min(created_at) oldest, max(created_at) newest, avg((epoch_us({_TIME}) - epoch_us(created_at)) / 1e6::double) s from items group by 1, 2) select chunk_table, status, count, {_spelled_sql('oldest')}, {_spelled_sql('newest')}, round(s, 3) avg_processing_time_secs from g",
    "failed_items": f"with {ITEMS} select id, chunk_table, left(content, 100) content_preview, attempts, error_message, {_spelled_sql('created_at')} from items where status = 'failed'",
    "pending_count": f"with {ITEMS} select count(*) pending_items, count(distinct chunk_table) tables_with_pending from items where status = 'pending'",
    "queue_claim": f"with {ITEMS} select id, chunk_table, {_spelled_sql('created_at')} from items where status = 'pending' and (next_retry_at is null or next_retry_at <= {_NOW}) order by items.created_at, id limit 50",
    "queue_claim_batches": f"with {ITEMS}, c as (select * from items where status = 'pending' and (next_retry_at is null or next_retry_at <= {_NOW})) select id, case when (select max(attempts > 0 or metadata is not null) from c) then id else 0 end batch from c",
    "queue_transition": f"""with {ITEMS}, m as (select *, status in ('pending', 'processing') and id % 3 < 2 live, id % 3 = 1 bad, attempts + 1 tries from items)
select id, case when live and not bad then 'completed' when live and tries >= 3 then 'failed' when live then 'pending' else status end status, case when live and bad then tries else attempts end attempts,
  case when live and bad then 'it''s broken' else error_message end error_message,
  strftime(case when live and bad and tries < 3 then {_NOW} + tries * interval 1 minute when live and bad then null else next_retry_at end, '%Y-%m-%d %H:%M:%S.%f') next_retry_at,
  strftime(case when live and not bad then {_NOW} else processed_at end, '%Y-%m-%d %H:%M:%S.%f') processed_at from m""",
    "queue_dimension_guard": f"with {ITEMS}, m as (select id, case when id % 6 <> 4 then 'failed' else status end status, attempts, case when id % 6 <> 4 then 'Dimension mismatch: model=' || (id % 6) || ', table=4' else error_message end error_message, next_retry_at, processed_at from items) select {_OUT} from m",
    "retry_failed": f"""with {ITEMS}, m as (select *, status = 'failed' and attempts < max_attempts and created_at > {_NOW} - interval 240 hour fits from items),
n as (select id, case when fits then 'pending' else status end status, case when fits then 0 else attempts end attempts, case when not fits then error_message end error_message, case when not fits then next_retry_at end next_retry_at, processed_at from m) select {_OUT} from n""",
    "clear_completed": f"with {ITEMS} select id, status from items where not (status = 'completed' and processed_at < {_NOW} - interval 48 hour)",
    "auto_cleanup": f"with {ITEMS} select id, status from items where not (status = 'completed' and processed_at < {_NOW} - interval 24 hour)",
    "reprocess_chunks": f"""with {ITEMS}, c as (select doc_id id, embedding, doc_id % 5 <> 0 has_sparse from documents left join embeddings on vec_id = doc_id)
select id chunk_id, 'pending' status, 0 attempts, 7 max_attempts, case when embedding is not null then '{{"sparse_only":true}}' end metadata from c
where (embedding is null or not has_sparse) and id not in (select chunk_id from items where chunk_table = 'chunks_1' and status in ('pending', 'processing'))""",
    "not_queued": f"with {ITEMS} select doc_id id, (length(text) // 4)::int token_count from documents where trim(text, ' ') <> '' and doc_id not in (select chunk_id from items where status in ('pending', 'processing'))",
    "cleanup_trigger_name": "select distinct source, left('documents_of_the_source_' || source || '_a_column_with_a_rather_long_name', 46) || '_' || substr(md5('documents_of_the_source_' || source || '.a_column_with_a_rather_long_name'), 1, 8) || '_cleanup' \"name\" from documents",
    "show_config": "select * from (values " + ", ".join(f"('{k}', '{v}')" for k, v in EngineConfig().items()) + ") c(setting, value)",
}
