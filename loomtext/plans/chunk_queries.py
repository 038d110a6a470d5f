"""Queries of the chunkers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import chunking, text
from loomtext.operators import index
from loomtext.plans import sql
from loomtext.sources.tables import scratch, table
from loomtext.streaming.ingest import written_chunks


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _cut(size: int, overlap: int, strategy: str = "token_based"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return index.chunks(_docs(spark, sf_dir), "doc_id", "text", strategy, size, overlap)

    return run


def _cut_sql(size: int, overlap: int, source: str = sql.DOCS) -> str:
    return f"with recursive {source}, {sql.chunked('docs', 'c', size, overlap)} select * from c"


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.chunks(_docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))), "doc_id", "text", "token_based", 100, 20)


def strip_non_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.strip_non_ascii(F.col("text")).alias("stripped"))


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.est_tokens(F.col("text")).alias("est_tokens"), text.token_count(F.col("text")).alias("token_count"))


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as markdown: a heading for the conversation and one for each turn."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    spelled = F.transform("turns", lambda t: F.concat(F.lit("## "), t["role"], F.lit("\n\n"), t["text"], F.lit("\n")))
    return turns.select("conv_id", F.concat(F.lit("# Conversation\n\n---\n\n"), F.array_join(spelled, "\n")).alias("text"))


def _structured(strategy: str, size: int):
    return lambda spark, sf_dir: index.chunks(_markdown(spark, sf_dir), "conv_id", "text", strategy, size, 0)


def markdown_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", chunking.is_markdown(F.col("text")).alias("markdown"))


def plain_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid strategy on documents that hold no sign of markdown, which SQL can follow; chunk_hybrid_documents takes them all."""
    plain = _docs(spark, sf_dir).where(~F.col("text").rlike(r"[|\[>#`~]|(^|\n) *([-*+]|[0-9]+[.)])[ \t]"))
    return index.chunks(plain, "doc_id", "text", "hybrid", 100, 20)


def _whole(strategy: str):
    """A structured strategy on all documents, with markdown in them or without."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return index.chunks(_docs(spark, sf_dir), "doc_id", "text", strategy, 100, 20)

    return run


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return written_chunks(spark, schema, f"{sf_dir}/documents.parque[t]", scratch(spark, "stream"), 400, 50).withColumnRenamed("doc_id", "source_id")


QUERIES = {
    "chunk_token_400_50": _cut(400, 50),
    "chunk_token_100_20": _cut(100, 20),
    "chunk_token_no_overlap": _cut(100, 0),
    "chunk_token_paragraphs": paragraphs,
    "chunk_markdown": _structured("markdown", 50),
    "chunk_hybrid": _structured("hybrid", 100),
    "chunk_plain_fallback": plain_fallback,
    "chunk_hybrid_documents": _whole("hybrid"),
    "chunk_markdown_documents": _whole("markdown"),
    "markdown_detection": markdown_detection,
    "strip_non_ascii": strip_non_ascii,
    "token_estimates": token_estimates,
    "stream_ingest_available_now": stream_ingest,
}
SQL = {
    "chunk_token_400_50": _cut_sql(400, 50),
    "chunk_token_100_20": _cut_sql(100, 20),
    "chunk_token_no_overlap": _cut_sql(100, 0),
    "chunk_token_paragraphs": _cut_sql(100, 20, "docs as (select doc_id id, replace(text, chr(10), chr(10) || chr(10)) text from documents)"),
    "chunk_plain_fallback": _cut_sql(100, 20, r"docs as (select doc_id id, text from documents where not regexp_matches(text, '[|\[>#`~]|(^|\n) *([-*+]|[0-9]+[.)])[ \t]'))"),
    "strip_non_ascii": f"select doc_id, {sql.strip('text')} stripped from documents",
    "token_estimates": "select doc_id, ((length(text) + 3) // 4)::int est_tokens, (length(text) // 4)::int token_count from documents",
    "stream_ingest_available_now": _cut_sql(400, 50),
}
