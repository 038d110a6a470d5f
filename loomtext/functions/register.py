"""SQL names for the engine's functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.config import EngineConfig, show_config
from loomtext.functions import bm25, chunking


def register(spark: SparkSession, config: EngineConfig | None = None) -> None:
    """chunk_text, bm25_tokenize, chunk_table and show_config() for SQL; null arguments give null."""
    spark.udf.register("chunk_text", chunking.strict_udf())
    spark.udtf.register("chunk_table", chunking.chunk_table_udtf())
    stop = ", ".join(f"'{w}'" for w in bm25.STOPWORDS)
    words = "split(lower(regexp_replace(query, '[^A-Za-z]+', ' ')), ' ')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION bm25_tokenize(query STRING) RETURNS ARRAY<STRING> RETURN array_distinct(filter({words}, w -> w != '' AND length(w) <= {bm25.LONGEST_TERM} AND w NOT IN ({stop})))")
    show_config(spark, config).createOrReplaceTempView("loomtext_settings")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION show_config() RETURNS TABLE (setting STRING, value STRING) RETURN SELECT setting, value FROM loomtext_settings")


def register_engine(engine) -> None:
    """register(), the provider as generate_embedding(text) and detect_embedding_dimension(), and for all columns that are vectorised now their chunk tables as views and bm25_avg_doc_len(chunk_table)."""
    from loomtext.operators.index import corpus_stats
    from loomtext.sources import providers

    spark, provider = engine.spark, providers.provider_for(engine.config)
    register(spark, engine.config)

    def embed(texts: pa.Array) -> pa.Array:
        return pa.array([providers.generate_embedding(provider, t) for t in texts.to_pylist()], pa.list_(pa.float32()))

    spark.udf.register("generate_embedding", F.arrow_udf(embed, T.ArrayType(T.FloatType())))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION detect_embedding_dimension() RETURNS INT RETURN {providers.detect_dimension(provider)}")
    lengths = []
    for r in engine.registry.values():
        rows = engine.store(r).read("chunks")
        rows.createOrReplaceTempView(f"`{r.chunk_table}`")
        corpus_stats(rows).createOrReplaceTempView(f"`{r.chunk_table}_stats`")
        lengths.append(f"WHEN '{r.chunk_table}' THEN (SELECT max(avg_len) FROM `{r.chunk_table}_stats`)")
    body = f"CASE chunk_table {' '.join(lengths)} END" if lengths else "CAST(NULL AS DOUBLE)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION bm25_avg_doc_len(chunk_table STRING) RETURNS DOUBLE RETURN {body}")
