"""All queries of the engine by name, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomtext.operators import index, search
from loomtext.plans import change_queries, chunk_queries, index_queries, queue_queries, search_queries
from loomtext.sources.tables import table

_MODULES = (chunk_queries, index_queries, search_queries, queue_queries, change_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search over freshly chunked documents: the ten best chunks."""
    chunks = index.with_ids(index.chunks(table(spark, sf_dir, "documents"), "doc_id", "text"))
    best = search.keyword_search(chunks, index_queries.QUERY)
    return best.join(chunks, "id").orderBy(best["score"].desc(), "id").select("id", "source_id", "chunk_index", "score", "content")
