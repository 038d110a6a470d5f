"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import chat, curriculum, imatch, licenses, lines, minhash, pieces, quality, rollups, warc

_MODULES = (minhash, licenses, chat, imatch, rollups, curriculum, warc, quality, pieces, lines)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.SQL.items()}
