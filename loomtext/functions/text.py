"""Text expressions that stay in the JVM: ASCII stripping, token estimates, stable names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_non_ascii(text: Column) -> Column:
    """Non-ASCII runs become one blank, or nothing at the start and after a blank."""
    led = F.regexp_replace(text, r"(?:(?<= )|\A)[^\x00-\x7F]+", "")
    return F.regexp_replace(led, r"[^\x00-\x7F]+", " ")


def est_tokens(text: Column) -> Column:
    """Estimated tokens as the chunkers count them: characters / 4, rounded up."""
    return F.floor((F.length(text) + 3) / 4).cast("int")


def token_count(text: Column) -> Column:
    """Token count as stored with chunks and as BM25 length: characters / 4, rounded down."""
    return F.floor(F.length(text) / 4).cast("int")


def name_of(table: str, column: str, suffix: str, limit: int = 63) -> str:
    """A name for what belongs to a table's column: readable, of at most limit bytes, and distinct by a digest."""
    import hashlib

    digest = hashlib.md5(f"{table}.{column}".encode()).hexdigest()[:8]
    room = max(limit - len(suffix.encode()) - len(digest) - 1, 0)
    readable = f"{table}_{column}"[:room]
    while len(readable.encode()) > room:
        readable = readable[:-1]
    return f"{readable}_{digest}{suffix}"


def cleanup_name(table: Column, column: Column, suffix: str, limit: int = 63) -> Column:
    """name_of as an expression, for tables and columns of ASCII names."""
    digest = F.substring(F.md5(F.concat(table, F.lit("."), column)), 1, 8)
    room = max(limit - len(suffix.encode()) - 9, 0)
    return F.concat(F.left(F.concat(table, F.lit("_"), column), F.lit(room)), F.lit("_"), digest, F.lit(suffix))
