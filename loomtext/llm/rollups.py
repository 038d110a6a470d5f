"""Token counts kept up to date by signed deltas (operator 5).

A batch of inserts, deletes and revised counts is summed to signed totals by source,
language and tokenizer version, written once and committed under its id; the totals are a
snapshot and the deltas committed since. After COMPACT deltas a commit adds them up to the
next snapshot, so that reading costs the same however many batches there were. A batch that
is committed already changes nothing, so a job that was lost half-way is simply run again.
"""

from __future__ import annotations

import base64
import uuid
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm import kernels as K
from loomtext.llm.shared import checkpoint_dir, join_checked, materialise, table, text_key
from loomtext.sources.log import CommitLog

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Deltas that wait for a snapshot at most.
COMPACT = 64
KEYS = ["source", "lang", "version"]
DELTA = "source string, lang string, version string, documents long, tokens long"


@lru_cache(2)
def _encoding(ranks: bytes):
    import tiktoken

    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})


def _counter(path: str):
    # The vocabulary goes with the function, so that executors needn't have the file.
    ranks = Path(path).read_bytes()

    def run(texts: pa.Array) -> pa.Array:
        encode = _encoding(ranks).encode_ordinary
        out: list[int] = []
        for i, j in K.slices(texts):
            out += [len(encode(x)) if x else 0 for x in texts.slice(i, j - i).to_pylist()]
        return pa.array(out, pa.int64())

    return run


def token_count(text: Column, path: str = RANKS) -> Column:
    """Tokens of a text under a byte-pair vocabulary; 0 for null and empty texts."""
    return F.arrow_udf(_counter(path), T.LongType())(text.cast("string"))


class Rollup:
    """Totals in a folder that all executors and later jobs can reach."""

    def __init__(self, spark: SparkSession, folder: str, compact: int = COMPACT) -> None:
        self.spark, self.folder, self.compact = spark, folder, compact
        self.log = CommitLog(spark, folder)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of changes; False, and nothing happens, if its id is committed already. An id may be any text.

        changes has op ('insert', 'delete' or 'revise'), source, lang, version, tokens, and
        old_source, old_lang, old_version and old_tokens for the counts that a delete takes
        back or a revision replaces. Null sources, languages and versions are groups of their
        own; null tokens count 0; rows with a null or other op are left out. Repeated rows
        count each: what makes a change single is its batch.
        """
        now = self.log.newest()
        if self.log.seen(batch, now):
            return False
        signed = F.array(
            F.when(F.col("op").isin("insert", "revise"), F.struct("source", "lang", "version", F.lit(1).cast("long").alias("documents"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))),
            F.when(F.col("op").isin("delete", "revise"), F.struct(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.col("old_version").alias("version"), F.lit(-1).cast("long").alias("documents"), (-F.coalesce("old_tokens", F.lit(0))).cast("long").alias("tokens"))),
        )
        delta = changes.select(F.explode(signed).alias("d")).where("d IS NOT NULL").select("d.*").groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        attempt = f"{self.folder}/deltas/{uuid.uuid4().hex}"
        # Groups, not rows: a file will do.
        delta.coalesce(1).write.parquet(attempt)
        waiting, gone = [*now.get("deltas", []), attempt], now.get("gone", [])
        told = {"deltas": waiting}
        if len(waiting) > self.compact:
            snapshot = f"{self.folder}/deltas/{uuid.uuid4().hex}"
            self._summed([*now.get("snapshot", []), *waiting]).coalesce(1).write.parquet(snapshot)
            # What the snapshot replaces stays until the next one, for those who are reading it.
            told = {"deltas": [], "snapshot": [snapshot], "gone": [*now.get("snapshot", []), *waiting]}
        self.log.publish(now, batch, **told)
        if len(waiting) > self.compact:
            for folder in gone:
                self.log.remove(folder)
        return True

    def _summed(self, folders: list[str]) -> DataFrame:
        read = self.spark.read.schema(DELTA).parquet(*folders)
        return read.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents != 0 OR tokens != 0")

    def totals(self) -> DataFrame:
        """(source, lang, version, documents, tokens) over all committed batches; groups that came to nothing are left out."""
        now = self.log.newest()
        folders = [*now.get("snapshot", []), *now.get("deltas", [])]
        return self._summed(folders) if folders else self.spark.createDataFrame([], DELTA)


def counted(docs: DataFrame, version: str, path: str = RANKS) -> DataFrame:
    """(doc_id, content, source, lang, version, tokens) of every row; content is the text's whole digest."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("content"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("version"), token_count(F.col("text"), path).alias("tokens"))


def _changes(op: str, new: DataFrame | None, old: DataFrame | None) -> DataFrame:
    rows = new if new is not None else old
    nothing = {c: F.lit(None).cast("long" if c == "tokens" else "string").alias(c) for c in (*KEYS, "tokens")}
    columns = [F.col(c) if new is not None else nothing[c] for c in nothing]
    olds = [(F.col(c if new is None else f"old_{c}") if old is not None else nothing[c]).alias(f"old_{c}") for c in nothing]
    return rows.select(F.lit(op).alias("op"), *columns, *olds)


def inserts(rows: DataFrame) -> DataFrame:
    return _changes("insert", rows, None)


def deletes(rows: DataFrame) -> DataFrame:
    return _changes("delete", None, rows)


def revisions(rows: DataFrame) -> DataFrame:
    """rows has the new counts, and the old ones as old_source, old_lang, old_version and old_tokens."""
    return _changes("revise", rows, rows)


def token_rollup(docs: DataFrame, folder: str, path: str = RANKS) -> DataFrame:
    """Totals after three batches over docs, the second sent twice.

    All rows are inserted under tokenizer version bpe-1; rows whose text an earlier row has
    too are deleted; the rest is revised to version bpe-2, which also counts an end-of-text
    token. Rows stand by doc_id (null last), source and lang (nulls first); of rows that tie
    in all of them any one stays. Null and empty texts have no tokens of their own; very long
    ones are counted whole. A null text is no copy of another. An empty table gives no rows.
    Columns besides doc_id, text, source and lang are not read.
    """
    rows = materialise(counted(docs, "bpe-1", path).withColumn("row", F.monotonically_increasing_id()))
    # Counts are combined before the shuffle, and what isn't repeated, as null texts, goes no further.
    again = materialise(rows.where("content IS NOT NULL").groupBy("content").count().where("count > 1").select("content"))
    shared = join_checked(rows, again, ["content"], "left_semi", 64)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "source", "lang", "row")
    firsts = materialise(shared.groupBy("content").agg(F.min(place).alias("first")).select("content", F.col("first.row").alias("first")))
    ranked = materialise(join_checked(rows, firsts, ["content"], "left", 72).withColumn("copy", F.coalesce(F.col("first") != F.col("row"), F.lit(False))))
    revised = ranked.where(~F.col("copy")).select("source", "lang", F.lit("bpe-2").alias("version"), (F.col("tokens") + 1).alias("tokens"), *[F.col(c).alias(f"old_{c}") for c in (*KEYS, "tokens")])
    rollup = Rollup(docs.sparkSession, folder)
    rollup.commit("1-load", inserts(rows))
    rollup.commit("2-copies", deletes(ranked.where("copy")))
    rollup.commit("3-end-of-text", revisions(revised))
    rollup.commit("2-copies", deletes(ranked.where("copy")))
    return rollup.totals()


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup(table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/rollup-{uuid.uuid4().hex}")


QUERIES = {"op5_token_rollups": op5}
SQL: dict[str, str] = {}
