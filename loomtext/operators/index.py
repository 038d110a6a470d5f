"""Chunk tables and their sparse index: terms, statistics, document and query vectors.

A chunk table has id, source_id, chunk_index, content and token_count. Text is shuffled at
most once, by id; term frequencies and vectors then need no further exchange for it. The
joins with document frequencies carry no broadcast hint: the adaptive planner broadcasts a
side whose measured size allows it and shuffles both otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.config import EngineConfig
from loomtext.functions import bm25
from loomtext.functions.chunking import chunk_text
from loomtext.functions.text import token_count
from loomtext.sources.tables import lean


#: Text of one task where terms are counted: its hash tables need some twenty times as much.
TERM_BYTES = 8 << 20


def has_text(column: Column, trim: bool = False) -> Column:
    """Not null and not empty; with trim, blanks at the ends don't count as text."""
    return column.isNotNull() & ((F.btrim(column, F.lit(" ")) if trim else column) != "")


def chunks(rows: DataFrame, pk: str, column: str, strategy: str | None = None, size: int | None = None, overlap: int | None = None, config: EngineConfig | None = None, trim: bool = False) -> DataFrame:
    """(source_id, chunk_index, content, token_count) of all rows with text; chunk_index counts from 1."""
    lean(rows.sparkSession)
    text = F.btrim(F.col(column), F.lit(" ")) if trim else F.col(column)
    cut = rows.where(has_text(F.col(column), trim)).select(F.col(pk).alias("source_id"), F.posexplode(chunk_text(text, strategy, size, overlap, config)).alias("at", "content"))
    return cut.select("source_id", (F.col("at") + 1).alias("chunk_index"), "content", token_count(F.col("content")).alias("token_count"))


def with_ids(found: DataFrame) -> DataFrame:
    """A stable id for each chunk from its key and content: it survives reruns, and a changed chunk has another."""
    return found.select(F.xxhash64(F.col("source_id").cast("string"), F.col("chunk_index"), F.col("content")).alias("id"), "*")


def parts_of(table: DataFrame) -> int:
    """Tasks for what groups by id and term, by the text there is; one for each core at least."""
    size = table.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    return max(size // TERM_BYTES + 1, table.sparkSession.sparkContext.defaultParallelism)


def term_counts(table: DataFrame, spread: bool = True, words: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(id, token_count, term, tf), of all terms or those in words(term).

    With spread the text is first shuffled by id into parts, so what groups by id later stays
    in place and a task's hash tables don't grow with the text; without, counts are combined
    before they are shuffled.
    """
    slim = table.select("id", "content", "token_count")
    slim = slim.repartition(parts or parts_of(slim), "id") if spread else slim
    each = slim.select("id", "token_count", F.explode(bm25.tokens(F.col("content"))).alias("term"))
    if words is not None:
        each = each.join(words, "term", "left_semi").select("id", "token_count", "term")
    return each.groupBy("id", "token_count", "term").agg(F.count("*").alias("tf"))


def doc_freqs(table: DataFrame) -> DataFrame:
    """(term, doc_freq): in how many chunks a term stands. Terms are made distinct within the row, before the shuffle."""
    return table.select(F.explode(bm25.tokenize(F.col("content"))).alias("term")).groupBy("term").agg(F.count("*").alias("doc_freq"))


def corpus_stats(table: DataFrame) -> DataFrame:
    """One row (n, avg_len): at least 1 chunk, and 1.0 for an average that isn't positive."""
    mean = F.avg("token_count")
    return table.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), F.when(mean > 0, mean).otherwise(F.lit(1.0)).alias("avg_len"))


def avg_doc_len(table: DataFrame) -> float:
    return float(corpus_stats(table).first()["avg_len"])


def term_idf(table: DataFrame, freqs: DataFrame | None = None) -> DataFrame:
    """(term, doc_freq, idf) of the vocabulary; n is the larger of the chunk count and any doc_freq."""
    freqs = doc_freqs(table) if freqs is None else freqs
    return freqs.crossJoin(F.broadcast(corpus_stats(table))).select("term", "doc_freq", bm25.idf(F.col("n"), F.col("doc_freq")).alias("idf"))


def doc_vectors(table: DataFrame, config: EngineConfig | None = None, freqs: DataFrame | None = None, only: bool = False, stats: tuple[int, float] | None = None) -> DataFrame:
    """(id, dim, w): weights of the terms of a dimension added up, rounded to six decimals, positive ones only.

    A term's dimension is worked out once, with its frequency. Terms that freqs lacks weigh
    as unseen ones, or are left out with only. stats are (n, avg_len), if they are known.
    """
    config = config or EngineConfig()
    freqs = doc_freqs(table) if freqs is None else freqs
    known = freqs.select("term", "doc_freq", bm25.term_dim(F.col("term")).alias("dim"))
    parts = parts_of(table)
    counted = term_counts(table, parts=parts)
    if not only:  # else known is a query's few terms
        counted, known = counted.repartition(parts, "term"), known.repartition(parts, "term")
    counted = counted.join(known, "term", "inner" if only else "left")
    if stats is None:
        counted = counted.crossJoin(F.broadcast(corpus_stats(table)))  # one row
    else:
        counted = counted.withColumns({"n": F.lit(stats[0]), "avg_len": F.lit(float(stats[1]))})
    length = F.greatest(F.col("token_count"), F.lit(1))
    w = bm25.weight(bm25.idf(F.col("n"), F.col("doc_freq")), F.col("tf"), length, F.col("avg_len"), config.bm25_k1, config.bm25_b)
    scored = counted.select("id", F.coalesce("dim", bm25.term_dim(F.col("term"))).alias("dim"), w.alias("w")).where("w > 0")
    # What groups by id later stays in place here, too.
    return scored.repartition(parts, "id").groupBy("id", "dim").agg(F.round(F.sum("w"), 6).alias("w")).where("w > 0")


def query_vector(table: DataFrame, query: str, config: EngineConfig | None = None, freqs: DataFrame | None = None, stats: tuple[int, float] | None = None) -> DataFrame:
    """(dim, w) of a query; its length is its number of distinct terms. Only its own terms are looked up. stats are (n, avg_len), if they are known."""
    config = config or EngineConfig()
    terms = bm25.query_terms(query)
    spark = table.sparkSession
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    if freqs is None:
        mine = table.select(F.explode(F.filter(bm25.tokenize(F.col("content")), lambda t: t.isin(*terms) if terms else F.lit(False))).alias("term"))
        freqs = mine.groupBy("term").agg(F.count("*").alias("doc_freq"))
    else:
        freqs = freqs.where(F.col("term").isin(*terms) if terms else F.lit(False))
    # As many rows as the query has terms.
    known = asked.join(F.broadcast(freqs), "term", "left")
    most = F.broadcast(known.agg(F.coalesce(F.max("doc_freq"), F.lit(0)).alias("most")))
    totals = corpus_stats(table) if stats is None else spark.createDataFrame([(int(stats[0]), float(stats[1]))], "n long, avg_len double")
    each = known.crossJoin(F.broadcast(totals)).crossJoin(most).withColumn("n", F.greatest("n", "most"))
    w = bm25.weight(bm25.idf(F.col("n"), F.col("doc_freq")), F.lit(1), F.lit(len(terms)), F.col("avg_len"), config.bm25_k1, config.bm25_b)
    scored = each.select(bm25.term_dim(F.col("term")).alias("dim"), w.alias("w")).where("w > 0")
    return scored.groupBy("dim").agg(F.round(F.sum("w"), 6).alias("w")).where("w > 0")


def packed(vectors: DataFrame) -> DataFrame:
    """(id, sparse): one sparse text for each id."""
    return vectors.groupBy("id").agg(bm25.sparse_text(F.collect_list(F.struct("dim", "w"))).alias("sparse"))


def decrement(freqs: DataFrame, terms: DataFrame, by: str = "n") -> DataFrame:
    """doc_freq less what terms(term, n) take back, never under 0; null and non-positive n change nothing."""
    back = terms.where(F.col(by) > 0).groupBy("term").agg(F.sum(by).alias("__n"))
    return freqs.join(back, "term", "left").select("term", F.greatest(F.col("doc_freq") - F.coalesce("__n", F.lit(0)), F.lit(0)).alias("doc_freq"))


class CorpusStatsCache:
    """Corpus statistics on the driver by table identity, with an age limit and a use budget.

    A reading may be used max(1, n * pct / 100) times after it was made; pct 0 leaves only the
    age limit, ttl 0 caches nothing.
    """

    def __init__(self, ttl: float = 60, max_uses_pct: int = 5) -> None:
        self.ttl, self.pct = ttl, max_uses_pct
        self._kept: dict[str, list] = {}

    def get(self, key: str, read, now: float) -> tuple[int, float]:
        kept = self._kept.get(key)
        if kept and self.ttl > 0 and now - kept[1] < self.ttl and (not self.pct or kept[2] < max(1, kept[0][0] * self.pct // 100)):
            kept[2] += 1
            return kept[0]
        found = read()
        self._kept[key] = [found, now, 0]
        return found

    def repaired(self, key: str, most: int, read, now: float) -> tuple[int, float]:
        """As get(), but n is read again if a doc_freq contradicts it, and is that doc_freq if it still does."""
        n, mean = self.get(key, read, now)
        if most > n:
            self._kept.pop(key, None)
            n, mean = self.get(key, read, now)
        if most > n:
            n = most
            self._kept[key][0] = (n, mean)
        return n, mean
