"""Queries of the sparse index, with whole documents as chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import bm25, text
from loomtext.operators import index
from loomtext.plans import sql
from loomtext.sources.tables import table

QUERY = "the water of that heron and this whole night, whether to be or not alpha unseen"


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("source_id"), F.lit(1).alias("chunk_index"), F.col("text").alias("content"), text.token_count(F.col("text")).alias("token_count"))


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_chunks(spark, sf_dir).select("id", F.posexplode(bm25.tokenize(F.col("content"))).alias("at", "term"))


def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_counts(doc_chunks(spark, sf_dir)).select("id", "term", "tf")


def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.doc_freqs(doc_chunks(spark, sf_dir))


def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the vocabulary, and of terms whose statistics are zero or missing."""
    rows = doc_chunks(spark, sf_dir)
    known = index.term_idf(rows).select("term", F.round("idf", 6).alias("idf"))
    n, none = F.lit(10), F.lit(None).cast("long")
    odd = spark.range(1).select(F.explode(F.array(F.struct(F.lit("-zero").alias("term"), F.round(bm25.idf(n, F.lit(0)), 6).alias("idf")), F.struct(F.lit("-unseen").alias("term"), F.round(bm25.idf(n, none), 6).alias("idf")))).alias("x")).select("x.*")
    return known.union(odd)


def term_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.doc_freqs(doc_chunks(spark, sf_dir)).select("term", bm25.term_dim(F.col("term")).alias("dim"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.corpus_stats(doc_chunks(spark, sf_dir)).select("n", F.round("avg_len", 6).alias("avg_len"))


def doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.doc_vectors(doc_chunks(spark, sf_dir))


def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.query_vector(doc_chunks(spark, sf_dir), QUERY)


def stale_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights where a document frequency tells that the chunk count is out of date."""
    freqs = index.doc_freqs(doc_chunks(spark, sf_dir))
    return freqs.select("term", F.round(bm25.idf(F.lit(5), F.col("doc_freq")), 6).alias("idf"))


def decrement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies after each tenth document is taken back, twice over for each of its terms."""
    rows = doc_chunks(spark, sf_dir)
    gone = rows.where("id % 10 = 0").select(F.explode(bm25.tokenize(F.col("content"))).alias("term"), F.lit(2).alias("n"))
    return index.decrement(index.doc_freqs(rows), gone)


def sparse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.packed(index.doc_vectors(doc_chunks(spark, sf_dir)))


QUERIES = {
    "bm25_tokenize": tokenize,
    "bm25_term_freq": term_freq,
    "bm25_doc_freq": doc_freq,
    "bm25_idf": idf,
    "bm25_term_dims": term_dims,
    "bm25_corpus_stats": corpus_stats,
    "bm25_doc_vectors": doc_vectors,
    "bm25_query_vector": query_vector,
    "bm25_df_gt_n_clamp": stale_count,
    "bm25_decrement": decrement,
    "bm25_sparse_text": sparse_text,
}
SQL = {
    "bm25_tokenize": f"""with d as (select doc_id id, {sql.tokens('text')} all_terms from documents),
p as (select id, unnest(all_terms) term, generate_subscripts(all_terms, 1) place from d),
o as (select id, term, min(place) place from p group by id, term)
select id, (row_number() over (partition by id order by place) - 1)::int "at", term from o""",
    "bm25_term_freq": f"with {sql.INDEX} select id, term, tf from tf",
    "bm25_doc_freq": f"with {sql.INDEX} select term, doc_freq from df",
    "bm25_idf": f"with {sql.INDEX} select term, round({sql.idf('n', 'doc_freq')}, 6) idf from df, st union all values ('-zero', 0::double), ('-unseen', round(ln(2::double), 6))",
    "bm25_term_dims": f"with {sql.INDEX} select term, {sql.dim('term')} dim from df",
    "bm25_corpus_stats": f"with {sql.INDEX} select n, round(avg_len, 6) avg_len from st",
    "bm25_doc_vectors": f"with {sql.VECTORS} select id, dim, w from vec",
    "bm25_query_vector": f"with {sql.INDEX}, {sql.query_vector(f"'{QUERY}'")} select dim, w from q",
    "bm25_df_gt_n_clamp": f"with {sql.INDEX} select term, round({sql.idf('5', 'doc_freq')}, 6) idf from df",
    "bm25_decrement": f"with {sql.INDEX}, gone as (select term, 2 * count(distinct id) n from t where id % 10 = 0 group by term) select term, greatest(doc_freq - coalesce(n, 0), 0)::bigint doc_freq from df left join gone using (term)",
    "bm25_sparse_text": f"with {sql.VECTORS} select id, '{{' || string_agg(format('{{}}:{{:.6f}}', dim, w), ',' order by dim) || '}}/65536' sparse from vec group by id",
}
