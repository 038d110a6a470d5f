"""Queries of the ranked searches; vectors and documents are aligned by vec_id = doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import bm25
from loomtext.functions import vectors as V
from loomtext.operators import index, search
from loomtext.plans import sql
from loomtext.plans.index_queries import QUERY, doc_chunks
from loomtext.sources import providers
from loomtext.sources.tables import table

K = 10


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _query(spark: SparkSession, sf_dir: str) -> list[float]:
    """One row: the vector of the least id."""
    return [float(x) for x in _vectors(spark, sf_dir).where("embedding IS NOT NULL").orderBy("id").first()["embedding"]]


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_chunks(spark, sf_dir).join(_vectors(spark, sf_dir), "id", "left")


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.distances(_vectors(spark, sf_dir), _query(spark, sf_dir)).select("id", F.round("distance", 6).alias("distance"))


def semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.semantic_search(_vectors(spark, sf_dir), _query(spark, sf_dir), K).select("id", F.round("distance", 6).alias("distance"))


def semantic_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector among all."""
    rows = _vectors(spark, sf_dir)
    found = search.semantic_search_many(rows, rows.select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), K)
    return found.select("query_id", "rank", F.round("distance", 6).alias("distance"))


def semantic_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = search.semantic_search(_vectors(spark, sf_dir), _query(spark, sf_dir), K)
    return table(spark, sf_dir, "documents").join(F.broadcast(best), F.col("doc_id") == F.col("id")).select("doc_id", "lang", "source", F.round("distance", 6).alias("distance"))


def keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_chunks(spark, sf_dir)
    # Documents without terms are candidates too, as rows without a vector.
    found = rows.select("id").join(search.scored(rows, search.ask(rows, QUERY)), "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return found.orderBy(F.desc("score"), "id").limit(3 * K).select("id", F.round("score", 6).alias("score"))


def keyword_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents for every benchmark passage, by summed weights of shared terms. Only the passages' terms are counted."""
    rows, items = doc_chunks(spark, sf_dir), table(spark, sf_dir, "benchmark")
    asked = items.select("item_id", F.explode(bm25.tokenize(F.col("text"))).alias("term"))
    words = asked.select("term").distinct()
    hits = index.term_counts(rows, spread=False, words=words)
    # With tf, which is never 0, this reads the same shuffle as what follows, and texts are taken apart once.
    freqs = hits.where("tf > 0").groupBy("term").agg(F.count("*").alias("doc_freq"))
    weighed = hits.join(freqs, "term").crossJoin(F.broadcast(index.corpus_stats(rows)))
    w = bm25.weight(bm25.idf(F.col("n"), F.col("doc_freq")), F.col("tf"), F.greatest(F.col("token_count"), F.lit(1)), F.col("avg_len"))
    told = weighed.select("id", "term", w.alias("w")).join(asked, "term").groupBy("item_id", "id").agg(F.round(F.sum("w"), 6).alias("score"))
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), "id")
    return told.withColumn("rank", F.row_number().over(by)).where("rank <= 5").select("item_id", "rank", "id", "score")


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_chunks(spark, sf_dir)
    found = search.hybrid(_chunks(spark, sf_dir), search.scored(docs, search.ask(docs, QUERY)), _query(spark, sf_dir), K, 0.7)
    return found.select("source_id", "chunk", "dense_rank", "sparse_rank", F.round("rrf_score", 9).alias("rrf_score"))


def hybrid_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_chunks(spark, sf_dir)
    found = search.hybrid_simple(_chunks(spark, sf_dir), search.scored(docs, search.ask(docs, QUERY)), _query(spark, sf_dir), K)
    return found.select("source_id", "chunk", F.round("rrf_score", 9).alias("rrf_score"))


def alpha_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists are the same for each alpha, so their few rows are worked out once."""
    docs = doc_chunks(spark, sf_dir)
    found = search.lists(_chunks(spark, sf_dir), search.scored(docs, search.ask(docs, QUERY)), _query(spark, sf_dir), K)
    dense, sparse = (spark.createDataFrame(x.toArrow()) for x in found)
    parts = [search.fused(dense, sparse, a).orderBy(F.desc("rrf_score"), "id").limit(K).withColumn("alpha", F.lit(a)) for a in (0.0, 0.3, 0.7, 1.0)]
    best = parts[0]
    for p in parts[1:]:
        best = best.union(p)
    told = docs.select("id", "source_id").join(F.broadcast(best), "id")
    return told.select("alpha", F.col("source_id").cast("string").alias("source_id"), "dense_rank", "sparse_rank", F.round("rrf_score", 9).alias("rrf_score"))


def vector_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("id", V.vector_text(F.col("embedding")).alias("vector"))


def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offline embeddings of all documents; they don't depend on how texts are batched."""
    rows = table(spark, sf_dir, "documents").where(index.has_text(F.col("text"))).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return providers.embedded(rows, providers.HashProvider(dims=64), 50)


QUERIES = {
    "cosine_distance_all": distances,
    "semantic_topk": semantic,
    "semantic_topk_all_queries": semantic_many,
    "semantic_join_source": semantic_join,
    "keyword_search": keyword,
    "keyword_search_benchmark": keyword_benchmark,
    "hybrid_search": hybrid,
    "hybrid_search_simple": hybrid_simple,
    "hybrid_alpha_sweep": alpha_sweep,
    "vector_text_format": vector_text,
    "embed_hash_provider": embed_hash,
}

_FIRST = "p as (select embedding::double[] q from embeddings where embedding is not null order by vec_id limit 1)"
_DISTANCE = "d as (select vec_id id, 1 - list_cosine_similarity(embedding::double[], q) distance from embeddings, p)"
_SCORES = f"with {sql.VECTORS}, {sql.query_vector(f"'{QUERY}'")}, score as (select doc_id id, round(coalesce(s, 0), 9) score from documents left join (select id, sum(vec.w * q.w) s from vec join q using (dim) group by id) x on x.id = doc_id)"


def _fused(columns: str, alphas: str = "(values (0.7::double)) a(alpha)") -> str:
    return f"""{_SCORES}, {_FIRST}, {_DISTANCE},
dense as (select id, row_number() over (order by distance, id)::int r from (select * from d join documents on doc_id = id order by distance, id limit {3 * K})),
sparse as (select id, row_number() over (order by score desc, id)::int r from (select score.* from score where id in (select id from vec) order by score desc, id limit {3 * K})),
f as (select coalesce(dense.id, sparse.id) id, coalesce(dense.r, 9999) dense_rank, coalesce(sparse.r, 9999) sparse_rank from dense full join sparse on dense.id = sparse.id),
s as (select alpha, f.*, alpha / (60::double + dense_rank) + (1::double - alpha) / (60::double + sparse_rank) rrf_score from f, {alphas}),
best as (select *, row_number() over (partition by alpha order by rrf_score desc, id) place from s)
select {columns} from best join documents on doc_id = best.id where place <= {K}"""


SQL = {
    "cosine_distance_all": f"with {_FIRST}, {_DISTANCE} select id, round(distance, 6) distance from d",
    "semantic_topk": f"with {_FIRST}, {_DISTANCE} select id, round(distance, 6) distance from d order by d.distance, id limit {K}",
    "semantic_topk_all_queries": f"""with e as (select vec_id id, embedding::double[] v from embeddings),
x as (select a.id query_id, b.id, 1 - list_cosine_similarity(a.v, b.v) distance from e a, e b),
r as (select *, row_number() over (partition by query_id order by distance, id)::int rank from x)
select query_id, rank, round(distance, 6) distance from r where rank <= {K}""",
    "semantic_join_source": f"with {_FIRST}, {_DISTANCE}, b as (select * from d order by distance, id limit {K}) select doc_id, lang, source, round(distance, 6) distance from b join documents on doc_id = id",
    "keyword_search": f"{_SCORES} select id, round(score, 6) score from score order by score.score desc, id limit {3 * K}",
    "keyword_search_benchmark": f"""with {sql.INDEX}, asked as (select distinct item_id, term from (select item_id, unnest({sql.tokens('text')}) term from benchmark)),
hits as (select item_id, id, round(sum({sql.weight(sql.idf('n', 'doc_freq'), 'tf', 'greatest(token_count, 1)', 'avg_len')}), 6) score from tf join df using (term) join asked using (term), st group by item_id, id),
r as (select *, row_number() over (partition by item_id order by score desc, id)::int rank from hits)
select item_id, rank, id, score from r where rank <= 5""",
    "hybrid_search": _fused("doc_id::varchar source_id, text chunk, dense_rank, sparse_rank, round(rrf_score, 9) rrf_score"),
    "hybrid_search_simple": _fused("doc_id::varchar source_id, text chunk, round(rrf_score, 9) rrf_score"),
    "hybrid_alpha_sweep": _fused("alpha, doc_id::varchar source_id, dense_rank, sparse_rank, round(rrf_score, 9) rrf_score", "(values (0::double), (0.3), (0.7), (1)) a(alpha)"),
    "vector_text_format": "select vec_id id, '[' || array_to_string(list_transform(embedding, lambda x: format('{:.6f}', x::double)), ',') || ']' vector from embeddings",
}
