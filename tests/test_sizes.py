"""Tasks follow the text there is, and lists that several results share are worked out once."""

from pyspark.sql import functions as F

import __spark_entry__
from loomtext.config import EngineConfig
from loomtext.operators import changes, index
from loomtext.operators.engine import Engine


def _documents(spark, folder):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("water night"), F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))).alias("text"))
    rows.write.parquet(f"{folder}/documents.parquet")
    rows.select(F.col("doc_id").alias("vec_id"), F.array(F.col("doc_id").cast("float"), F.lit(1.0).cast("float")).alias("embedding")).write.parquet(f"{folder}/embeddings.parquet")


def test_terms_are_counted_in_tasks_of_some_text(spark, tmp_path, monkeypatch):
    _documents(spark, tmp_path)
    monkeypatch.setattr(index, "TERM_BYTES", 100, raising=False)
    for name, rows in (("bm25_term_freq", 600), ("bm25_doc_vectors", 600), ("bm25_sparse_text", 200)):
        found = __spark_entry__.queries()[name](spark, str(tmp_path))
        assert found.count() == rows
        assert found.rdd.getNumPartitions() > 25, name


def test_sweep_ranks_once(spark, tmp_path):
    _documents(spark, tmp_path)
    found = __spark_entry__.queries()["hybrid_alpha_sweep"](spark, str(tmp_path))
    assert found.count() == 40
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_first_backfill_compares_with_nothing(spark, tmp_path, monkeypatch):
    def upsert(*args):
        raise AssertionError("joined with an empty table")

    monkeypatch.setattr(changes, "upsert", upsert)
    rows = spark.createDataFrame([(1, "alpha"), (2, ""), (3, None), (4, "beta")], "id long, body string")
    engine = Engine(spark, str(tmp_path / "e"), EngineConfig(provider="hash"), buckets=2)
    assert engine.enable("docs", rows, "body", "2024-01-01 00:00:00") == 2
    store = engine.store(engine.find("docs"))
    assert sorted((r.source_id, r.content, r.embedding) for r in store.read("chunks").collect()) == [(1, "alpha", None), (4, "beta", None)]
    assert sorted((r.content, r.status, r.metadata) for r in store.read("queue").collect()) == [("alpha", "pending", None), ("beta", "pending", None)]


def test_benchmark_takes_texts_apart_once(spark, tmp_path):
    _documents(spark, tmp_path)
    spark.createDataFrame([(1, "water wb"), (2, "night wc")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = __spark_entry__.queries()["keyword_search_benchmark"](spark, str(tmp_path))
    assert sorted((r.item_id, r.id) for r in found.collect() if r["rank"] == 1) == [(1, 1), (2, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("FileScan" in line and "doc_id" in line for line in plan.split("\n")) == 1
