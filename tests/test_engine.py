"""The chunkers, weights, queue, store and engine on small cases."""

import math

import pytest
from pyspark.sql import functions as F

from loomtext.config import EngineConfig
from loomtext.functions import bm25, chunking, register, text
from loomtext.operators import changes, index, queue, search
from loomtext.operators.engine import Engine
from loomtext.sources import providers

NOW = "2024-01-01 00:00:00"
RAW = EngineConfig(strip_non_ascii=False)


def test_token_chunks():
    three = ["First sentence here.", "Second sentence here.", "Third sentence here."]
    assert chunking.chunk(" ".join(three), "token_based", 5, 0) == three
    four = [f"This is the {n} sentence." for n in ("first", "second", "third", "fourth")]
    assert chunking.chunk(" ".join(four), "token_based", 10, 2) == four
    assert chunking.chunk("This is a short test.", "token_based", 100, 10) == ["This is a short test."]
    assert chunking.chunk("", "token_based", 10, 0) == [] and chunking.chunk(None) is None
    last, before = chunking.chunk("word " * 1000, "token_based", 100, 20)[-1:-3:-1]
    assert before.endswith(last)


@pytest.mark.parametrize(("given", "want"), [("alpha ★★★ beta", "alpha  beta"), ("★★★alpha", "alpha"), ("a🙂b", "a b"), ("★★★", "")])
def test_strip(spark, given, want):
    assert chunking.strip(given.encode()).decode() == want
    assert spark.range(1).select(text.strip_non_ascii(F.lit(given)).alias("x")).first().x == want


@pytest.mark.parametrize(("given", "count", "total"), [("漢" * 200, 5, 600), ("é" * 200, 5, 400), ("🙂" * 100, 3, 400)])
def test_multibyte_offsets(given, count, total):
    got = chunking.chunk(given, "token_based", 10 if count == 5 else 10, 0, RAW)
    assert len(got) == count and sum(len(c.encode()) for c in got) == total


def test_structured_chunks():
    got = chunking.chunk("# Main Title\n\nIntroduction text.\n\n## Subsection\n\nSubsection content here.", "hybrid", 50, 0)
    assert got == ["[Context: # Main Title]\n\n# Main Title\n\nIntroduction text.", "[Context: # Main Title > ## Subsection]\n\n## Subsection\n\nSubsection content here."]
    got = chunking.chunk("# Title\n\nIntro paragraph.\n\n## Subsection\n\nSubsection content.", "markdown", 50, 0)
    assert got == ["[Context: # Title]\n\n# Title", "[Context: # Title]\n\nIntro paragraph.", "[Context: # Title > ## Subsection]\n\n## Subsection", "[Context: # Title > ## Subsection]\n\nSubsection content."]
    rule = chunking.chunk("# Section A\n\nContent A.\n\n---\n\n# Section B\n\nContent B.", "hybrid", 100, 0)
    assert rule == ["[Context: # Section A]\n\n# Section A\n\nContent A.", "[Context: # Section B]\n\n# Section B\n\nContent B."]
    assert chunking.chunk("Some text\n\n```\ncode\n```\n\nThat was the code.", "hybrid", 100, 0) == ["Some text\n\n```\ncode\n```\n\n\nThat was the code."]
    with pytest.warns(UserWarning):
        assert chunking.chunk("plain words", "semantic", 10, 0) == ["plain words"]


def test_sql_functions(spark):
    register.register(spark)
    assert spark.sql("SELECT chunk_text('a b', 'token_based', 10, NULL) x").first().x is None
    assert spark.sql("SELECT bm25_tokenize('The Cat, a cat! and test2') x").first().x == ["cat", "test"]
    assert spark.sql("SELECT * FROM chunk_table('abcdefgh', 'token_based', 10, 0)").first().asDict() == {"chunk_index": 1, "content": "abcdefgh", "token_count": 2}


def test_terms(spark):
    given = ["don't CAFÉ a1b K", "x" * 127 + " " + "y" * 128, "", None, "the and of"]
    df = spark.createDataFrame([(g,) for g in given], "t string").select(bm25.tokenize(F.col("t")).alias("x"))
    got = [r.x for r in df.collect()]
    assert got == [["don", "t", "caf", "b"], ["x" * 127], [], None, []]
    assert [bm25.query_terms(g) for g in given[:3]] == got[:3]
    assert (bm25.dim_of("alpha"), bm25.dim_of("beta"), bm25.dim_of("postgres")) == (25682, 13912, 42495)


def test_idf_ratio(spark):
    row = spark.range(1).select((bm25.idf(F.lit(220), F.lit(5)) / bm25.idf(F.lit(20), F.lit(5))).alias("x"), bm25.idf(F.lit(10), F.lit(20)).alias("y")).first()
    assert abs(row.x - math.log(221 / 5.5) / math.log(21 / 5.5)) < 1e-12 and row.y > 0


def test_stats_cache():
    cache, reads = index.CorpusStatsCache(60, 5), []

    def read():
        reads.append(1)
        return 40 * len(reads), 1.0

    for _ in range(3):
        cache.get("t", read, 0)
    assert len(reads) == 1
    cache.get("t", read, 0)
    assert len(reads) == 2 and cache.get("t", read, 61) == (120, 1.0)
    assert cache.repaired("t", 5000, read, 61) == (5000, 1.0)


def _queue(spark):
    rows = [(1, 10, "c", "x", "pending", 0, 3), (2, 11, "c", "y", "processing", 2, 3), (3, 12, "c", "z", "failed", 1, 3), (4, 13, "c", "z", "failed", 3, 3)]
    return spark.createDataFrame([(*r, None, None, None, None, None, None) for r in rows], queue.COLUMNS).withColumn("created_at", F.to_timestamp(F.lit(NOW)))


def test_queue(spark):
    told = spark.createDataFrame([(1, "it's " + "x" * 1017 + "世"), (2, "bad"), (3, None)], "id long, error string")
    got = {r.id: r for r in queue.transition(_queue(spark), told, NOW).collect()}
    assert (got[1].status, got[1].attempts, str(got[1].next_retry_at), len(got[1].error_message.encode())) == ("pending", 1, "2024-01-01 00:01:00", 1022)
    assert (got[2].status, got[2].attempts, got[2].next_retry_at) == ("failed", 3, None)
    assert got[3].status == "failed"
    again = {r.id: r.status for r in queue.retry_failed(_queue(spark), "2024-01-01 01:00:00").collect()}
    assert again == {1: "pending", 2: "processing", 3: "pending", 4: "failed"}
    wait = queue.Backoff()
    assert [wait.failed() for _ in range(8)] == [5, 10, 20, 40, 80, 160, 300, 300]
    assert queue.rotation(["a", "b", "c"], {"a": 0, "b": 50}, 2, 70, 60) == (["a"], ["c"])


def test_config():
    assert len(EngineConfig().items()) == 21
    with pytest.raises(ValueError, match="batch_size"):
        EngineConfig(batch_size=0)


def test_providers(spark, tmp_path):
    key = tmp_path / "key"
    key.write_text(" ab c\n")
    key.chmod(0o600)
    assert providers.read_key(str(key)) == "abc"
    assert providers.parse_headers("a: b; c:d") == {"a": "b", "c": "d"}
    with pytest.raises(ValueError, match="Expected 2 embeddings, got 1"):
        providers.checked([[1.0]], 2)
    rows = spark.createDataFrame([(1, "a b"), (2, ""), (3, "c")], "id long, content string")
    got = {r.id: (r.embedding is not None, r.error is not None) for r in providers.embedded(rows, providers.HashProvider(dims=8), 10).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (True, False)}


def test_engine(spark, tmp_path):
    rows = spark.createDataFrame([(1, "alpha beta gamma " * 20), (2, "delta epsilon zeta " * 20), (3, None), (4, "")], "id long, body string")
    engine = Engine(spark, str(tmp_path / "e"), EngineConfig(provider="hash", enable_hybrid=True, max_retries=7), buckets=4)
    with pytest.raises(ValueError, match="no column"):
        engine.enable("docs", rows, "nope", NOW)
    with pytest.raises(ValueError, match="No vectorizer"):
        engine.hybrid_search("docs", "alpha")
    assert engine.enable("docs", rows, "body", NOW) == 2
    r = engine.find("docs")
    assert engine.drain(r, NOW) == 2 and engine.reprocess(r, NOW) == 0
    best = engine.hybrid_search("docs", "delta", 2).collect()
    assert best[0].source_id == "2" and best[0].sparse_rank == 1
    change = spark.createDataFrame([("delete", 1, "1", "alpha beta gamma " * 20, None), ("insert", 2, "9", None, "eta theta iota")], "op string, seq long, pk string, old_text string, new_text string")
    assert engine.apply(r, "b1", change, NOW) and not engine.apply(r, "b1", change, NOW)
    store = engine.store(r)
    assert {x.source_id for x in store.read("chunks").collect()} == {2, 9}
    waiting = store.read("queue").where("status = 'pending'").collect()
    assert [(w.content, w.max_attempts) for w in waiting] == [("eta theta iota", 7)]
    assert Engine(spark, str(tmp_path / "e")).find("docs") == r
    assert engine.recreate(r, rows, NOW) == 2
    assert engine.disable("docs") == 1 and not engine.registry


def test_decrement_floor(spark):
    freqs = spark.createDataFrame([("a", 5), ("b", 1)], "term string, doc_freq long")
    back = spark.createDataFrame([("a", 1), ("b", 4), ("c", 1), ("a", 0)], "term string, n long")
    assert {r.term: r.doc_freq for r in index.decrement(freqs, back).collect()} == {"a": 4, "b": 0}
    assert changes.net(spark.createDataFrame([], "op string, seq long, pk string, old_text string, new_text string")).count() == 0
    assert search.NO_RANK == 9999


def test_entry_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "loomtext", tmp_path / "loomtext", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) > 40, 'pipeline' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split() == ["True", "False", "True"], said.stderr
