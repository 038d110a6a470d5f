"""The pipeline against plain Python versions of its stages, on a small table."""

import math

import corpus_pipeline
from loomtext.llm import curriculum, minhash, pieces
from loomtext.llm import quality as Q
from tests.llm.test_methods import plain_positions, split_words
from tests.llm.test_quality import plain_em, plain_votes
from tests.llm.test_runs import brute

TABLE = "/root/testdata/sf0.001"


def shingles(text):
    w = split_words(text)
    return {tuple(w[i : i + minhash.SHINGLE]) for i in range(len(w) - minhash.SHINGLE + 1)} or ({tuple(w)} if w else set())


def plain_pipeline(rows):
    """(doc_id, text, source, position, epoch) of all that is placed."""
    cast = [plain_votes(t) for _, t, _ in rows]
    rows = [r for r, v, p in zip(rows, cast, plain_em(cast)) if p >= Q.KEEP_FROM or set(v) == {Q.SILENT}]
    rows = [(d, t, s) for (d, _, s), t in zip(rows, brute([t for _, t, _ in rows])) if t]
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][1] == rows[j][1] or both and both >= minhash.THRESHOLD * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    rows = [r for i, r in enumerate(rows) if find(i) == i]
    supply: dict = {}
    for _, t, s in rows:
        supply[s] = supply.get(s, 0) + len(t)
    schedule = [(s, t, w) for s, n in supply.items() for t, w in ((0.0, n), (curriculum.TURN, n), (1.0, math.pow(n, curriculum.TEMPER)))]
    # Weights are shares at each knot: plain_positions() normalises them.
    placed = plain_positions(rows, schedule, sum(supply.values()))
    text = {d: t for d, t, _ in rows}
    return [(d, text[d], s, p, e) for d, s, e, p in placed]


def test_run_against_plain_python(spark):
    docs = spark.read.parquet(f"{TABLE}/documents.parquet").orderBy("doc_id").collect()
    want = plain_pipeline([(r.doc_id, r.text, r.source) for r in docs])
    got = pieces.decoded(corpus_pipeline.run(spark, TABLE)).orderBy("part", "place").collect()
    assert sorted((r.doc_id, r.epoch, r.text) for r in got) == sorted((d, e, t) for d, t, _, _, e in want)
    assert all(r.lossless for r in got) and len(got) > 100
    at = {(d, e): p for d, _, _, p, e in want}
    order = [at[r.doc_id, r.epoch] for r in got]
    assert all(b > a - 1e-3 for a, b in zip(order, order[1:]))


def test_stages_on_odd_tables(spark):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "a", 0, 2), (1, "", "en", "a", 0, 2), (2, "word " * 40_000, "en", "a", 200_000, 3), (None, "some words", None, None, 10, 4), (3, "x", "en", "b", 1, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part int").selectExpr("*", "'e' epoch", "'p' place")
    for name, stage in corpus_pipeline.STAGES:
        for now in (docs, docs.limit(0)):
            got = stage(spark, now, "")
            assert name.startswith("Sentence") or got.columns == docs.columns
            assert (got.count() > 0) == (now is docs)
    assert stage(spark, docs, "").where("ids IS NULL AND n_pieces IS NOT NULL").count() == 0
