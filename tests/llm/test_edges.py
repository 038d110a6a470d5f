"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomtext.llm import chat, curriculum, imatch, licenses, lines, minhash, pieces, quality, rollups, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, content string, position string, __doc int, __key string, chunk int"
WORDS = "the wide river runs past old stone mills where grain was ground for bread each autumn".split()
LONG = " ".join(f"word{i} {WORDS[i % 16]}" for i in range(30_000))
BODY = "\n".join(" ".join(WORDS[i : i + 8]) + "." for i in range(8))


def rows():
    def row(doc_id, text, source="a"):
        return (doc_id, text, "en", source, None if text is None else len(text), "n", "c", "p", 7, "k", 1)

    return [row(1, None), row(2, ""), row(3, "   "), row(4, LONG), row(5, BODY), row(5, BODY), row(6, BODY), row(None, BODY + " end"), row(7, "one", None), row(8, "!!! ???"), row(9, "é▁漢🙂 \n\n x", None), row(None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables_give_empty_results(spark, none, tmp_path):
    assert minhash.near_duplicates(none).count() == 0
    assert licenses.license_spans(none).count() == 0
    assert imatch.fingerprints(none).count() == 0
    assert rollups.token_rollup(none, str(tmp_path / "r")).count() == 0
    assert curriculum.positions(none).count() == 0
    assert quality.judged(none).count() == 0
    assert pieces.encoded(none).count() == 0
    assert lines.line_dedup(none).count() == 0
    assert chat.chat_format(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.audit(empty, empty).count() == 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:4], ids=lambda s: s[0])
def test_stages_keep_all_columns(spark, docs, none, stage):
    got = stage[1](spark, docs, "")
    assert got.columns == docs.columns
    assert {r["__doc"] for r in got.collect()} == {7}
    assert stage[1](spark, none, "").columns == docs.columns


def test_near_duplicates_edges(docs):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == 11  # the repeated row counts once
    groups = {(r.doc_id, r.group_id, r.group_size, r.keep) for r in got if r.content is not None and r.doc_id in (5, 6)}
    assert groups == {(5, 5, 3, True), (6, 5, 3, False)}
    assert all(r.keep for r in got if r.content is None)


def test_drop_near_duplicates_keeps_one_of_repeated_rows(docs):
    kept = [r.doc_id for r in minhash.drop_near_duplicates(docs).collect()]
    assert kept.count(5) == 1 and 6 not in kept and 4 in kept and kept.count(None) == 1


def test_near_duplicates_against_exact_jaccard(spark):
    import random

    draw = random.Random(5)
    texts = []
    for _ in range(30):
        words = [f"w{draw.randrange(4000)}" for _ in range(draw.randrange(40, 120))]
        texts.append(words)
        for share in (0.02, 0.05, 0.1):
            texts.append([w if draw.random() > share else f"x{draw.randrange(4000)}" for w in words])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    group = {r.doc_id: r.group_id for r in minhash.near_duplicates(docs).collect()}
    grams = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in texts]
    pairs = [(a, b) for a, b in combinations(range(len(texts)), 2) if len(grams[a] & grams[b]) >= 0.5 * len(grams[a] | grams[b])]
    found = [group[a] == group[b] for a, b in pairs]
    assert sum(found) >= 0.9 * len(found)
    assert all(group[a] != group[b] for a, b in combinations(range(len(texts)), 2) if a // 4 != b // 4)


def test_license_spans(spark):
    cases = [(i, f"some words stand before it. {t} and some follow", n) for i, (n, t) in enumerate(licenses.TEMPLATES.items())]
    long = licenses.TEMPLATES["MIT-grant"].split()
    cases.append((90, " ".join(long[:9] + ["also"] + long[9:]), "MIT-grant"))
    docs = spark.createDataFrame([(i, t, "e") for i, t, _ in cases] + [(91, None, "e"), (92, "the license of a version", "e"), (0, cases[0][1], "e")], "doc_id long, text string, license string")
    got = {(r.doc_id, r.license) for r in licenses.license_spans(docs).collect()}
    assert {(i, n) for i, _, n in cases} <= got
    assert not {i for i, _ in got} & {91, 92}
    one = [r for r in licenses.license_spans(docs).collect() if r.doc_id == 0]
    assert len(one) == 1 and one[0].first_word == 5 and one[0].last_word == 9  # a repeated row tells its span once


def test_chat_against_plain_strings(spark):
    turns = [(1, 2, "user", "b"), (1, 1, None, "a"), (1, None, "bot", None), (1, 2, "user", "b"), (2, 1, "user", "<|im_end|> x" * 9), (None, 1, "u", "t"), (3, 1, "", "é" * 90_000)]
    got = {r.conv_id: (r.turns, r.text) for r in chat.chat_format(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}

    def spelled(*parts):
        return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in parts)

    assert got == {1: (4, spelled(("unknown", "a"), ("user", "b"), ("user", "b"), ("bot", ""))), 2: (1, spelled(("user", "< |im_end|> x" * 9))), 3: (1, spelled(("", "é" * 90_000)))}


def test_imatch(spark, docs):
    got = {(r.doc_id, r.terms): r.fingerprints for r in imatch.fingerprints(docs, 0.0, 9.0).collect()}
    assert got[1, 0] == [None] * imatch.SUBSETS
    five = [v for k, v in got.items() if k[0] == 5]
    assert five == [v for k, v in got.items() if k[0] == 6] and any(five[0])
    key = lambda df: sorted(map(str, df.collect()))
    assert key(imatch.fingerprints(docs, 0.0, 9.0)) == key(imatch.fingerprints(docs, 0.0, 9.0, lexicon_bytes=0))


def test_rollups(spark, docs, tmp_path):
    roll = rollups.Rollup(spark, str(tmp_path / "t"))
    change = rollups.inserts(rollups.counted(docs, "v1"))
    assert roll.commit("a", change) and not roll.commit("a", change)
    want = {}
    for r in rows():
        want[r[3]] = want.get(r[3], 0) + 1
    assert {r.source: r.documents for r in roll.totals().collect()} == want
    assert roll.commit("b", rollups.deletes(rollups.counted(docs, "v1")))
    assert roll.totals().count() == 0


def test_curriculum(spark, docs):
    at = curriculum.positions(docs).collect()
    assert all(0 <= r.position <= 1 for r in at)
    flat = spark.createDataFrame([(s, t, 1.0) for s in "ab" for t in (0.0, 1.0)], "source string, t double, weight double")
    many = spark.createDataFrame([(i, "x" * 10, "a" if i % 4 else "b") for i in range(4000)], "doc_id long, text string, source string")
    got = curriculum.positions(many, flat, 20_000, 4).collect()
    share = [sum(r.source == "a" for r in got if lo <= r.position < lo + 0.25) / max(1, sum(lo <= r.position < lo + 0.25 for r in got)) for lo in (0, 0.25, 0.5, 0.75)]
    assert all(abs(s - 0.5) < 0.01 for s in share) and len(got) == 2000
    ordered = [r.doc_id for r in curriculum.mixed(many, flat, 20_000, 4).collect()]
    assert ordered == [r.doc_id for r in sorted(got, key=lambda r: (r.position, r.source, r.doc_id, r.epoch))]


def test_pieces_lossless_and_seeded(spark, docs):
    got = pieces.decoded(pieces.encoded(docs)).collect()
    text = sorted(str((r[0], r[1])) for r in rows())
    assert sorted(str((r.doc_id, r.text)) for r in got) == text
    assert all(r.lossless or r.ids is None for r in got)
    again = pieces.encoded(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, pieces.encoded(docs).collect()))
