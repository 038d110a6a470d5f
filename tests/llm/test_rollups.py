"""Rollups: plain sums, every kind of change, odd batch ids, snapshots, and drivers lost half-way."""

import base64
from collections import Counter

import pytest

from loomtext.llm import rollups as R

SCHEMA = "op string, source string, lang string, version string, tokens long, old_source string, old_lang string, old_version string, old_tokens long"


def totals(roll):
    return {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in roll.totals().collect()}


def test_token_rollup_against_plain_python(spark, tmp_path):
    import regex

    rows = [(i, t, s, lang) for i, (t, s, lang) in enumerate([("a b", "x", "en"), ("a b", "y", "en"), ("héllo wörld 12", "x", "de"), ("", "x", "en"), ("", "x", "en"), (None, "x", None), (None, None, "en"), ("z" * 90_000 + " end", "y", "en")])]
    rows += [(0, "a b", "x", "en"), (None, "a b", "w", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 tokens", "'v' version", "2 row")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(R.RANKS, "rb"))}

    def tokens(text):
        n = 0
        for word in regex.findall(R.PATTERN, text or ""):
            parts = [bytes([b]) for b in word.encode()]
            if len(parts) > 1000:
                import tiktoken

                n += len(tiktoken.Encoding("t", pat_str=R.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(word))
                continue
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 10**9))
                if parts[best] + parts[best + 1] not in ranks:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            n += len(parts)
        return n

    want: Counter = Counter()
    documents: Counter = Counter()
    seen = set()
    for d, text, source, lang in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2] or "", r[3] or "")):
        if text is None or text not in seen:
            seen.add(text)
            want[source, lang, "bpe-2"] += tokens(text) + 1
            documents[source, lang, "bpe-2"] += 1
    got = {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in R.token_rollup(docs, str(tmp_path / "r")).collect()}
    assert got == {k: (documents[k], want[k]) for k in documents}


def test_changes_of_every_kind(spark, tmp_path):
    roll = R.Rollup(spark, str(tmp_path / "r"))
    rows = [("insert", "a", "en", "v1", 5, None, None, None, None), ("insert", "a", "en", "v1", None, None, None, None, None), ("delete", None, None, None, None, "b", "en", "v1", 7), ("revise", "a", None, "v2", 9, "a", "en", "v1", 5), (None, "a", "en", "v1", 99, None, None, None, None), ("other", "a", "en", "v1", 99, None, None, None, None)]
    assert roll.commit("x", spark.createDataFrame(rows, SCHEMA))
    assert totals(roll) == {("a", "en", "v1"): (1, 0), ("b", "en", "v1"): (-1, -7), ("a", None, "v2"): (1, 9)}
    assert roll.commit("none", spark.createDataFrame([], SCHEMA)) and not roll.commit("none", spark.createDataFrame([], SCHEMA))


@pytest.mark.parametrize("batch", [".hidden", "a/b", "../up", "é ü", "x" * 300, ""])
def test_any_id_counts_once(spark, tmp_path, batch):
    roll = R.Rollup(spark, str(tmp_path / "r"))
    one = spark.createDataFrame([("insert", "a", "en", "v", 1, None, None, None, None)], SCHEMA)
    assert roll.commit(batch, one) and not roll.commit(batch, one)
    assert totals(R.Rollup(spark, str(tmp_path / "r"))) == {("a", "en", "v"): (1, 1)}


def test_snapshots_and_old_ids(spark, tmp_path):
    roll = R.Rollup(spark, str(tmp_path / "r"), compact=3)
    roll.log.recent = 2
    one = spark.createDataFrame([("insert", "a", "en", "v", 2, None, None, None, None)], SCHEMA)
    for k in range(11):
        assert roll.commit(f"b{k}", one)
        assert totals(roll) == {("a", "en", "v"): (k + 1, 2 * k + 2)}
        now = roll.log.newest()
        assert len(now["deltas"]) <= 3 and len(now["batches"]) <= 2
    assert not any(roll.commit(f"b{k}", one) for k in range(11))
    kept = [p for p in (tmp_path / "r" / "deltas").iterdir() if p.is_dir()]
    assert len(kept) <= 9


def test_a_driver_lost_before_its_commit(spark, tmp_path, monkeypatch):
    roll = R.Rollup(spark, str(tmp_path / "r"))
    one = spark.createDataFrame([("insert", "a", "en", "v", 2, None, None, None, None)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(roll.log, "write_new", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            roll.commit("b", one)
    assert totals(roll) == {} and roll.commit("b", one) and totals(roll) == {("a", "en", "v"): (1, 2)}
    # Of two writers that began from one state the second fails, and may try again.
    now = roll.log.newest()
    roll.log.publish(now, "c", deltas=now["deltas"])
    with pytest.raises(Exception, match="(?i)exist"):
        roll.log.publish(now, "d", deltas=now["deltas"])
    assert not roll.log.seen("d") and roll.log.seen("c")


def test_hot_text(spark, tmp_path):
    """A third of all rows hold one text, another third none."""
    n = 3_000
    docs = spark.range(n).selectExpr("id doc_id", "CASE id % 3 WHEN 0 THEN 'one text' WHEN 1 THEN concat('text ', id) END text", "'s' source", "'en' lang")
    got = {(r.source, r.lang, r.version): r.documents for r in R.token_rollup(docs, str(tmp_path / "r")).collect()}
    assert got == {("s", "en", "bpe-2"): 2 * n // 3 + 1}
