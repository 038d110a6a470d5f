"""Operators against plain Python: fingerprints, license spans, curriculum positions, trees, pieces."""

import math
import random
from bisect import bisect_right
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest

from loomtext.llm import curriculum, imatch, licenses, pieces, warc
from loomtext.llm import kernels as K

TABLE = "/root/testdata/sf0.001"
M = 2**64


def split_words(text):
    """Lower-cased runs of ASCII letters, digits and bytes beyond."""
    out, now = [], b""
    for b in (text or "").lower().encode() + b" ":
        if 48 <= b < 58 or 97 <= b < 123 or b >= 128:
            now += bytes([b])
        elif now:
            out.append(now)
            now = b""
    return out


def hash_of(word):
    buf = np.frombuffer(word, np.uint8)
    return int(K.span_hashes(buf, np.array([0]), np.array([len(buf)]))[0])


def test_fingerprints(spark):
    docs = spark.read.parquet(f"{TABLE}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, "a b c d e f g"), (900, None), (901, ""), (902, "?!")]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 terms", "'x' row")
    low, high = math.log(4), math.log(40)
    terms = [sorted({hash_of(w) for w in split_words(t)}) for _, t in rows]
    df = Counter(h for t in terms for h in t)
    total = sum(bool(t) for t in terms)
    want = []
    for (doc_id, _), own in zip(rows, terms):
        own = [h for h in own if low <= math.log(total / df[h]) <= high]
        prints = []
        for k in range(imatch.SUBSETS):
            mine = [h for h in own if K.mix_int((h + K.mix_int(k + 1)) % M) % imatch.DROP]
            x = (sum(h * pow(int(imatch._STEP), i, M) for i, h in enumerate(mine)) + len(mine)) % M
            x = K.mix_int(x)
            prints.append(None if len(mine) < imatch.LEAST_TERMS else x - M if x >= M // 2 else x)
        want.append((doc_id, len(own), prints))
    for limit in (imatch.LEXICON_BYTES, 0):
        got = [(r.doc_id, r.terms, r.fingerprints) for r in imatch.fingerprints(table, low, high, limit).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))


def plain_spans(rows, templates):
    """Votes counted in dictionaries, every diagonal of every text and template."""
    runs = {name: [tuple(w[i : i + licenses.GRAM]) for i in range(len(w) - licenses.GRAM + 1)] for name, w in ((n, split_words(t)) for n, t in templates.items())}
    once_of = {}
    for name, own in runs.items():
        count = Counter(own)
        once_of[name] = {r: i for i, r in enumerate(own) if count[r] == 1}
    out = set()
    for doc_id, text in set(rows):
        words = split_words(text)
        found = []
        for name, once in once_of.items():
            lines = defaultdict(list)
            for i in range(len(words) - licenses.GRAM + 1):
                j = once.get(tuple(words[i : i + licenses.GRAM]))
                if j is not None:
                    lines[i - j].append((i, j))
            spans: list[dict] = []
            last = None
            for d, hits in sorted(lines.items(), key=lambda x: (x[1][0][0], x[0])):
                first, end = hits[0][0], max(i for i, _ in hits)
                if last is None or abs(d - last[0]) > licenses.NEAR_DIAGONALS or first - last[1] > licenses.GAP:
                    spans.append({"votes": 0, "first": first, "last": end, "t": []})
                s = spans[-1]
                s["votes"] += len(hits)
                s["first"], s["last"] = min(s["first"], first), max(s["last"], end)
                s["t"] += [j for _, j in hits]
                last = (d, end)
            template = split_words(templates[name])
            for s in spans:
                if s["votes"] < licenses.LEAST_VOTES * len(once):
                    continue
                low = max(0, s["first"] - min(s["t"]))
                high = min(len(words), s["last"] + len(template) - max(s["t"]))
                blocks = [b for b in SequenceMatcher(None, words[low:high], template, autojunk=False).get_matching_blocks() if b.size]
                first, end = low + blocks[0].a, low + blocks[-1].a + blocks[-1].size - 1
                equal, size = sum(b.size for b in blocks), max(len(template), end - first + 1)
                here, there = {low + b.a + i for b in blocks for i in range(b.size)}, {b.b + i for b in blocks for i in range(b.size)}
                numbers = len(template) <= licenses.SHORT

                def telling(w):
                    return w in licenses.MARKS or numbers and w.isdigit() and len(w) <= 2

                if equal / size >= licenses.LEAST_EQUAL and all(i in there for i, w in enumerate(template) if telling(w)) and all(i in here for i in range(first, end + 1) if telling(words[i])):
                    found.append((size - 2 * equal, -equal / size, name, first, end, s["votes"], round(equal / size, 6)))
        kept: list[tuple] = []
        for f in sorted(found):
            if all(2 * (min(f[4], k[4]) - max(f[3], k[3]) + 1) < min(f[4] - f[3], k[4] - k[3]) + 1 for k in kept):
                kept.append(f)
        out |= {(doc_id, *f[2:]) for f in kept}
    return out


def test_license_spans(spark):
    docs = spark.read.parquet(f"{TABLE}/documents.parquet")
    draw = random.Random(8)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    names = sorted(n for n, t in licenses.TEMPLATES.items() if len(t) < 20_000)
    for i in range(len(names)):
        words = licenses.TEMPLATES[names[i % len(names)]].split()
        cut = [w for w in words if draw.random() > 0.04]
        at = draw.randrange(len(cut) + 1)
        rows.append((100_000 + i, "some lines before " + " ".join([*cut[:at], *["more"] * (i % 4), *cut[at:]]) + " and behind"))
    long = "word " * 50_000 + licenses.TEMPLATES["MIT-grant"] + " word" * 50_000
    rows += [(None, long), (None, None), (7_000, ""), (7_001, licenses.TEMPLATES["MIT-line"]), (7_001, licenses.TEMPLATES["MIT-line"])]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 votes", "'x' license", "'y' content")
    got = [(r.doc_id, r.license, r.first_word, r.last_word, r.votes, r.equal) for r in licenses.license_spans(table).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_spans(rows, licenses.TEMPLATES)


def plain_positions(rows, schedule, budget):
    """Each document's position by bisecting its source's demand, which is summed up in small steps."""
    import hashlib

    pools = defaultdict(list)
    for doc_id, text, source in set(rows):
        pools[source or ""].append((hashlib.md5(f"{curriculum.SEED}{'' if doc_id is None else doc_id}".encode()).hexdigest(), doc_id, len(text or ""), source))
    knots = sorted({t for _, t, _ in schedule})
    weight = {(s, t): w for s, t, w in schedule}
    every = {s for s, _, _ in schedule}
    steps = 40_000
    out = []
    for pool, docs in pools.items():
        supply = sum(d[2] for d in docs)
        if not supply:
            out += [(d[1], d[3], 0, 0.0) for d in docs]
            continue
        share = {t: weight.get((pool, t), 0) / max(1e-300, sum(weight.get((s, t), 0) for s in every)) for t in knots}
        grid = [i / steps for i in range(steps + 1)]
        at = [np.interp(t, knots, [share[k] for k in knots]) for t in grid]
        demand = np.r_[0, np.cumsum((np.array(at[1:]) + at[:-1]) / 2)] / steps * budget
        before = 0
        docs.sort(key=lambda d: (d[0], d[1] is not None, d[1] or 0, d[2]))
        for _, doc_id, size, source in docs:
            epoch = 0
            while (middle := epoch * supply + before + size / 2) <= demand[-1] + 1e-9 and (size or not epoch) and demand[-1] > 0:
                out.append((doc_id, source, epoch, float(np.interp(middle, demand, grid))))
                epoch += 1
            before += size
    return out


def test_positions(spark):
    draw = random.Random(5)
    rows = [(i, "x" * draw.randrange(400), draw.choice(["a", "a", "a", "b", None])) for i in range(300)]
    rows += [(3, rows[3][1], rows[3][2]), (1000, None, "a"), (1001, "", "b"), (1002, None, "bare"), (1003, "", "bare"), (None, "y" * 70, "a"), (1004, "z" * 30, "tiny"), (1005, "left out", "c"), (1006, "w" * 20_000, "b")]
    schedule = [(s, t, w) for s, ws in (("a", (5, 1, 0)), ("b", (1, 1, 4)), ("", (1, 0, 1)), ("tiny", (0, 1, 1))) for t, w in zip((0.0, 0.4, 1.0), map(float, ws))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 epoch", "2 position", "3 size")
    known = spark.createDataFrame(schedule, "source string, t double, weight double")
    got = sorted(((r.doc_id, r.source, r.epoch, r.position) for r in curriculum.positions(docs, known, 60_000).collect()), key=str)
    want = sorted(plain_positions(rows, schedule, 60_000), key=str)
    assert [g[:3] for g in sorted(got, key=lambda x: str(x[:3]))] == [w[:3] for w in sorted(want, key=lambda x: str(x[:3]))]
    exact = {w[:3]: w[3] for w in want}
    assert all(abs(p - exact[a, b, c]) < 1e-3 for a, b, c, p in got)
    # A tiny source repeats as often as its weight asks, and its share of tokens is what the schedule says.
    assert sum(g[0] == 1004 for g in got) > 100
    assert max(g[2] for g in curriculum.positions(docs, known, 60_000, max_epochs=2).select("doc_id", "source", "epoch").collect()) == 1


def test_mixed_repeats_rows_and_pieces_number_them(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"the words of document {i} go on and on about " + "several longer matters, everything considered, " * 4, "a" if i else "b") for i in range(40)], "doc_id long, text string, source string").selectExpr("*", "'k' epoch")
    flat = spark.createDataFrame([(s, t, 1.0) for s in "ab" for t in (0.0, 1.0)], "source string, t double, weight double")
    mixed = curriculum.mixed(docs, flat, 2000.0)
    assert mixed.columns == docs.columns
    mixed.write.parquet(str(tmp_path / "m"))
    read = spark.read.parquet(str(tmp_path / "m"))
    got = pieces.encoded_in_order(read).orderBy("part", "place").collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in mixed.collect()]
    zero = [r for r in got if r.doc_id == 0]
    assert [r.epoch for r in zero] == list(range(len(zero))) and len(zero) >= 4
    # Each epoch has a segmentation of its own, and they all decode to the text.
    assert len({tuple(r.ids) for r in zero}) == len(zero) and all(r.lossless for r in got)
    alone = pieces.encoded(docs.where("doc_id = 0").drop("epoch")).first()
    assert alone.ids == zero[0].ids
    again = pieces.encoded_in_order(docs.union(docs).drop("epoch")).collect()
    assert Counter(r.epoch for r in again) == {0: 40, 1: 40} and all(r.part is None and r.place is None for r in again)
    assert pieces.encoded_in_order(docs.limit(0)).count() == 0


def combined(items):
    sums = [sum(int(x[15 * k : 15 * k + 15], 16) for x in items) for k in range(warc.LANES)]
    import hashlib

    return hashlib.sha256(":".join(map(str, [len(items), *sums])).encode()).hexdigest()


def plain_audit(ours, theirs, fan):
    import hashlib

    def leaves(rows):
        by = defaultdict(list)
        for page_id, url, html in rows:
            body = (html or "").encode()
            record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: " + (url or "").encode() + b"\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
            by[warc.NO_ID if page_id is None else page_id].append((hashlib.sha256(record).hexdigest(), len(record)))
        return {k: (combined([d for d, _ in v]), sum(n for _, n in v)) for k, v in sorted(by.items())}

    a, b = leaves(ours), leaves(theirs)
    order, offsets, at = list(a), {}, 0
    for k in order:
        offsets[k], at = at, at + a[k][1]
    start = lambda k: offsets[k] if k in offsets else next((offsets[x] for x in order if x > k), at)
    rank = lambda k: order.index(k) if k in a else max(bisect_right(order, k) - 1, 0)
    level, out = 0, []
    nodes = [{k: (d, n, start(k), rank(k) // fan) for k, (d, n) in side.items()} for side in (a, b)]
    while True:
        x, y = nodes
        for k in {*x, *y}:
            if x.get(k, [None])[0] != y.get(k, [None])[0]:
                out.append((level, k, "extra" if k not in x else "missing" if k not in y else "differs", x[k][2] if k in x else y[k][2] or 0, x[k][1] if k in x else 0))
        if level and len(x) <= 1:
            return sorted(out)
        level += 1
        up = []
        for s, side in enumerate(nodes):
            groups = defaultdict(list)
            for k, v in side.items():
                groups[v[3]].append((k, v))
            up.append({g: (combined([hashlib.sha256(f"{k}:{v[1]}:{v[0]}".encode()).hexdigest() for k, v in own]), sum(v[1] for _, v in own), min(v[2] for _, v in own) if not s else None, g // fan) for g, own in groups.items()})
        nodes = up


@pytest.mark.parametrize("case", ["damaged", "empty replica", "empty primary", "surplus", "hashed ids"])
def test_audit(spark, monkeypatch, case):
    monkeypatch.setattr(warc, "FAN", 8)
    draw = random.Random(3)
    ids = [draw.randrange(-(2**63), 2**63) for _ in range(700)] if case == "hashed ids" else list(range(700))
    ours = [(i, f"u{i}", "é" * (k % 40)) for k, i in enumerate(ids)] + [(ids[7], "again", "x"), (ids[7], "again", "x"), (None, None, None), (5, "long", "y" * 300_000)]
    theirs = [r for k, r in enumerate(ours) if k % 97 != 5]
    theirs = [(r[0], r[1], "bad") if k % 131 == 3 else r for k, r in enumerate(theirs)] + [(10_000 + i, "new", None) for i in range(3)]
    if case == "empty replica":
        theirs = []
    if case == "empty primary":
        ours = []
    if case == "surplus":
        ours = ours[:3]
    schema = "page_id long, url string, html string"
    a, b = (spark.createDataFrame(r, schema).selectExpr("*", "1 node", "2 length", "'s' side") for r in (ours, theirs))
    for cell in (10**6, 50) if case == "damaged" else (50,):
        got = sorted((r.level, r.node, r.status, r.offset, r.length) for r in warc.audit(a, b, cell).collect())
        assert got == plain_audit(ours, theirs, 8)
    assert warc.audit(a, a.repartition(3)).count() == 0


def test_pieces_of_whole_texts_follow_the_lattice(spark):
    """Segmentations of texts of several words, blanks and bytes beyond the vocabulary, against all ways to spell them."""
    model, n = pieces.load(), 3000
    known = {p: i for i, p in enumerate(model.text) if math.isfinite(model.log[i])}

    def ways(rest):
        if not rest:
            yield (), 0.0
            return
        width = next(k for k in range(1, 5) if k == len(rest) or rest[k] & 0xC0 != 0x80)
        spelled = False
        for k in range(1, len(rest) + 1):
            # Pieces begin and end between characters.
            if rest[:k] in known and (k == len(rest) or rest[k] & 0xC0 != 0x80):
                spelled |= k == width
                for tail, w in ways(rest[k:]):
                    yield (known[rest[:k]], *tail), w + pieces.ALPHA * model.log[known[rest[:k]]]
        if not spelled:
            for tail, w in ways(rest[width:]):
                yield (*(int(model.of_byte[b]) for b in rest[:width]), *tail), w + pieces.ALPHA * width * model.log_byte

    for text in ("a cat", "on  it", "é\U000131a5 x", "▁a", "x\ny"):
        weights: dict = defaultdict(float)
        for ids, w in ways(b" " + text.encode()):
            weights[ids] += math.exp(w)
        total = sum(weights.values())
        coded = pieces.encode(pa.array([text] * n), pa.array(range(n)), model)
        assert pieces.decode(coded, model).to_pylist() == [text] * n
        seen = Counter(map(tuple, coded.to_pylist()))
        assert set(seen) <= set(weights)
        off = sum(abs(seen[ids] / n - w / total) for ids, w in weights.items()) / 2
        spread = sum(math.sqrt(w / total * (1 - w / total) / n) for w in weights.values()) / 2
        assert off < 1.6 * spread + 0.005, text


def test_long_text_is_lossless(spark):
    long = "".join(random.Random(1).choice(["word ", "é", "\n", "  ", "漢字", "▁", "ab", "🙂"]) for _ in range(15_000))
    got = pieces.decoded(pieces.encoded(spark.createDataFrame([(1, long), (None, long)], "doc_id long, text string"))).collect()
    assert all(r.lossless and r.text == long for r in got)
