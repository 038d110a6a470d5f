"""Shared runs of lines against a version in plain Python that knows no pairs, hashes or chunks."""

import random

from loomtext.llm import lines


def brute(texts):
    """Lines that lie in a run of two lines or more which stands earlier too, or are long and do; texts are in the order of their ids."""
    cut = [t.split("\n") for t in texts]
    where = {}
    for d, own in enumerate(cut):
        for i, x in enumerate(own):
            where.setdefault(x, []).append((d, i))
    out = []
    for d, own in enumerate(cut):
        gone = set()
        for i in range(len(own)):
            for e, j in where[own[i]]:
                if (e, j) >= (d, i):
                    break
                n = 0
                while i + n < len(own) and j + n < len(cut[e]) and own[i + n] == cut[e][j + n]:
                    n += 1
                if (n >= 2 or len(own[i].split()) >= lines.LONG_WORDS) and any(x.strip() for x in own[i : i + n]):
                    # Lines of an earlier run that overlaps this one stay with it.
                    for m in range(1 if n == 1 else 2, n + 1):
                        gone.update(range(max(i, j + m) if e == d else i, i + m))
        out.append("\n".join(x for k, x in enumerate(own) if k not in gone))
    return out


def test_planted_runs_go_whole(spark):
    draw = random.Random(10)

    def own(n):
        return [" ".join(f"w{draw.randrange(10**6)}" for _ in range(20)) for _ in range(n)]

    texts, passages = [], []
    for k in range(120):
        passages.append(own(2 + k % 11))
        for _ in range(2):
            texts.append("\n".join(own(draw.randrange(1, 6)) + passages[-1] + own(draw.randrange(1, 6))))
    draw.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in lines.run_dedup(docs).orderBy("doc_id").collect()]
    assert got == brute(texts)
    # Each passage, of 40 words or more, stands once, and no line of it twice.
    whole = [line for t in got for line in t.split("\n")]
    assert all(whole.count(line) == 1 for p in passages for line in p)
    dropped = [r.text for r in lines.drop_repeated_lines(docs).orderBy("doc_id").collect()]
    assert dropped == got


def test_runs_on_edges(spark):
    rows = [(1, "x\nx\nx\nx"), (2, "x\nx"), (3, "one"), (4, "one"), (5, "\n\n\n"), (6, "\n\n\n"), (7, None), (8, ""), (9, "a\né b\nc"), (9, "a\né b\nc"), (None, "z\na\né b"), (10, "c\na")]
    got = [(r.doc_id, r.removed_chunks, r.text) for r in lines.run_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(1, 1, "x\nx"), (2, 1, ""), (3, 0, "one"), (4, 0, "one"), (5, 0, "\n\n\n"), (6, 0, "\n\n\n"), (7, 0, None), (8, 0, ""), (9, 0, "a\né b\nc"), (9, 0, "a\né b\nc"), (None, 1, "z"), (10, 0, "c\na")]
    assert sorted(map(str, got)) == sorted(map(str, want))
    own = ["x\nx\nx\nx", "a\nb\na\nb\na", "c\nc\nc\nd\nc\nc\nc"]
    assert brute(own) == [r.text for r in lines.run_dedup(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")).orderBy("doc_id").collect()]


def test_long_lines_go_alone(spark):
    passage = " ".join(f"word{i}" for i in range(lines.LONG_WORDS))
    short = " ".join(f"word{i}" for i in range(lines.LONG_WORDS - 1))
    texts = [f"a\n{passage}\nb", f"c\n{passage}\nd", passage, f"{passage}\n{passage}", f"e\n{short}\nf", f"g\n{short}\nh", f"{passage} more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in lines.run_dedup(docs).orderBy("doc_id").collect()]
    assert got == brute(texts) == [texts[0], "c\nd", "", "", *texts[4:]]


def test_one_run_in_many_documents(spark):
    """A third of all rows hold one run: no task may gather it, and one stays."""
    from pyspark.sql import functions as F

    n = 60_000
    own = F.concat(F.lit("own "), F.col("id").cast("string"), F.lit("\nsecond "), F.col("id").cast("string"))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(own, F.lit("\nthe notice that all share\nand its second line"))).otherwise(own).alias("text"))
    got = lines.run_dedup(docs).agg(F.count("*"), F.sum("removed_chunks"), F.sum(F.col("text").contains("its second line").cast("int"))).first()
    assert tuple(got) == (n, n // 3 - 1, 1)


def plain_chunks(text):
    """Chunks of a text by the rule of the method, line by line, with hashes of single spans only."""
    import numpy as np
    import pyarrow as pa

    from loomtext.llm import kernels as K

    def one(line):
        buf, off = K.raw(pa.array([line]))
        return int(K.span_hashes(buf, off[:1], off[1:])[0]) if line else int(K.span_hashes(np.zeros(1, np.uint8), np.array([0]), np.array([0]))[0])

    cut, hashes = text.split("\n"), [one(x) for x in text.split("\n")]
    out, now = [], []
    for i, line in enumerate(cut):
        now.append(line)
        rolled = (hashes[i] + (hashes[i - 1] * 0x9DDFEA08EB382D69 if i else 0)) % 2**64
        if K.mix_int(rolled) % lines.DIVISOR == 0 and len(now) >= lines.LEAST_LINES:
            out.append(now)
            now = []
    if now:
        if len(now) < lines.LEAST_LINES and out:
            out[-1] += now
        else:
            out.append(now)
    return out


def test_chunk_version_against_plain_chunks(spark):
    draw = random.Random(3)
    shared = [[f"shared {k} {i} {draw.random()}" for i in range(12)] for k in range(4)]
    texts = []
    for i in range(60):
        texts.append("\n".join([f"own {i} {j}" for j in range(draw.randrange(5))] + shared[i % 4][: draw.randrange(4, 13)] + [f"end {i}"]))
    texts += ["", "single", "single", "a\nb", "a\nb", "\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, want = set(), []
    for t in texts:
        kept = []
        for c in plain_chunks(t):
            body = "\n".join(c)
            if len(c) >= lines.LEAST_LINES and body.strip() and body in seen:
                continue
            seen.add(body)
            kept.append(body)
        want.append("\n".join(kept))
    assert [r.text for r in lines.line_dedup(docs).orderBy("doc_id").collect()] == want != texts


def test_equal_hashes_of_other_bytes(spark, monkeypatch):
    """With a hash of 2 bits nearly all spans clash: bytes decide, as they do with whole hashes."""
    import numpy as np
    import pyarrow as pa

    draw = random.Random(4)
    texts = ["\n".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = lines._mapper

    def mapper(cut, bodies):
        inner = whole(cut, bodies)

        def run(batches):
            for b in inner(batches):
                yield b.set_column(0, "chunk", pa.array(b.column(0).to_numpy() & np.int64(3)))

        return run

    monkeypatch.setattr(lines, "_mapper", mapper)
    assert [r.text for r in lines.run_dedup(docs).orderBy("doc_id").collect()] == brute(texts)
