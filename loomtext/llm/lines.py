"""Repeated runs of lines (operator 10).

A run of two lines or more is shared, byte for byte, exactly if each two lines on end in it
are. So all pairs of neighbouring lines are hashed, and lines of LONG_WORDS words or more by
themselves too; those whose hash occurs twice are compared by their bytes, and of each only
the first occurrence in the corpus stays; a line goes if a pair goes that it belongs to. The
first occurrence of every line stays.

line_dedup() compares whole chunks instead: a hash rolled over two lines on end decides
whether a chunk may end after a line. It keeps the edges of shared runs, and short runs
that hold no whole chunk; the query and the pipeline don't use it.

However often a run stands somewhere, no task holds all its occurrences: bodies and first
places are combined before they are shuffled, and occurrences meet the one row of their
hash in a join that is broadcast, or whose hot partitions the adaptive planner splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm import kernels as K
from loomtext.llm.shared import content_key, join_checked, materialise, own_names, table

#: A line ends a chunk with chance 1 / DIVISOR, if the chunk has LEAST_LINES by then.
DIVISOR = 2
LEAST_LINES = 2
#: A line of so many words is a run by itself, as a paragraph on one line is.
LONG_WORDS = 50


def _lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line, its newline left out, and how many lines each text has; an empty text has one."""
    breaks = np.flatnonzero(buf == 10)
    per = np.diff(np.searchsorted(breaks, off)) + 1
    first = np.cumsum(per) - per
    starts, ends = np.empty(per.sum(), np.int64), np.empty(per.sum(), np.int64)
    head = np.zeros(len(starts), bool)
    head[first] = True
    starts[head] = off[:-1]
    starts[~head] = breaks + 1
    tail = np.zeros(len(ends), bool)
    tail[first + per - 1] = True
    ends[tail] = off[1:]
    ends[~tail] = breaks
    return starts, ends, per


def chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, last byte + 1, lines) of every chunk, in the bytes of raw(texts).

    A last chunk of fewer than LEAST_LINES lines joins the one before; so only a text of
    one line is a chunk of one line.
    """
    buf, off = K.raw(texts)
    starts, ends, per = _lines(buf, off)
    h = K.span_hashes(buf, starts, ends)
    last = np.cumsum(per) - 1
    first = last - per + 1
    rolled = h.copy()
    rolled[1:] += h[:-1] * np.uint64(0x9DDFEA08EB382D69)
    rolled[first] = h[first]
    may = K.mix(rolled) % np.uint64(DIVISOR) == 0
    may[last] = True
    stops: list[int] = []
    since, begin = 0, 0
    is_last = np.zeros(len(may), bool)
    is_last[last] = True
    at = np.flatnonzero(may)
    for i, ending in zip(at.tolist(), is_last[at].tolist()):
        if i - since + 1 >= LEAST_LINES:
            stops.append(i)
            since = i + 1
        elif ending:
            if len(stops) > begin:
                stops[-1] = i
            else:
                stops.append(i)
            since = i + 1
        if ending:
            begin = len(stops)
    stop = np.array(stops, np.int64)
    open_ = np.r_[0, stop[:-1] + 1].astype(np.int64) if len(stop) else stop
    return np.repeat(np.arange(len(per)), per)[stop], starts[open_], ends[stop], stop - open_ + 1


def _found(batch: pa.RecordBatch, bodies: bool, cut: Callable[[pa.Array], tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """The rows of all spans that cut finds: (text, first byte, last byte + 1, place in the text, lines)."""
    for i, j in K.slices(batch.column(2)):
        part = batch.slice(i, j - i)
        owner, starts, ends, place, lines = cut(part.column(2))
        buf, _ = K.raw(part.column(2))
        ink = np.r_[0, np.cumsum(buf > 32, dtype=np.int64)]
        # Blank spans always stay.
        use = np.flatnonzero(ink[ends] > ink[starts])
        starts, ends, take = starts[use], ends[use], pa.array(owner[use])
        columns = [pa.array(K.span_hashes(buf, starts, ends).view(np.int64)), part.column(0).take(take), part.column(1).take(take), pa.array(place[use], pa.int32()), pa.array(lines[use], pa.int32())]
        names = ["chunk", "doc_id", "content", "at", "lines"]
        if bodies:
            data = buf.tobytes()
            columns.append(pa.array([data[a:b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary()))
            names.append("body")
        yield pa.record_batch(columns, names)


def _whole_chunks(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """The chunks of LEAST_LINES lines or more, numbered from 0 within their text."""
    owner, starts, ends, lines = chunks(texts)
    begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else owner
    place = np.arange(len(owner)) - np.repeat(begin, np.diff(np.r_[begin, len(owner)]))
    use = lines >= LEAST_LINES
    return owner[use], starts[use], ends[use], place[use], lines[use]


def _pairs(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """All pairs of neighbouring lines of which one isn't long, and the long lines, by the number of their first line."""
    buf, off = K.raw(texts)
    starts, ends, per = _lines(buf, off)
    owner = np.repeat(np.arange(len(per)), per)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    solid = buf > 32
    heads = solid.copy()
    heads[1:] &= ~solid[:-1]
    words = np.r_[0, np.cumsum(heads, dtype=np.int64)]
    long = words[ends] - words[starts] >= LONG_WORDS
    # What two long lines share, each of them tells alone.
    two = np.flatnonzero((owner[1:] == owner[:-1]) & ~(long[1:] & long[:-1]))
    one = np.flatnonzero(long)
    first, last = np.r_[two, one], np.r_[two + 1, one]
    return owner[first], starts[first], ends[last], place[first], last - first + 1


def _mapper(cut: Callable[[pa.Array], tuple[np.ndarray, ...]], bodies: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _found(batch, bodies, cut)

    return run


SPANS = "chunk long, doc_id long, content long, at int, lines int"


def _repeats(docs: DataFrame, cut: Callable[[pa.Array], tuple[np.ndarray, ...]]) -> DataFrame:
    """(doc_id, content, at, lines, first) of all spans that stand elsewhere, less the first occurrence of each.

    first is (no_id, doc_id, content, at) of the occurrence that stays: that of the least
    doc_id (null last), content key and place.
    """
    slim = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), content_key(F.col("text")).alias("content"), F.col("text").cast("string").alias("text"))
    every = materialise(slim.mapInArrow(_mapper(cut, False), SPANS))
    parts = {"no_id": F.col("doc_id").isNull().cast("int"), "id": F.coalesce("doc_id", F.lit(0)), "content": F.col("content"), "at": F.col("at")}
    ends = [f(x).alias(f"{k}_{n}") for k, x in parts.items() for n, f in (("min", F.min), ("max", F.max))]
    again = materialise(every.groupBy("chunk").agg(*ends).where(" OR ".join(f"{k}_min != {k}_max" for k in parts)).select("chunk"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content", "at")
    shown = join_checked(slim.mapInArrow(_mapper(cut, True), f"{SPANS}, body binary"), again, ["chunk"], "left_semi", 48)
    bodies = shown.groupBy("chunk", "body").agg(F.min(place).alias("first"))
    told = materialise(bodies.groupBy("chunk").agg(F.count("*").alias("bodies"), F.min("first").alias("first")))
    here = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content", "at")
    columns = ["doc_id", "content", "at", "lines", "first"]
    same = join_checked(every, told.where("bodies = 1").drop("bodies"), ["chunk"], "inner", 144).where(here != F.col("first")).select(*columns)
    # Spans of one hash but several bodies, if there are any, are told apart by their bytes.
    clash = told.where("bodies > 1").select("chunk")
    if clash.isEmpty():
        return same
    firsts = bodies.join(clash, "chunk", "left_semi")
    return same.union(shown.join(clash, "chunk", "left_semi").join(firsts, ["chunk", "body"]).where(here != F.col("first")).select(*columns))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, content, removed): the chunk numbers, from 0, that go from each document that loses any."""
    return _repeats(docs, _whole_chunks).groupBy("doc_id", "content").agg(F.sort_array(F.collect_set("at")).alias("removed"))


def _without(texts: pa.Array, removed: pa.Array) -> pa.Array:
    out: list[str | None] = []
    for i, j in K.slices(texts):
        part = texts.slice(i, j - i)
        owner, starts, ends, _ = chunks(part)
        data = K.raw(part)[0].tobytes()
        at = np.searchsorted(owner, np.arange(j - i + 1)).tolist()
        for r, gone in enumerate(removed.slice(i, j - i).to_pylist()):
            gone = set(gone or ())
            kept = [data[starts[c] : ends[c]] for k, c in enumerate(range(at[r], at[r + 1])) if k not in gone]
            out.append(b"\n".join(kept).decode())
    return pa.array(out, pa.string())


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, content, removed): the line numbers, from 0, that go from each document that loses any.

    Where a pair of equal lines overlaps its own first occurrence, the line they share stays.
    """
    overlaps = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.content") == F.col("content")) & (F.col("first.at") + 1 == F.col("at"))
    gone = F.when(F.col("lines") == 1, F.array("at")).when(overlaps, F.array(F.col("at") + 1)).otherwise(F.array("at", F.col("at") + 1))
    return _repeats(docs, _pairs).select("doc_id", "content", F.explode(gone).alias("line")).groupBy("doc_id", "content").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def _without_lines(texts: pa.Array, removed: pa.Array) -> pa.Array:
    out: list[str | None] = []
    for i, j in K.slices(texts):
        part = texts.slice(i, j - i)
        buf, off = K.raw(part)
        data = buf.tobytes()
        for r, gone in enumerate(removed.slice(i, j - i).to_pylist()):
            gone = set(gone or ())
            out.append(b"\n".join(x for k, x in enumerate(data[off[r] : off[r + 1]].split(b"\n")) if k not in gone).decode())
    return pa.array(out, pa.string())


def _cleaned(docs: DataFrame, repeated: Callable[[DataFrame], DataFrame], without: Callable[[pa.Array, pa.Array], pa.Array]) -> DataFrame:
    """docs with __doc, __key and __removed, and the text without what repeated() found."""
    found = materialise(repeated(docs).select(F.col("doc_id").alias("__id"), F.col("content").alias("__content"), F.col("removed").alias("__removed")))
    keyed = docs.withColumns({"__doc": F.col("doc_id").cast("long"), "__key": content_key(F.col("text"))})
    on = F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__content"))
    joined = join_checked(keyed, found, on, "left", 96 + 4 * F.size("__removed"))
    some = joined.where("__removed IS NOT NULL")
    return joined.where("__removed IS NULL").unionByName(some.withColumn("text", F.arrow_udf(without, T.StringType())(F.col("text"), F.col("__removed"))))


def line_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, removed_chunks, text) of every row, text without the chunks that stand elsewhere.

    A null text stays null, an empty one empty; texts of one line never change. A document
    of which nothing is left has the text ''. Repeated rows (same doc_id and text) count
    as one document and all get its result. Of tied occurrences that of the least doc_id
    (null last), content key and place stays. Very long texts are cut whole, in slices of
    their own. An empty table gives no rows. Columns besides doc_id and text are not read.
    """
    return _cleaned(docs.select("doc_id", "text"), repeated_chunks, _without).select(F.col("__doc").alias("doc_id"), F.when(F.col("__removed").isNull(), 0).otherwise(F.size("__removed")).alias("removed_chunks"), "text")


def run_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, removed_chunks, text) of every row, text without the runs of lines that stand elsewhere.

    removed_chunks counts the runs of lines on end that went. A text of one line loses it
    only if the line has LONG_WORDS words and stands elsewhere. Null, empty and very long
    texts, ties, repeated rows, documents of which nothing is left and empty tables are as in
    line_dedup.
    """
    starts = F.filter("__removed", lambda x, i: (i == 0) | (F.get("__removed", i - 1) != x - 1))
    return _cleaned(docs.select("doc_id", "text"), repeated_lines, _without_lines).select(F.col("__doc").alias("doc_id"), F.when(F.col("__removed").isNull(), 0).otherwise(F.size(starts)).alias("removed_chunks"), "text")


@own_names
def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs after run_dedup: changed texts, and n_chars with them where docs has it; all other columns as they are.

    Rows of which nothing is left go; rows that had no text before stay.
    """
    clean = _cleaned(docs, repeated_lines, _without_lines).where("__removed IS NULL OR text != ''")
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("__removed").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return clean.select(*docs.columns)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op10_line_dedup": op10}
SQL: dict[str, str] = {}
