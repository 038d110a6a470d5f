"""Sampled SentencePiece segmentation and lossless decoding (operator 9).

All pieces that match somewhere in a text span a lattice. Forward filtering sums the
weights of the ways to each place of it, backward sampling draws a segmentation in
proportion to its weight, by random numbers that depend only on the row's key, its epoch
and the place in the text. The lattice falls apart at every blank that follows a non-blank, as no
piece holds such a blank inside; so it is built once for each distinct word of a slice of
rows.

The vocabulary file is of the byte-pair kind: it ranks pieces and gives no probabilities,
so a piece of rank r gets the Zipf probability in proportion to 1 / (r + 2). Characters
that no piece spells, the blank mark U+2581 itself among them, fall back to bytes, so that
decoding gives back every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm import kernels as K
from loomtext.llm.shared import content_key, join_checked, materialise, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Weights are probabilities to this power: under 1 flattens, over 1 sharpens, 0 makes all segmentations alike.
ALPHA = 0.5
SEED = 20240601
SLICE = 1 << 20
MARK = "▁"


class Pieces:
    """The vocabulary as a byte trie, blanks in place of the blank mark."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = model.get_piece_size()
        self.text: list[bytes] = [b""] * size
        self.of_byte = np.full(256, -1, np.int32)
        scores = np.zeros(size)
        ids = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.text[i] = bytes([int(piece[3:5], 16)])
                self.of_byte[self.text[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.text[i] = piece.replace(MARK, " ").encode()
                scores[i] = model.get_score(i)
                ids.append(i)
        if (self.of_byte < 0).any():
            raise ValueError("the vocabulary has no piece for some bytes")
        if any(" " in self.text[i].decode().lstrip(" ") for i in ids):
            raise ValueError("a piece holds a blank after another character")
        ranks = -scores[ids]
        zipf = 1 / (ranks - ranks.min() + 2)
        self.log = np.full(size, -np.inf)
        self.log[ids] = np.log(zipf / zipf.sum())
        #: A byte weighs as the rarest piece, so that spelled pieces are preferred.
        self.log_byte = float(self.log[ids].min())
        nodes: list[dict[int, int]] = [{}]
        ends = [-1]
        for i in ids:
            at = 0
            for b in self.text[i]:
                to = nodes[at].get(b)
                if to is None:
                    to = len(nodes)
                    nodes[at][b] = to
                    nodes.append({})
                    ends.append(-1)
                at = to
            ends[at] = i
        self._place(nodes, ends)
        self.lengths = np.array([len(t) for t in self.text], np.int64)
        self.offsets = np.r_[0, np.cumsum(self.lengths)]
        self.bytes = np.frombuffer(b"".join(self.text), np.uint8)

    def _place(self, nodes: list[dict[int, int]], ends: list[int]) -> None:
        """The trie as a double array: the way from state s by byte b leads to t = base[s] + b, if parent[t] is s.

        The root is state 0. Two integers a state, where a table of all bytes would need 50 MB
        in every Python worker.
        """
        room = 2 * len(nodes) + (1 << 17)
        taken = np.zeros(room, bool)
        taken[0] = True
        place = np.zeros(len(nodes), np.int64)
        base_of = np.zeros(len(nodes), np.int64)
        # Wide nodes first, looking back a little for room; single ways then fill the gaps.
        last = 256
        for n in sorted((n for n, ways in enumerate(nodes) if len(ways) > 1), key=lambda n: -len(nodes[n])):
            codes = np.fromiter(nodes[n], np.int64, len(nodes[n]))
            at = max(last - 1024, 256)
            while True:
                good = ~taken[np.arange(at, at + 1024)[:, None] + codes].any(1)
                if good.any():
                    break
                at += 1024
            base_of[n] = last = at + int(good.argmax())
            taken[last + codes] = True
            place[list(nodes[n].values())] = last + codes
        single = [n for n, ways in enumerate(nodes) if len(ways) == 1]
        slots = np.flatnonzero(~taken)
        slots = slots[slots >= 256][: len(single)]
        taken[slots] = True
        base_of[single] = slots - [next(iter(nodes[n])) for n in single]
        place[[next(iter(nodes[n].values())) for n in single]] = slots
        size = int(np.flatnonzero(taken)[-1]) + 257
        self.base, self.parent, self.ends = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.base[place] = base_of
        self.ends[place] = ends
        for n, ways in enumerate(nodes):
            for to in ways.values():
                self.parent[place[to]] = place[n]

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """States one byte on; 0, the root, where no piece goes on so."""
        to = self.base[state] + byte.astype(np.int32)
        return np.where(self.parent[to] == state, to, 0)


@lru_cache(2)
def loaded(model: bytes) -> Pieces:
    return Pieces(model)


def load(path: str = MODEL) -> Pieces:
    return loaded(Path(path).read_bytes())


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... start + length - 1 on end."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - first, lengths)


class Lattice:
    """The lattices of many words at once.

    Words are ordered by falling length, states by place and then by word: so the states
    of one place, and the arcs into them, lie together.
    """

    def __init__(self, pieces: Pieces, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, alpha: float) -> None:
        order = np.argsort(-lengths, kind="stable")
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        starts, self.length = starts[order], lengths[order]
        longest = int(self.length[0]) if len(order) else 0
        #: How many words have a place r; base[r] is the first state of that place.
        alive = np.searchsorted(-self.length, -np.arange(longest + 1), "right")
        self.base = np.r_[0, np.cumsum(alive)]
        states = int(self.base[-1])
        word = _ranges(np.zeros(longest + 1, np.int64), alive)
        place = np.repeat(np.arange(longest + 1), alive)
        inside = place < self.length[word]
        head = np.zeros(states, bool)
        head[inside] = (buf[starts[word[inside]] + place[inside]] & 0xC0) != 0x80
        at = np.flatnonzero(head)
        word, place = word[at], place[at]
        first = buf[starts[word] + place]
        wide = 1 + (first >= 0xC0).astype(np.int64) + (first >= 0xE0) + (first >= 0xF0)
        spelled = np.zeros(len(at), bool)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        active, node, left = np.arange(len(at)), np.zeros(len(at), np.int32), self.length[word] - place
        source = starts[word] + place
        step = 0
        while len(active):
            node = pieces.step(node, buf[source[active] + step])
            step += 1
            on = node > 0
            active, node = active[on], node[on]
            piece = pieces.ends[node]
            hit = np.flatnonzero(piece >= 0)
            if len(hit):
                who = active[hit]
                found.append((at[who], self.base[place[who] + step] + word[who], piece[hit]))
                spelled[who[wide[who] == step]] = True
            more = left[active] > step
            active, node = active[more], node[more]
        lone = np.flatnonzero(~spelled)
        if len(lone):
            found.append((at[lone], self.base[place[lone] + wide[lone]] + word[lone], -wide[lone].astype(np.int32)))
        into = np.zeros(states + 1, np.int64)
        for _, to, _ in found:
            into[1:] += np.bincount(to, minlength=states)
        self.first = np.cumsum(into)
        arcs = int(self.first[-1])
        self.origin, self.piece = np.empty(arcs, np.int64), np.empty(arcs, np.int32)
        free = self.first[:-1].copy()
        # Long pieces first: they are the likeliest, and draws then end early.
        for origin, to, piece in reversed(found):
            slot = free[to]
            self.origin[slot], self.piece[slot] = origin, piece
            free[to] += 1
        log = np.where(self.piece >= 0, pieces.log[np.maximum(self.piece, 0)], -self.piece * pieces.log_byte) * alpha
        weight = np.full(states, -np.inf)
        weight[: alive[0] if longest else 0] = 0.0
        self.upto = np.empty(arcs)
        for r in range(1, longest + 1):
            s0, s1 = int(self.base[r]), int(self.base[r + 1])
            a, b = int(self.first[s0]), int(self.first[s1])
            if a == b:
                continue
            degree = np.diff(self.first[s0 : s1 + 1])
            reached = np.flatnonzero(degree)
            begin = self.first[s0:s1][reached] - a
            each = degree[reached]
            total = weight[self.origin[a:b]] + log[a:b]
            top = np.maximum.reduceat(total, begin)
            share = np.exp(total - np.repeat(top, each))
            run = np.cumsum(share)
            before = np.r_[0.0, run[begin[1:] - 1]]
            sums = np.r_[run[begin[1:] - 1], run[-1]] - before
            weight[s0 + reached] = top + np.log(sums)
            self.upto[a:b] = (run - np.repeat(before, each)) / np.repeat(sums, each)
        self.weight = weight


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of each lattice word: a new one begins at a blank after a non-blank."""
    blank = buf == 32
    begin = np.zeros(len(buf), bool)
    begin[1:] = blank[1:] & ~blank[:-1]
    begin[off[:-1][off[:-1] < off[1:]]] = True
    starts = np.flatnonzero(begin)
    stops = np.r_[starts[1:], len(buf)].astype(np.int64) if len(starts) else starts
    return starts, stops - starts, np.searchsorted(off, starts, "right") - 1


def _padded(texts: pa.Array) -> pa.Array:
    """A blank before each text that isn't empty."""
    texts = pc.fill_null(texts, "")
    return pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar("")))


def _encode_slice(texts: pa.Array, keys: np.ndarray, pieces: Pieces, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts on end, and how many each has."""
    buf, off = K.raw(_padded(texts))
    starts, lengths, owner = _words(buf, off)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    hashes = K.span_hashes(buf, starts, starts + lengths)
    _, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
    lattice = Lattice(pieces, buf, starts[sample], lengths[sample], alpha)
    word = lattice.rank[which]
    seed = K.mix(keys[owner] + (starts - off[owner]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    state = lattice.base[lattice.length[word]] + word
    live = np.arange(len(word))
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    width = np.zeros(len(word), np.int64)
    turn = 0
    while len(live):
        turn += 1
        x = (K.mix(seed[live] + np.uint64(turn * 0xBF58476D1CE4E5B9 % 2**64)) >> np.uint64(11)).astype(np.float64) / 2**53
        arc = lattice.first[state]
        final = lattice.first[state + 1] - 1
        seek = np.flatnonzero((arc < final) & (lattice.upto[arc] <= x))
        while len(seek):
            arc[seek] += 1
            now = arc[seek]
            seek = seek[(now < final[seek]) & (lattice.upto[now] <= x[seek])]
        piece = lattice.piece[arc]
        steps.append((live, piece))
        width[live] += np.where(piece >= 0, 1, -piece)
        state = lattice.origin[arc]
        on = state >= lattice.base[1]
        live, state = live[on], state[on]
    out = np.empty(int(width.sum()), np.int32)
    free = np.cumsum(width)
    place = starts + lengths
    for live, piece in steps:
        whole = piece >= 0
        rows = live[whole]
        free[rows] -= 1
        out[free[rows]] = piece[whole]
        place[rows] -= pieces.lengths[piece[whole]]
        rows, many = live[~whole], -piece[~whole].astype(np.int64)
        if len(rows):
            free[rows] -= many
            place[rows] -= many
            out[_ranges(free[rows], many)] = pieces.of_byte[buf[_ranges(place[rows], many)]]
    return out, np.bincount(owner, weights=width, minlength=len(texts)).astype(np.int64)


def encode(texts: pa.Array, keys: pa.Array, pieces: Pieces, alpha: float = ALPHA, seed: int = SEED, epochs: pa.Array | None = None) -> pa.Array:
    """A list of piece ids for each text, null for null; keys are the rows' integer keys, a null key is 0. Each epoch draws anew."""
    row = K.mix(pc.fill_null(keys.cast(pa.int64()), 0).to_numpy(zero_copy_only=False).view(np.uint64) + np.uint64(K.mix_int(seed)))
    if epochs is not None:
        later = epochs.cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64)
        row = np.where(later > 0, K.mix(row + later * np.uint64(0xD6E8FEB86659FD93)), row)
    ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for i, j in K.slices(texts, SLICE):
        a, b = _encode_slice(texts.slice(i, j - i), row[i:j], pieces, alpha)
        ids.append(a)
        counts.append(b)
    offsets = np.r_[0, np.cumsum(np.concatenate(counts))]
    missing = texts.is_null() if texts.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids)), mask=missing)


def decode(ids: pa.Array, pieces: Pieces) -> pa.Array:
    """The texts of lists of piece ids, null for null; ids that stand for no text, as of control pieces, give none."""
    filled = pc.if_else(ids.is_null(), pa.scalar([], ids.type), ids) if ids.null_count else ids
    flat = filled.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.r_[0, np.cumsum(pieces.lengths[flat])]
    off = ends[np.r_[0, np.cumsum(pc.list_value_length(filled).to_numpy(zero_copy_only=False))]]
    data = pieces.bytes[_ranges(pieces.offsets[flat], pieces.lengths[flat])]
    # The blank put before each text goes.
    lead = off[:-1][off[:-1] < off[1:]]
    keep = np.ones(len(data), bool)
    keep[lead[data[lead] == 32]] = False
    data, off = data[keep], np.r_[0, np.cumsum(keep)][off]
    out = pa.StringArray.from_buffers(len(ids), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data))
    return pc.if_else(ids.is_null(), pa.scalar(None, pa.string()), out) if ids.null_count else out


CODED = "doc_id long, source string, epoch int, ids array<int>, n_pieces int, lossless boolean"
CODED_IN_ORDER = "doc_id long, source string, epoch int, part int, place long, ids array<int>, n_pieces int, lossless boolean"


def _coder(path: str, alpha: float, seed: int, names: list[str]):
    # The vocabulary goes with the function, so that executors needn't have the file.
    model = Path(path).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        # A batch out for each slice, so that the ids of a whole batch are never held at once.
        for batch in batches:
            texts = batch.column("text")
            for i, j in K.slices(texts, SLICE):
                part = batch.slice(i, j - i)
                ids = encode(part.column("text"), part.column("doc_id"), pieces, alpha, seed, part.column("epoch"))
                same = pc.equal(decode(ids, pieces), part.column("text"))
                told = {"ids": ids, "n_pieces": pc.list_value_length(ids), "lossless": same}
                yield pa.record_batch([told[c] if c in told else part.column(c) for c in names], names)

    return run


def encoded(docs: DataFrame, path: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(doc_id, source, epoch, ids, n_pieces, lossless) of every row; lossless: decoding the ids gives the text again.

    epoch is 0, or the docs' own column of that name; the same doc_id, epoch and text always
    give the same ids, however rows are split, tied or repeated. A null doc_id draws as 0
    does, a null epoch is 0. A null text has null ids, an empty one none; a very long one is
    one lattice of its own. An empty table gives no rows. Columns besides doc_id, source,
    epoch and text are not read; without a column source it is null.
    """
    return _encoded(docs, path, alpha, seed, CODED)


def _encoded(docs: DataFrame, path: str, alpha: float, seed: int, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    own = lambda c, kind: F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)
    read = [own(c, kind).alias(c) for c, kind in (("part", "int"), ("place", "long")) if c in names]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own("source", "string").alias("source"), F.coalesce(own("epoch", "int"), F.lit(0)).alias("epoch"), F.col("text").cast("string").alias("text"), *read)
    return slim.mapInArrow(_coder(path, alpha, seed, names), schema)


def encoded_in_order(docs: DataFrame, path: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """encoded() of rows in training order: (doc_id, source, epoch, part, place, ids, n_pieces, lossless).

    Rows that repeat a doc_id, source and text are epochs of one document: they are numbered
    in their order, from 0, and each draws its own segmentation. part and place are the
    number of the file that a row was read from, and its row there: a range-sorted table is
    in order by both. They are null, and epochs in any order, where docs isn't read from
    Parquet. Nulls, empty and long texts, ties and empty tables are as in encoded(); columns
    named epoch, part or place are not read.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("epoch", "part", "place")])
    try:
        placed = docs.withColumns({"part": F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("int"), "place": F.col("_metadata.row_index")})
    except AnalysisException:
        placed = docs.withColumns({"part": F.lit(None).cast("int"), "place": F.lit(None).cast("long")})
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    keyed = placed.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), "text", "part", "place", F.struct(F.col("doc_id").cast("long").alias("d"), source.alias("s"), content_key(F.col("text")).alias("t")).alias("key"))
    again = materialise(keyed.groupBy("key").count().where("count > 1").select(F.col("key").alias("__key")))
    on = F.col("key") == F.col("__key")
    size = 96 + F.coalesce(F.octet_length("__key.s"), F.lit(0))
    single = join_checked(keyed, again, on, "left_anti", size).withColumn("epoch", F.lit(0))
    # Epochs are counted by files first, so that no task orders all rows of one document.
    turns = materialise(join_checked(keyed, again, on, "left_semi", size).withColumn("part", F.coalesce("part", F.lit(-1))))
    totals = turns.groupBy("key", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("key").alias("__key"), F.col("part").alias("__part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("key", "part").orderBy("place")) - 1
    numbered = turns.withColumn("turn", within).join(bases, (F.col("key") == F.col("__key")) & (F.col("part") == F.col("__part")))
    repeated = numbered.withColumn("epoch", (F.col("base") + F.col("turn")).cast("int")).withColumn("part", F.nullif("part", F.lit(-1))).select(*single.columns)
    return _encoded(single.unionByName(repeated), path, alpha, seed, CODED_IN_ORDER)


def decoded(coded: DataFrame, path: str = MODEL) -> DataFrame:
    """coded with a column text, decoded from its column ids; null ids give a null text."""
    model = Path(path).read_bytes()
    return coded.withColumn("text", F.arrow_udf(lambda ids: decode(ids, loaded(model)), T.StringType())(F.col("ids")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


QUERIES = {"op9_sentencepiece_sampling": op9}
SQL: dict[str, str] = {}
