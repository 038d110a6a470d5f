"""Near-duplicate groups by HyperMinHash (operator 1).

Each text's word 3-grams fall into 160 buckets by hash. Of a bucket's smallest hash the
register keeps the leading-zero count (6 bits) and the 10 bits after the first one. Bands
of four registers find candidates: within a band every two texts are compared by the
matching registers, less those expected to match by chance, but for texts that a chain of
estimates from HIGH on joins already; what may reach the threshold is verified on the exact
shingle sets; verified pairs are joined into groups.

A band may hold a third of all texts. It is cut to lists of BLOCK texts, each compared in
one task; what these join is grouped, and the rest of the band's pairs, of texts that are
in different groups so far, are compared by pairs of spans of SPAN texts. A group's own
texts aren't compared across lists. A text's links are verified in parts of PART. So no
task holds a band.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import kernels as K
from loomtext.llm.components import components
from loomtext.llm.shared import content_key, join_checked, materialise, own_names, table

SHINGLE = 3
BUCKETS = 160
MANTISSA = 10
ROWS = 4
BANDS = BUCKETS // ROWS
THRESHOLD = 0.5
#: Estimates from here on are verified, 2.5 standard errors below the threshold.
LOW = 0.4
#: Estimates from here on, 5 standard errors above the threshold, join texts without more comparisons.
HIGH = 0.7
#: Texts of a list that are compared in one go at most.
BLOCK = 2048
#: Texts on either side of a comparison across the lists of a band.
SPAN = 8192
#: Texts that are verified against one text in one go.
PART = 4096
EMPTY = 0xFFFF

_UNSET = np.uint64(2**64 - 1)


def registers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: its 16-bit registers, and how many shingles it has (repeats counted)."""
    h, owner = K.shingles(texts, SHINGLE)
    bucket = ((h >> np.uint64(32)) * np.uint64(BUCKETS) >> np.uint64(32)).astype(np.int64)
    value = K.mix(h + np.uint64(0xA0761D6478BD642F))
    least = np.full(len(texts) * BUCKETS, _UNSET, np.uint64)
    np.minimum.at(least, owner * BUCKETS + bucket, value)
    out = np.full(len(least), EMPTY, np.uint16)
    at = np.flatnonzero(least != _UNSET)
    v = least[at]
    # Bits of the value: floor(log2), exact although large values round up as floats.
    top = np.frexp(v.astype(np.float64))[1] - 1
    top -= ((v >> np.clip(top, 0, 63).astype(np.uint64)) == 0).astype(top.dtype)
    zeros = np.minimum(63 - np.maximum(top, 0), 62)
    mantissa = (v << (zeros.astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out[at] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    return out.reshape(len(texts), BUCKETS), np.bincount(owner, minlength=len(texts))


_GRID = 4.0


@lru_cache(1)
def _collisions() -> np.ndarray:
    """Chance that a bucket of two unrelated texts holds the same register, by log2 of either's shingles a bucket."""
    cells = np.arange(63 << MANTISSA)
    zeros, mantissa = cells >> MANTISSA, cells & ((1 << MANTISSA) - 1)
    low = np.exp2(-(zeros + 1.0)) * (1 + mantissa / (1 << MANTISSA))
    high = low + np.exp2(-(zeros + 1.0 + MANTISSA))
    loads = np.exp2(np.arange(int(-10 * _GRID), int(24 * _GRID) + 1) / _GRID)
    p = np.array([np.exp(-x * low) - np.exp(-x * high) for x in loads])
    return p @ p.T


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard of register rows a and b, of na and nb shingles."""
    same = ((a == b) & (a != EMPTY)).sum(1)
    either = ((a != EMPTY) | (b != EMPTY)).sum(1)
    at = [np.clip(np.rint((np.log2(np.maximum(n, 1) / BUCKETS) + 10) * _GRID), 0, 34 * _GRID).astype(int) for n in (na, nb)]
    chance = _collisions()[at[0], at[1]] * BUCKETS
    matched = np.maximum(same - chance, 0) / np.maximum(either - chance, 1)
    return np.where(either == 0, 0.0, np.minimum(matched, 1))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in K.slices(batch.column(3)):
            part = batch.slice(i, j - i)
            regs, n = registers(part.column(3))
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * BUCKETS), len(part), [None, pa.py_buffer(np.ascontiguousarray(regs))])
            yield pa.record_batch([*(part.column(k) for k in range(3)), pa.array(n, pa.int32()), flat.cast(pa.binary())], ["doc_id", "content", "other", "n", "regs"])


def _other_key(text: Column) -> Column:
    """Another 64 bits of a text's MD5."""
    return F.xxhash64(F.md5(text), F.lit(1))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, content, other, n, regs) of every row that has a text; content and other are 128 bits of the text's MD5."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content_key(F.col("text")).alias("content"), _other_key(F.col("text")).alias("other"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    return slim.mapInArrow(_sketch, "doc_id long, content long, other long, n int, regs binary")


def with_nodes(keyed: DataFrame, clash: DataFrame | None) -> DataFrame:
    """keyed (content, other, ...) with node: content, but for all but one of the texts that share it another number."""
    if clash is None:
        return keyed.withColumn("node", F.col("content"))
    found = join_checked(keyed, clash, ["content"], "left", 64)
    return found.withColumn("node", F.when(F.col("other") != F.col("__least"), F.xxhash64("content", "other")).otherwise(F.col("content"))).drop("__least")


def clashes(sketched: DataFrame) -> DataFrame | None:
    """(content, __least) of the 64-bit keys that different texts share; None if there are none, as nearly always."""
    found = materialise(sketched.groupBy("content").agg(F.min("other").alias("__least"), F.max("other").alias("__most")).where("__least != __most").select("content", "__least"))
    return None if found.isEmpty() else found


def _matrix(column: pa.Array) -> np.ndarray:
    buf, off = K.raw(column)
    return buf.view(np.uint16).reshape(len(off) - 1, BUCKETS)


def _columns(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Registers of texts as columns, so that sums run along the texts, and how many each text has filled."""
    return np.ascontiguousarray(regs.T), (regs != EMPTY).sum(1)


def _may_reach(own: np.ndarray, columns: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Which columns' estimate with the registers own may be LOW or more: it is no more than the matching registers by either text's filled ones."""
    mine = np.where(own == EMPTY, EMPTY - 1, own)  # a value that no register has
    same = np.add.reduce((columns == mine[:, None]).view(np.uint8), axis=0, dtype=np.uint8)
    return np.flatnonzero(same >= LOW * np.maximum(filled, (own != EMPTY).sum()))


def _links(regs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of both ends of the links of texts that share a band.

    From the first text on, what is HIGH to it joins it, what is HIGH to one that joined too, and each
    of them is compared with all that haven't joined. So no two texts are left uncompared but those
    that such a chain joins, and links to what joined are left out for all but one that it is HIGH to.
    """
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rest, (columns, filled) = np.arange(len(n)), _columns(regs)
    while len(rest) > 1:
        joined, ends, others = [rest[0]], [], []
        rest, columns, filled = rest[1:], columns[:, 1:], filled[1:]
        while joined and len(rest):
            own = joined.pop()
            at = _may_reach(regs[own], columns, filled)
            if not len(at):
                continue
            near = estimate(regs[own : own + 1], regs[rest[at]], n[own : own + 1], n[rest[at]])
            sure, maybe = at[near >= HIGH], rest[at[(near >= LOW) & (near < HIGH)]]
            ends.append(np.full(len(maybe), own))
            others.append(maybe)
            if len(sure):
                left.append(np.full(len(sure), own))
                right.append(rest[sure])
                joined.extend(rest[sure].tolist())
                stays = np.ones(len(rest), bool)
                stays[sure] = False
                rest, columns, filled = rest[stays], columns[:, stays], filled[stays]
        if ends:
            apart = np.isin(np.concatenate(others), rest)
            left.append(np.concatenate(ends)[apart])
            right.append(np.concatenate(others)[apart])
    return np.concatenate(left), np.concatenate(right)


def _elect(begin: np.ndarray, size: np.ndarray, regs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of lists of texts that lie together: places of both ends of each."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    two = begin[size == 2]
    for i in range(0, len(two), 8192):
        at = two[i : i + 8192]
        near = estimate(regs[at], regs[at + 1], n[at], n[at + 1])
        left.append(at[near >= LOW])
        right.append(at[near >= LOW] + 1)
    for b, m in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
        x, y = _links(regs[b : b + m], n[b : b + m])
        left.append(x + b)
        right.append(y + b)
    return np.concatenate(left), np.concatenate(right)


def _runs_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and how long they are."""
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return begin, np.diff(np.r_[begin, len(key)])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, node): the bands of each text."""
    salt = np.array([K.mix_int(i + 1) for i in range(BANDS)], np.uint64)
    for batch in batches:
        for i in range(0, len(batch), 4096):
            part = batch.slice(i, 4096)
            node, first = np.unique(part.column(0).to_numpy(), return_index=True)
            split = _matrix(part.column(1))[first].reshape(len(node), BANDS, ROWS)
            # A band of empty registers says nothing.
            some = (split != EMPTY).any(2)
            key = K.mix(np.ascontiguousarray(split).view(np.uint64).reshape(len(node), BANDS) + salt)[some].view(np.int64)
            yield pa.record_batch([pa.array(key), pa.array(np.repeat(node, some.sum(1)))], ["band", "node"])
        K.tidy()


def _listed(nodes: np.ndarray, begin: np.ndarray, size: np.ndarray, parent: np.ndarray | None) -> pa.RecordBatch:
    """Rows (list, parent, linked, nodes) of runs of nodes, none of which is linked yet; lists of the same nodes have the same number."""
    flat = pa.array(nodes[np.repeat(begin, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), flat)
    upto = np.r_[np.uint64(0), np.cumsum(K.mix(nodes.view(np.uint64)), dtype=np.uint64)]
    number = K.mix(upto[begin + size] - upto[begin] + size.astype(np.uint64) * np.uint64(2))
    if parent is not None:
        number = K.mix(number ^ parent.view(np.uint64))
    parents = pa.nulls(len(begin), pa.int64()) if parent is None else pa.array(parent)
    return pa.record_batch([pa.array(number.view(np.int64)), parents, pa.array(np.zeros(len(begin), bool)), lists], ["list", "parent", "linked", "nodes"])


def _lists(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by band and node: lists of the texts of each band, in blocks of most (BLOCK) whose parent is the band where it has more."""
    most = most or BLOCK
    held, cut = np.zeros((2, 0), np.int64), False

    def blocks(band: int, nodes: np.ndarray) -> pa.RecordBatch:
        begin = np.arange(0, len(nodes), most)
        return _listed(nodes, begin, np.minimum(most, len(nodes) - begin), np.full(len(begin), band))

    for batch in batches:
        new = np.concatenate([held, np.stack([batch.column("band").to_numpy(), batch.column("node").to_numpy()])], 1)
        # Equal texts of different batches are one.
        new = new[:, np.r_[True, (new[:, 1:] != new[:, :-1]).any(0)]] if new.shape[1] else new
        begin, size = _runs_of(new[0])
        if not len(begin):
            continue
        last, held = begin[-1], new[:, begin[-1] :]
        begin, size = begin[:-1], size[:-1]
        if cut and len(begin):
            yield blocks(int(new[0, 0]), new[1, : size[0]])
            begin, size, cut = begin[1:], size[1:], False
        for b, m in zip(begin[size > most].tolist(), size[size > most].tolist()):
            yield blocks(int(new[0, b]), new[1, b : b + m])
        use = (size > 1) & (size <= most)
        if use.any():
            yield _listed(new[1, :last], begin[use], size[use], None)
        full = held.shape[1] // most * most
        K.tidy()
        # The last node is kept, so that its copies in the next batch are still known.
        if full == held.shape[1]:
            full -= most
        if full > 0:
            yield blocks(int(held[0, 0]), held[1, :full])
            held, cut = held[:, full:], True
    if held.shape[1] and cut:
        yield blocks(int(held[0, 0]), held[1])
    elif held.shape[1] > 1:
        yield _listed(held[1], np.zeros(1, np.int64), np.array([held.shape[1]]), None)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by their first column; yields batches that never cut a group of it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch.column(0).to_numpy()
        other = np.flatnonzero(key != key[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if held and (cut or held[-1].column(0)[-1].as_py() != key[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
        elif cut:
            yield batch.slice(0, cut)
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by list, of at most BLOCK texts: their links."""
    for batch in _grouped(batches):
        key, node, n = (batch.column(i).to_numpy() for i in range(3))
        a, b = _elect(*_runs_of(key), _matrix(batch.column(3)), n)
        yield pa.record_batch([pa.array(node[a]), pa.array(node[b])], ["lead", "node"])
        K.tidy()


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by task and side: links of texts of sides 0 and 1, or of all of side 2, whose lists and roots differ."""
    for batch in _grouped(batches):
        key, side, block, root, node, n = (batch.column(i).to_numpy() for i in range(6))
        regs = _matrix(batch.column(6))
        for begin, size in zip(*_runs_of(key)):
            at = np.arange(begin, begin + size)
            one, other = at[side[at] != 1], at[side[at] != 0]
            columns, filled = _columns(regs[other])
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for own in one.tolist():
                to = other[_may_reach(regs[own], columns, filled)]
                to = to[(root[to] != root[own]) & (block[to] != block[own]) & ((side[to] == 1) | (to > own))]
                if len(to):
                    to = to[estimate(regs[own : own + 1], regs[to], n[own : own + 1], n[to]) >= LOW]
                    left.append(np.full(len(to), node[own]))
                    right.append(node[to])
            yield pa.record_batch([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["lead", "node"])
        K.tidy()


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by leader and part, the leader's own text first."""
    now, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        lead, node = batch.column(0).to_numpy(), pc.fill_null(batch.column(1), 0).to_numpy()  # a column with nulls would come as floats, which can't hold 64-bit keys
        leads = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        for i, j in K.slices(batch.column(2)):
            h, owner = K.shingles(batch.column(2).slice(i, j - i), SHINGLE)
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            h, owner = h[first], owner[first]
            at = np.searchsorted(owner, np.arange(j - i + 1))
            a, b, s = [], [], []
            for r in range(j - i):
                mine = h[at[r] : at[r + 1]]
                if leads[i + r]:
                    now, own = lead[i + r], mine
                    continue
                place = np.minimum(np.searchsorted(own, mine), max(len(own) - 1, 0))
                both = int((own[place] == mine).sum()) if len(own) else 0
                a.append(now)
                b.append(node[i + r])
                s.append(both / max(1, len(own) + len(mine) - both))
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["lead", "node", "jaccard"])


def candidate_pairs(nodes: DataFrame, sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lead, node), the links within lists, and (parent, block, node), the lists of bands that have several; both materialised. nodes has (node, n, regs) once for each text."""
    bands = sketched.select("node", "regs").mapInArrow(_bands, "band long, node long")
    # BLOCK as it is here: workers have a module of their own.
    lists = bands.repartition("band").sortWithinPartitions("band", "node").mapInArrow(lambda batches, most=BLOCK: _lists(batches, most), "list long, parent long, linked boolean, nodes array<long>")
    lists = materialise(lists.drop("linked").dropDuplicates(["list"]))
    sized = lists.select("list", F.explode("nodes").alias("node")).join(nodes, "node").select("list", "node", "n", "regs")
    # One order of nodes for all lists: near copies then meet the same first text wherever they are.
    pairs = sized.repartition("list").sortWithinPartitions("list", "node").mapInArrow(_compared, "lead long, node long")
    return materialise(pairs.distinct()), lists.where("parent IS NOT NULL").select("parent", F.col("list").alias("block"), F.explode("nodes").alias("node"))


def pairs_across(nodes: DataFrame, cut: DataFrame, roots: DataFrame) -> DataFrame:
    """(lead, node), materialised: the links across the lists (parent, block, node) of one band, between texts of different roots.

    A root with SPAN texts in a band has spans of its own, which aren't compared with each other.
    """
    rooted = materialise(cut.join(roots, "node", "left").select("parent", "block", "node", F.coalesce("root", "node").alias("root")))
    each = rooted.groupBy("parent", "root").agg(F.count("*").alias("rows"), (F.count("*") >= SPAN).alias("large"))
    several = each.groupBy("parent").agg(F.count("*").alias("roots")).where("roots > 1").select("parent")
    each = each.join(several, "parent").select("parent", "root", "rows", "large", F.when(F.col("large"), F.col("root")).otherwise(0).alias("own"))
    parts = each.groupBy("parent", "large", "own").agg(F.ceil(F.sum("rows") / SPAN).cast("int").alias("parts"))
    placed = materialise(each.drop("rows").join(parts, ["parent", "large", "own"]))
    spans = placed.select("parent", "large", "own", "parts").distinct().select("parent", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "large", "own").select("parent", F.struct("large", "own", "part").alias("span"))
    two = spans.withColumnRenamed("span", "a").join(spans.withColumnRenamed("span", "b"), "parent").where("a <= b AND NOT (a.large AND b.large AND a.own = b.own)")
    task = F.xxhash64("parent", "a", "b").alias("task")
    same = F.col("a") == F.col("b")
    ends = two.select("parent", F.col("a").alias("span"), task, F.when(same, 2).otherwise(0).alias("side")).union(two.where(~same).select("parent", F.col("b").alias("span"), task, F.lit(1).alias("side")))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    rows = rooted.join(placed, ["parent", "root"]).select("parent", "block", "root", "node", F.struct("large", "own", part.alias("part")).alias("span")).join(nodes, "node")
    sent = rows.join(materialise(ends), ["parent", "span"]).select("task", "side", "block", "root", "node", "n", "regs")
    return materialise(sent.repartition("task").sortWithinPartitions("task", "side").mapInArrow(_across, "lead long, node long").distinct())


def _verified(docs: DataFrame, edges: DataFrame, clash: DataFrame | None) -> DataFrame:
    """(u, v, jaccard), materialised: edges (lead, node) whose exact shingle Jaccard reaches THRESHOLD."""
    need = materialise(edges.select(F.explode(F.array("lead", "node")).alias("node")).distinct())
    keyed = with_nodes(docs.where("text IS NOT NULL").select(content_key(F.col("text")).alias("content"), _other_key(F.col("text")).alias("other"), F.col("text").cast("string").alias("text")), clash)
    texts = join_checked(keyed, need, ["node"], "left_semi", 48).groupBy("node").agg(F.first("text").alias("text"))
    parts = materialise(edges.groupBy("lead").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
    own = texts.join(parts.withColumnRenamed("lead", "node"), "node").select(F.col("node").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("node"), "text")
    hot = parts.where("parts > 1")
    spread = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int")
    cut = edges.withColumn("part", F.lit(0)) if hot.isEmpty() else join_checked(edges, hot, ["lead"], "left", 56).select("lead", "node", spread.alias("part"))
    others = cut.join(texts, "node").select("lead", "part", "node", "text")
    streams = own.union(others).repartition("lead", "part").sortWithinPartitions("lead", "part", F.col("node").asc_nulls_first()).select("lead", "node", "text")
    return materialise(streams.mapInArrow(_jaccard, "lead long, node long, jaccard double").where(F.col("jaccard") >= THRESHOLD).select(F.col("lead").alias("u"), F.col("node").alias("v"), "jaccard"))


def verified_pairs(docs: DataFrame, sketched: DataFrame, clash: DataFrame | None = None) -> DataFrame:
    """(u, v, jaccard): nodes whose exact shingle Jaccard reaches THRESHOLD, as many as join all texts that such pairs join."""
    worded = sketched.where("n > 0")
    nodes = worded.groupBy("node").agg(F.first("n").alias("n"), F.first("regs").alias("regs"))
    edges, cut = candidate_pairs(nodes, worded)
    found = _verified(docs, edges, clash)
    if cut.isEmpty():
        return found
    more = pairs_across(nodes, cut, components(found))
    return found if more.isEmpty() else found.union(_verified(docs, more, clash))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Every distinct (doc_id, text) with its group: (doc_id, content, group_id, group_size, keep).

    group_id is the least doc_id of the group, group_size its number of distinct (doc_id,
    text); keep is true for one of them, the row of the least doc_id (a null doc_id counts
    as the largest; on ties the least content key). Texts that are equal byte for byte are
    one group even if they hold no word; texts that differ only in case or punctuation too,
    if they hold a word. Very long texts are read whole, in slices of their own. A null text
    belongs to no group and is kept, with a null content. Repeated rows give one row. An
    empty table gives no rows. Columns besides doc_id and text are not read.
    """
    keyed = materialise(sketches(docs))
    clash = clashes(keyed)
    sketched = with_nodes(keyed, clash)
    groups = components(verified_pairs(docs, sketched, clash))
    rows = sketched.select("doc_id", "content", "node").distinct().join(groups, "node", "left").select("doc_id", "content", F.coalesce("root", "node").alias("root"))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content"))
    firsts = rows.groupBy("root").agg(head.alias("head"), F.count("*").alias("group_size"))
    placed = rows.join(firsts, "root").select("doc_id", "content", F.col("head.doc_id").alias("group_id"), "group_size", (F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.content") == F.col("content"))).alias("keep"))
    lone = docs.where("text IS NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().select("doc_id", F.lit(None).cast("long").alias("content"), F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("keep"))
    return placed.union(lone)


@own_names
def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns unchanged, less those that near_duplicates doesn't keep.

    Of rows repeated with one doc_id and text one stays, with the other columns of any one
    of them. Rows with a null text all stay.
    """
    found = materialise(near_duplicates(docs).where(~F.col("keep")).select(F.col("doc_id").alias("__id"), F.col("content").alias("__content")))
    keyed = docs.withColumns({"__doc": F.col("doc_id").cast("long"), "__key": content_key(F.col("text"))})
    on = F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__content"))
    kept = join_checked(keyed, found, on, "left_anti", 96)
    twice = materialise(keyed.where("text IS NOT NULL").groupBy("__doc", "__key").count().where("count > 1").select(F.col("__doc").alias("__id"), F.col("__key").alias("__content")))
    single = join_checked(kept, twice, on, "left_anti", 96)
    repeated = join_checked(kept, twice, on, "left_semi", 96).dropDuplicates(["__doc", "__key"])
    return single.union(repeated).drop("__doc", "__key")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_minhash_near_dedup": op1}
SQL: dict[str, str] = {}

