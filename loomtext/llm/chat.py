"""Chat formatting by columnar byte assembly (operator 3).

The turns of a conversation are put on end with markers around each. Lengths of all
segments of a batch are added up to offsets in one preallocated buffer, and markers, roles
and contents are scattered to their places in it; no string is built in between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import kernels as K
from loomtext.llm.shared import table

OPEN, BREAK, CLOSE = b"<|im_start|>", b"\n", b"<|im_end|>\n"
NO_ROLE = "unknown"


def _scatter(out: np.ndarray, at: np.ndarray, constant: bytes) -> None:
    out[at[:, None] + np.arange(len(constant))] = np.frombuffer(constant, np.uint8)


def _copy(out: np.ndarray, at: np.ndarray, buf: np.ndarray, off: np.ndarray) -> None:
    shift = at - off[:-1]
    out[np.arange(len(buf)) + np.repeat(shift, np.diff(off))] = buf


def assemble(roles: pa.Array, texts: pa.Array, groups: np.ndarray) -> pa.Array:
    """One string for each group; groups holds the first row of each and, last, the number of rows."""
    role, role_off = K.raw(roles)
    text, text_off = K.raw(texts)
    n_role, n_text = np.diff(role_off), np.diff(text_off)
    size = len(OPEN) + n_role + len(BREAK) + n_text + len(CLOSE)
    begin = np.r_[0, np.cumsum(size)]
    out = np.empty(int(begin[-1]), np.uint8)
    at = begin[:-1]
    _scatter(out, at, OPEN)
    _copy(out, at + len(OPEN), role, role_off)
    _scatter(out, at + len(OPEN) + n_role, BREAK)
    _copy(out, at + len(OPEN) + n_role + len(BREAK), text, text_off)
    _scatter(out, begin[1:] - len(CLOSE), CLOSE)
    return pa.LargeStringArray.from_buffers(len(groups) - 1, pa.py_buffer(begin[groups].astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def _pieces(conv: np.ndarray, roles: pa.Array, texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of whole conversations of about limit bytes."""
    first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    ends = np.r_[first[1:], len(conv)]
    upto = K.raw(texts)[1] + K.raw(roles)[1]
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(upto[ends], upto[first[i]] + limit, "right")))
        yield int(first[i]), int(ends[j - 1])
        i = j


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()
        if not whole:
            return
        conv, roles, texts = whole[0].column(0).to_numpy(), whole[0].column(1), whole[0].column(2)
        for a, b in _pieces(conv, roles, texts, 4 * K.SLICE_BYTES):
            part = conv[a:b]
            groups = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), b - a]
            lines = assemble(roles.slice(a, b - a), texts.slice(a, b - a), groups)
            yield pa.record_batch([pa.array(part[groups[:-1]]), pa.array(np.diff(groups), pa.int32()), lines], ["conv_id", "turns", "text"])

    for batch in batches:
        if not len(batch):
            continue
        conv = batch.column(0).to_numpy()
        other = np.flatnonzero(conv != conv[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if held and (cut or held[-1].column(0)[-1].as_py() != conv[0]):
            yield from done([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield from done([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield from done(held)


def chat_format(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, text) of every conversation: its turns in order, each between markers.

    Turns stand by turn number (null last), then role, then text, so ties have one order;
    repeated rows stand as often as they occur. A null role is 'unknown', a null text ''. A
    marker inside a role or text is broken by a blank ('< |'), so that contents can't open or
    close a turn. Rows with a null conv_id belong to no conversation and are left out. An
    empty table gives no rows. Columns besides conv_id, turn, role and text are not read.
    """
    safe = lambda c, default: F.replace(F.coalesce(F.col(c).cast("string"), F.lit(default)), F.lit("<|"), F.lit("< |"))
    slim = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), safe("role", NO_ROLE).alias("role"), safe("text", "").alias("text"))
    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_format, "conv_id long, turns int, text string")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))


QUERIES = {"op3_chat_format": op3}
SQL = {
    "op3_chat_format": f"""
select conv_id, count(*)::int turns,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by turn nulls last, role, text) "text"
from (select conv_id, turn, replace(coalesce(role, '{NO_ROLE}'), '<|', '< |') role, replace(coalesce(text, ''), '<|', '< |') "text" from conversations where conv_id is not null)
group by conv_id
"""
}
