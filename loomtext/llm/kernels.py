"""numpy kernels over Arrow text buffers: word and line spans, span hashes, k-grams.

A word is a maximal run of ASCII letters and digits and of bytes from 128 up, after
lower-casing; so text outside ASCII counts as letters. Nulls are read as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about this many bytes, to bound a worker's memory.
SLICE_BYTES = 1 << 19

_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_lo:_hi] = True
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E6C63D0876A9A63
_INVERSE = pow(_BASE, -1, 1 << 64)
_power = np.ones(1, np.uint64)
_unpower = np.ones(1, np.uint64)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy() -> None:
    """Gives freed memory back to the system: Python workers are kept between stages, and count for their executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about limit bytes; a longer text is a range of its own."""
    if not len(texts):
        return
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(upto):
        before = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + limit, "right")))
        yield start, stop
        start = stop
    tidy()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and the offsets of each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


def _powers(n: int) -> None:
    global _power, _unpower
    if len(_power) < n:
        size = max(n, 1 << 19)
        for name, base in (("_power", _BASE), ("_unpower", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            globals()[name] = np.cumprod(x, dtype=np.uint64)


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of inside, cut at text boundaries: their starts, their ends, how many each text has."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    full = off[:-1] < off[1:]
    first, last = off[:-1][full], off[1:][full] - 1
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    begin[first] = inside[first]
    end[last] = inside[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.diff(np.searchsorted(starts, off))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, word starts and ends in them, and the words of each text."""
    buf, off = raw(pc.utf8_lower(texts))
    return (buf, *spans(_WORD[buf], off))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end], the same wherever the bytes lie."""
    _powers(len(buf) + 1)
    upto = np.zeros(len(buf) + 1, np.uint64)
    terms = _BYTE[buf]
    terms *= _power[: len(buf)]
    np.cumsum(terms, out=upto[1:])
    h = (upto[ends] - upto[starts]) * _unpower[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def kgrams(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k words on end within a text, the text of each and its place in the text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= np.uint64(0x9DDFEA08EB382D69)
        h += hashes[j : j + n]
    ok = owner[:n] == owner[k - 1 :]
    return mix(h[ok]), owner[:n][ok], (np.arange(n) - first[:n])[ok]


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word k-grams and the text of each; a text of 1 to k - 1 words has one shingle of all of them."""
    buf, starts, ends, counts = words(texts)
    hashes = span_hashes(buf, starts, ends)
    h, owner, _ = kgrams(hashes, counts, k)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        begin = (np.cumsum(counts) - counts)[short]
        own = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            own[has] = own[has] * np.uint64(0x9DDFEA08EB382D69) + hashes[begin[has] + j]
        h, owner = np.concatenate([h, mix(own)]), np.concatenate([owner, short])
    return h, owner
