"""Chunkers on UTF-8 bytes, and their Arrow functions.

A token is estimated as four characters. Cuts look for a paragraph end, a sentence end or
a blank within 50 bytes of the target, the first hit from the left. The markdown chunkers
follow the structure of headings, lists, quotes, tables and fenced code.
"""

from __future__ import annotations

import re
import warnings
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import UserDefinedTableFunction

from loomtext.config import EngineConfig
from loomtext.sources.tables import SLICE_ROWS

WINDOW = 50

_SENTENCE = re.compile(rb"[.?!][ \n]")
_GAP = re.compile(rb"[ \n]")
_OVERLAP = re.compile(rb"[ \n\t]")
_SKIP = re.compile(rb"[ \t\n\r]*")
_SKIP_NO_CR = re.compile(rb"[ \t\n]*")
_LED = re.compile(rb"(?:(?<= )|\A)[\x80-\xff]+")
_RUN = re.compile(rb"[\x80-\xff]+")


def strip(text: bytes) -> bytes:
    return _RUN.sub(b" ", _LED.sub(b"", text))


def chars(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.decode("utf-8", "replace"))


def count_tokens(text: bytes) -> int:
    return (chars(text) + 3) // 4


def offset_for(text: bytes, start: int, tokens: int, plain: bool) -> int:
    """Bytes, from start, of the first 4 * tokens characters."""
    if tokens <= 0:
        return 0
    if plain:
        return min(4 * tokens, len(text) - start)
    return len(text[start : start + 16 * tokens].decode("utf-8", "ignore")[: 4 * tokens].encode())


def break_point(text: bytes, start: int, target: int) -> int:
    """Where to cut text[start:], near target, as bytes from start."""
    end = len(text)
    if target >= end - start:
        return end - start
    low, high = start + max(0, target - WINDOW), min(start + target + WINDOW, end)
    before = max(low - 1, start)
    at = text.find(b"\n\n", before, high)
    if at >= 0:
        return at + 1 - start
    for pattern, begin, plus in ((_SENTENCE, before, 1), (_GAP, low, 0)):
        hit = pattern.search(text, begin, high)
        if hit:
            return hit.start() + plus - start
    return target


def _piece(text: bytes, start: int, size: int, plain: bool) -> int:
    target = offset_for(text, start, size, plain)
    return break_point(text, start, target) or target or len(text) - start


def token_chunks(text: bytes, size: int, overlap: int, strip_ascii: bool = True) -> list[bytes]:
    if strip_ascii:
        text = strip(text)
    if not text:
        return []
    if count_tokens(text) <= size:
        return [text]
    plain, out, start = text.isascii(), [], 0
    while start < len(text):
        end = _piece(text, start, size, plain)
        chunk = text[start : start + end]
        out.append(chunk)
        tokens = count_tokens(chunk)
        if 0 < overlap < tokens:
            hit = _OVERLAP.search(chunk, offset_for(chunk, 0, tokens - overlap, plain))
            start += hit.start() if hit else end
        else:
            start += end
        if start < len(text):
            start = _SKIP.match(text, start).end()
    return out


@dataclass
class Element:
    kind: str
    content: bytes
    context: bytes
    tokens: int = 0

    def __post_init__(self) -> None:
        self.tokens = count_tokens(self.content)


_HEAD_HINT = re.compile(rb"#{1,6}(?=[ \t\n]|\Z)")
_FENCE_HINT = re.compile(rb"```|~~~")
_LIST_HINT = re.compile(rb"(?:[-*+]|[0-9]+[.)])[ \t]")
_PIPES = re.compile(rb"\|[^\n|]*\|")


_BRACKETS = re.compile(rb"[\[\]]")


def _links(text: bytes) -> list[int]:
    """Places of opening brackets whose closing bracket, perhaps lines below, stands before a parenthesis."""
    stack: list[int] = []
    found = []
    for hit in _BRACKETS.finditer(text):
        if hit[0] == b"[":
            stack.append(hit.start())
        elif stack:
            begin = stack.pop()
            if text[hit.end() : hit.end() + 1] == b"(":
                found.append(begin)
    return sorted(found)


def looks_like_markdown(text: bytes) -> bool:
    """A heading or a fence, or two weaker signs."""
    score, heading, fence = 0, False, False
    links = _links(text)
    start = 0
    while start < len(text):
        end = text.find(b"\n", start)
        end = len(text) if end < 0 else end
        pos = start
        while pos < end and pos < 4 and text[pos] == 32:  # an indent counts only at the very start of the text
            pos += 1
        if not heading and _HEAD_HINT.match(text, pos):
            heading = True
            score += 1
        if not fence and _FENCE_HINT.match(text, pos):
            fence = True
            score += 1
        score += bool(_LIST_HINT.match(text, pos)) + (text[pos : pos + 1] == b">")
        at = bisect_left(links, pos)
        score += bool(_PIPES.search(text, pos, end)) or (at < len(links) and links[at] < end)
        if score >= 2:
            return True
        start = end + 1
    return heading or fence


_LINE = re.compile(rb"[^\n]*\n|[^\n]+\Z")
_HEADING = re.compile(rb"(#{1,6})(?=[ \t]|\Z)[ \t]*(.*)", re.S)
_FENCE = re.compile(rb" {0,3}(?:```|~~~)")
_RULE = re.compile(rb" {0,3}(?:-[ ]*-[ ]*-[- ]*|\*[ ]*\*[ ]*\*[* ]*|_[ ]*_[ ]*_[_ ]*)\Z")
_KINDS = (("list", re.compile(rb"[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]")), ("quote", re.compile(rb" {0,3}>")), ("table", re.compile(rb".*\|", re.S)))


def elements(text: bytes) -> list[Element]:
    """The parts of a markdown text in order, each with the headings above it."""
    out: list[Element] = []
    block, kind, context = b"", "paragraph", b""
    above: list[bytes | None] = [None] * 6
    in_code = False

    def flush() -> None:
        nonlocal block
        if block:
            out.append(Element(kind, block, context))
        block = b""

    for line in _LINE.findall(text):
        body = line[:-1] if line.endswith(b"\n") else line
        if _FENCE.match(body):
            if in_code:
                block += line
                flush()
                in_code, kind = False, "paragraph"
                continue
            flush()
            in_code, kind = True, "code"
        if in_code:
            block += line
            continue
        if not body.strip(b" \t\r"):
            flush()
            kind = "paragraph"
            continue
        heading = _HEADING.match(body)
        if heading:
            flush()
            level = len(heading[1])
            above[level - 1 :] = [heading[2]] + [None] * (6 - level)
            context = b" > ".join(b"#" * (i + 1) + b" " + h for i, h in enumerate(above) if h is not None)
            out.append(Element("heading", body, context))
            kind = "paragraph"
            continue
        if _RULE.match(body):
            flush()
            out.append(Element("rule", body, context))
            kind = "paragraph"
            continue
        for name, pattern in _KINDS:
            if pattern.match(body):
                if kind != name:
                    flush()
                kind = name
        block = block + b"\n" + body if block else body
    flush()
    return out


def _split(parts: list[Element], size: int, skip: re.Pattern[bytes]) -> list[Element]:
    out = []
    for part in parts:
        if part.tokens <= size:
            out.append(part)
            continue
        text, start = part.content, 0
        plain = text.isascii()
        while start < len(text):
            end = _piece(text, start, size, plain)
            out.append(Element(part.kind, text[start : start + end], part.context))
            start = skip.match(text, start + end).end()
    return out


def _merged(parts: list[Element], least: int, most: int) -> list[Element]:
    out: list[Element] = []
    waiting: Element | None = None
    for part in parts:
        if waiting is not None and waiting.context == part.context and waiting.tokens + part.tokens <= most:
            waiting = Element(waiting.kind, waiting.content + b"\n\n" + part.content, waiting.context)
            continue
        if waiting is not None:
            out.append(waiting)
            waiting = None
        if part.tokens >= least:
            out.append(part)
        else:
            waiting = part
    return out if waiting is None else [*out, waiting]


def _labelled(parts: list[Element]) -> list[bytes]:
    return [b"[Context: " + p.context + b"]\n\n" + p.content if p.context else p.content for p in parts]


def structured_chunks(text: bytes, size: int, overlap: int, merge: bool, strip_ascii: bool = True) -> list[bytes]:
    """The hybrid strategy with merge, the markdown one without; a plain text is cut by tokens."""
    if not text:
        return []
    if not looks_like_markdown(text):
        return token_chunks(text, size, overlap, strip_ascii)
    parts = [p for p in elements(text) if p.kind != "rule"]
    if not merge:
        return _labelled(_split(parts, size, _SKIP_NO_CR))
    return _labelled(_merged(_split(parts, size, _SKIP), max(20, size // 4), size))


_STRATEGIES = {"token_based": "token", "token": "token", "markdown": "markdown", "hybrid": "hybrid"}


def strategy_of(name: str | None) -> str:
    found = _STRATEGIES.get((name or "token").lower())
    if found is None:
        warnings.warn(f"chunk strategy {name!r} is not available, cutting by tokens", stacklevel=2)
    return found or "token"


def chunk(text: str | None, strategy: str | None = None, size: int | None = None, overlap: int | None = None, config: EngineConfig | None = None) -> list[str] | None:
    """Chunks of one text; a null text gives null, settings left out are the configuration's."""
    if text is None:
        return None
    config = config or EngineConfig()
    size = config.default_chunk_size if size is None else size
    overlap = config.default_chunk_overlap if overlap is None else overlap
    kind, data = strategy_of(strategy or config.default_chunk_strategy), text.encode()
    found = token_chunks(data, size, overlap, config.strip_non_ascii) if kind == "token" else structured_chunks(data, size, overlap, kind == "hybrid", config.strip_non_ascii)
    return [c.decode("utf-8", "replace") for c in found]


def chunk_text(text: Column, strategy: str | None = None, size: int | None = None, overlap: int | None = None, config: EngineConfig | None = None) -> Column:
    """array<string> of a text's chunks, batch by batch through Arrow."""
    config = config or EngineConfig()
    # Resolved here, so that an unknown strategy warns once and on the driver.
    kind = strategy_of(strategy or config.default_chunk_strategy)

    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array([chunk(t, kind, size, overlap, config) for t in texts.slice(i, SLICE_ROWS).to_pylist()], pa.list_(pa.string())) for i in range(0, max(len(texts), 1), SLICE_ROWS)]
        found = pa.concat_arrays(parts)
        del parts
        pa.default_memory_pool().release_unused()
        return found

    return F.arrow_udf(run, T.ArrayType(T.StringType()))(text.cast("string"))


def is_markdown(text: Column) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else looks_like_markdown(t.encode()) for t in texts.to_pylist()], pa.bool_())

    return F.arrow_udf(run, T.BooleanType())(text.cast("string"))


def _strict(texts: pa.Array, strategies: pa.Array, sizes: pa.Array, overlaps: pa.Array) -> pa.Array:
    rows = zip(*(a.to_pylist() for a in (texts, strategies, sizes, overlaps)))
    return pa.array([None if None in row else chunk(*row) for row in rows], pa.list_(pa.string()))


def strict_udf():
    """chunk_text for SQL: four arguments, null if any of them is null."""
    return F.arrow_udf(_strict, T.ArrayType(T.StringType()))


class _ChunkTable:
    def eval(self, text: str, strategy: str, size: int, overlap: int) -> Iterator[tuple[int, str, int]]:
        for i, c in enumerate(chunk(text, strategy, size, overlap) or [], 1):
            yield i, c, len(c) // 4


def chunk_table_udtf() -> UserDefinedTableFunction:
    """chunk_table(text, strategy, size, overlap) -> (chunk_index, content, token_count)."""
    return F.udtf(_ChunkTable, returnType="chunk_index int, content string, token_count int")
