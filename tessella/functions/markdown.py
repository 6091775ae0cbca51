"""Markdown texts as blocks, and blocks as chunks under a size: one pass over a document's lines with a small state.

Blocks that mean something only as a whole (fences, tables, formulas) are never cut. Lists hold their nested lists and
continued lines. Each block knows the headings it stands under.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

HEADING = re.compile(r"^(#{1,6})[ \t]+(.*)$")
FENCE = re.compile(r"^[ ]{0,3}(`{3,}|~{3,})")
ITEM = re.compile(r"^(\s*)([-*+]|\d{1,9}[.)])[ \t]+\S")
RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
WHOLE = ("fence", "table", "formula")


@dataclass
class Block:
    kind: str
    lines: list[str]
    headings: tuple[str, ...]
    level: int = 0

    @property
    def text(self) -> str:
        return "\n".join(self.lines)


def _end_of(lines: list[str], at: int, kind: str) -> int:
    """The line behind the block that begins at `at`."""
    n, end = len(lines), at + 1
    if kind == "fence":
        mark = FENCE.match(lines[at])[1]
        while end < n and not re.match(rf"^[ ]{{0,3}}{re.escape(mark[0])}{{{len(mark)},}}\s*$", lines[end]):
            end += 1
        return min(n, end + 1)  # a fence that is never closed goes to the end
    if kind == "formula":
        if lines[at].strip() != "$$" and lines[at].strip().endswith("$$") and len(lines[at].strip()) > 3:
            return end
        while end < n and not lines[end].strip().endswith("$$"):
            end += 1
        return min(n, end + 1)
    if kind == "markup":
        while end < n and "</table>" not in lines[end - 1].lower():
            end += 1
        return end
    if kind == "table":
        while end < n and "|" in lines[end] and lines[end].strip():
            end += 1
        return end
    if kind == "quote":
        while end < n and lines[end].lstrip().startswith(">"):
            end += 1
        return end
    if kind == "list":
        while end < n:
            line = lines[end]
            blank = not line.strip()
            ahead = next((x for x in lines[end:] if x.strip()), "") if blank else line
            goes_on = ITEM.match(ahead) or (ahead[:1] in (" ", "\t"))
            if not goes_on and (blank or opens(lines, end)):
                break
            end += 1
        while not lines[end - 1].strip():
            end -= 1
        return end
    while end < n and lines[end].strip() and not opens(lines, end):
        end += 1
    return end


def opens(lines: list[str], at: int) -> str | None:
    """The kind of block that a line begins whatever stands before it; None for a plain line."""
    line = lines[at]
    if HEADING.match(line):
        return "heading"
    if FENCE.match(line):
        return "fence"
    if line.strip().startswith("$$"):
        return "formula"
    if "<table" in line.lower():
        return "markup"
    if "|" in line and at + 1 < len(lines) and "|" in lines[at + 1] and RULE.match(lines[at + 1]):
        return "table"
    if ITEM.match(line):
        return "list"
    if line.lstrip().startswith(">"):
        return "quote"
    return None


def blocks(text: str) -> list[Block]:
    lines, out, at = text.split("\n"), [], 0
    stack: list[tuple[int, str]] = []
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        kind = opens(lines, at) or "paragraph"
        end = at + 1 if kind == "heading" else _end_of(lines, at, kind)
        level = 0
        if kind == "heading":
            level = len(HEADING.match(lines[at])[1])
            while stack and stack[-1][0] >= level:
                stack.pop()
        out.append(Block("table" if kind == "markup" else kind, lines[at:end], tuple(h for _, h in stack), level))
        if kind == "heading":
            stack.append((level, lines[at].strip()))
        at = end
    return out


def size(text: str) -> int:
    """Words and single marks, as `token_count` has them."""
    return len(re.findall(r"[^\W]+|[^\w\s]", text))


def sentences(block: Block, most: int) -> list[str]:
    """A block that is too large in pieces of whole lines, then of whole sentences, then of words; blocks that stay whole in one."""
    if block.kind in WHOLE or size(block.text) <= most:
        return [block.text]
    out, open_, used = [], "", 0
    for line in block.lines:
        parts = [line] if size(line) <= most else re.findall(r"[^.!?。！？]*[.!?。！？]+\s*|[^.!?。！？]+$", line)
        for k, part in enumerate(parts):
            bits = [part] if size(part) <= most else re.findall(r"\S+\s*", part)
            for j, bit in enumerate(bits):
                n = size(bit)
                fresh = "\n" if k == 0 and j == 0 and open_ else ""
                if open_ and used + n > most:
                    out.append(open_)
                    open_, used, fresh = "", 0, ""
                open_, used = open_ + fresh + bit, used + n
    return [*out, open_] if open_ else out


def chunks(text: str, least: int, most: int, split_level: int = 6, parents: bool = False) -> list[tuple[str, str]]:
    """(heading path, content) of chunks.

    A heading of `split_level` or above closes a chunk that has `least` tokens; a block that would bring a chunk
    over `most` begins the next one. A last chunk under `least` joins the one before if both fit. With
    `parents` a chunk begins with the headings above it that it doesn't hold itself.
    """
    out: list[list] = []  # path, parts, tokens
    for b in blocks(text):
        for piece in sentences(b, most):
            n = size(piece)
            closes = b.kind == "heading" and b.level <= split_level and out and out[-1][2] >= least
            if not out or closes or (out[-1][2] + n > most and not all(p.startswith("#") for p in out[-1][1])):
                out.append([b.headings, [], 0])
            out[-1][1].append(piece)
            out[-1][2] += n
    if len(out) > 1 and out[-1][2] < least and out[-2][2] + out[-1][2] <= most:
        last = out.pop()
        out[-1][1] += last[1]
    return [(" > ".join(h.lstrip("#").strip() for h in path), "\n".join([*(path if parents else ()), *parts])) for path, parts, _ in out]


def told(docs: DataFrame, key: str, text: str, work: Callable[[str], list[dict]], row: str, at_once: int = 32) -> DataFrame:
    """(key, pos, fields of `row`): the rows that work(text) gives, numbered in each text; null has none. A task holds the
    rows of `at_once` texts, however many come in a batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                few = batch.slice(at, at_once)
                rows = [{key: k, "pos": p} | r for k, t in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True) for p, r in enumerate(work(t) if t else [])]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=form)

    kind = docs.select(F.col(key).alias(key)).schema
    names = [x.split(":")[0].split()[0] for x in row.split(",")]
    form = pa.schema([(key, to_arrow_type(kind[0].dataType)), ("pos", pa.int32()), *((n, pa.string()) for n in names)])
    return docs.select(key, text).mapInArrow(each, f"{key} {kind[0].dataType.simpleString()}, pos int, {row}")


def block_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, kind, content, path): a text's blocks with their heading path."""
    row = lambda b: {"kind": b.kind, "content": b.text, "path": " > ".join(h.lstrip("#").strip() for h in b.headings)}
    return told(docs, key, text, lambda t: [row(b) for b in blocks(t)], "kind string, content string, path string")


def chunk_rows(docs: DataFrame, key: str, text: str, least: int = 32, most: int = 256, split_level: int = 6, parents: bool = False) -> DataFrame:
    """(key, pos, path, content): a text's chunks."""
    return told(docs, key, text, lambda t: [{"path": p, "content": c} for p, c in chunks(t, least, most, split_level, parents)], "path string, content string")
