"""Chunkers of Markdown and text, and the folds that merge their pieces.

A document's lines depend on one another, so each document is folded by one
Python call inside an Arrow batch; documents are independent and are never
grouped or shuffled for it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Fixed sizes in characters.
RUNBOOK_CHARS, RUNBOOK_BODY = 1400, 200
SPLIT_CHARS, SPLIT_OVERLAP, MERGE_BELOW = 1600, 100, 300
BASELINE_CHARS = 800
SEPARATORS = ("\n\n", "\n", " ", "")

_RUNBOOK_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
_HEADING, _FENCE = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$"), re.compile(r"^\s*(```|~~~)")

CHUNK = "doc_id string, chunk_index int, chunk_id string, title string, section_path array<string>, first_line int, last_line int, text string"


def sections(text: str, levels: int = 6) -> Iterator[tuple[list[str], int, int, str]]:
    """H2: (heading path, first line, last line, body) of each section with a body.

    A heading inside a fence is text.  Lines count from 1.
    """
    path: list[tuple[int, str]] = []
    body: list[str] = []
    start, fence = 1, ""

    def made(end: int) -> Iterator[tuple[list[str], int, int, str]]:
        if any(line.strip() for line in body):
            yield [t for _, t in path], start, end, "\n".join(body).strip("\n")

    lines = text.split("\n")
    for number, line in enumerate(lines, 1):
        mark = _FENCE.match(line)
        if mark:
            fence = "" if fence == mark[1] else fence or mark[1]
        heading = None if fence or mark else _HEADING.match(line)
        if heading and len(heading[1]) <= levels:
            yield from made(number - 1)
            path = [*(p for p in path if p[0] < len(heading[1])), (len(heading[1]), heading[2].strip())]
            body, start = [], number
        else:
            body.append(line)
    yield from made(len(lines))


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """H2, H3: pieces of at most ``size`` characters, cut at the coarsest separator that does.

    Pieces are joined while they fit; a new one starts with the last pieces of
    the one before, as far as they are within the overlap.
    """
    if len(text) <= size:
        return [text] if text.strip() else []
    mark = next((s for s in separators if not s or s in text), "")
    finer = separators[separators.index(mark) + 1 :] if mark in separators else ()
    parts = text.split(mark) if mark else list(text)
    out: list[str] = []
    held: list[str] = []
    for part in parts:
        if len(part) > size:
            if held:
                out.append(mark.join(held))
                held = []
            out.extend(split_recursively(part, size, overlap, finer))
            continue
        if held and len(mark.join([*held, part])) > size:
            out.append(mark.join(held))
            while held and (len(mark.join(held)) > overlap or len(mark.join([*held, part])) > size):
                held.pop(0)
        held.append(part)
    if held:
        out.append(mark.join(held))
    return [p.strip() for p in out if p.strip()]


def merge_small(pieces: list[str], below: int = MERGE_BELOW, size: int = SPLIT_CHARS, glue: str = "\n\n") -> list[str]:
    """A piece shorter than ``below`` joins the one before, if that is shorter than ``size``."""
    out: list[str] = []
    for piece in pieces:
        if out and len(piece) < below and len(out[-1]) < size:
            out[-1] = out[-1] + glue + piece
        else:
            out.append(piece)
    return out


def line_windows(text: str, size: int = BASELINE_CHARS, overlap: int = SPLIT_OVERLAP) -> list[tuple[int, int, str]]:
    """Whole lines up to ``size`` characters; trailing lines within the overlap are carried on."""
    out: list[tuple[int, int, str]] = []
    held: list[tuple[int, str]] = []
    fresh = 0
    for number, line in enumerate(text.split("\n"), 1):
        held.append((number, line))
        fresh += 1
        if sum(len(t) + 1 for _, t in held) >= size:
            out.append((held[0][0], number, "\n".join(t for _, t in held)))
            kept: list[tuple[int, str]] = []
            for item in reversed(held):
                if sum(len(t) + 1 for _, t in kept) + len(item[1]) + 1 > overlap:
                    break
                kept.insert(0, item)
            held, fresh = kept, 0
    if fresh and any(t.strip() for _, t in held):
        out.append((held[0][0], held[-1][0], "\n".join(t for _, t in held)))
    return [w for w in out if w[2].strip()]


def runbook_sections(text: str) -> tuple[str | None, list[tuple[list[str], int, int, str]]]:
    """H1: the last heading of the first level, and (heading path, first line, last line, text) of sections with a body.

    A section's text begins with its heading line; a line of three backticks or
    tildes opens or closes a fence, and no heading is read inside.
    """
    title, stack, found, held, start, fenced = None, [], [], [], 1, False
    lines = text.splitlines()
    for number, line in enumerate([*lines, None], 1):
        if line is not None and line.strip().startswith(("```", "~~~")):
            fenced = not fenced
        heading = None if line is None or fenced else _RUNBOOK_HEADING.match(line)
        if heading or line is None:
            if any(x.strip() and not _RUNBOOK_HEADING.match(x) for x in held):
                found.append(([t for t in stack if t], start, number - 1, "\n".join(held).strip()))
            held, start = [], number
        if heading:
            depth, name = len(heading[1]), heading[2].strip()
            title = name if depth == 1 else title
            stack = [*stack[: depth - 1], *[""] * (depth - 1 - len(stack)), name]
        if line is not None:
            held.append(line)
    return title, found


def packed_paragraphs(text: str, size: int) -> list[str]:
    """H1: paragraphs joined while they fit; a longer one is cut every ``size`` characters and stands alone."""
    if len(text) <= size:
        return [text]
    out, held = [], ""
    for part in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if not part:
            continue
        if held and (len(part) > size or len(held) + 2 + len(part) > size):
            out.append(held)
            held = ""
        if len(part) > size:
            out += [part[i : i + size] for i in range(0, len(part), size)]
        else:
            held = f"{held}\n\n{part}" if held else part
    return [*out, held] if held else out


def runbook_rows(doc_id: str, text: str, chars: int = RUNBOOK_CHARS) -> Iterator[tuple]:
    """H1: sections in pieces of at most 1400 characters, document and section named in front of each.

    ``doc_id`` is the source file: its stem is the document's title where no
    heading of the first level is, and its digest stands in the ids.
    """
    digest = hashlib.sha1(doc_id.encode()).hexdigest()[:10]
    title, found = runbook_sections(text)
    title = PurePosixPath(doc_id).stem if title is None else title
    n = 0
    for path, first, last, body in found:
        prefix = f"文档：{title}\n章节：{' > '.join(path) or title}\n\n"
        for piece in packed_paragraphs(body, max(RUNBOOK_BODY, chars - len(prefix))):
            n += 1
            yield n - 1, f"aiops_{digest}_{n:04d}", path[-1] if path else title, path, first, last, (prefix + piece).strip()


def header_rows(doc_id: str, text: str, levels: int = 2, size: int = SPLIT_CHARS, overlap: int = SPLIT_OVERLAP) -> Iterator[tuple]:
    """H2, H3: sections by headings of the first levels, split, and short pieces merged."""
    n = 0
    for path, first, last, body in sections(text, levels):
        for piece in merge_small(split_recursively(body, size, overlap), MERGE_BELOW, size):
            n += 1
            yield n - 1, f"{doc_id}_{n:04d}", path[-1] if path else "", path, first, last, piece


def window_rows(doc_id: str, text: str) -> Iterator[tuple]:
    """H4: line windows."""
    for n, (first, last, piece) in enumerate(line_windows(text)):
        yield n, f"{doc_id}_{n + 1:04d}", piece.strip().split("\n")[0][:80], [], first, last, piece


def chunked(docs: DataFrame, rows: Callable[[str, str], Iterator[tuple]]) -> DataFrame:
    """Chunks of every document; a null or blank text has none. ``docs`` has doc_id and text."""
    names = ["doc_id", "chunk_index", "chunk_id", "title", "section_path", "first_line", "last_line", "text"]
    types = pa.schema([("doc_id", pa.string()), ("chunk_index", pa.int32()), ("chunk_id", pa.string()), ("title", pa.string()), ("section_path", pa.list_(pa.string())), ("first_line", pa.int32()), ("last_line", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in slices(batches):
            made = [(d, *row) for d, t in zip(doc_ids, texts, strict=True) if t for row in rows(str(d), t)]
            for i in range(0, len(made), CHUNK_ROWS):
                columns = zip(*made[i : i + CHUNK_ROWS], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, types.field(n).type) for n, c in zip(names, columns, strict=True)], schema=types)

    return docs.selectExpr("cast(doc_id AS string) AS doc_id", "text").mapInArrow(run, CHUNK)


#: Documents of a slice, the bytes of their texts that end it sooner, and chunks handed on at once.
SLICE_ROWS, SLICE_BYTES, CHUNK_ROWS = 100, 1_000_000, 500


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Ids and texts of few documents at a time, however many a batch holds."""
    for batch in batches:
        texts = batch.column(1)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and (i - start >= SLICE_ROWS or held + size > SLICE_BYTES):
                yield batch.column(0).slice(start, i - start).to_pylist(), texts.slice(start, i - start).to_pylist()
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.column(0).slice(start).to_pylist(), texts.slice(start).to_pylist()


def merged_siblings(chunks: list[dict], small: int, target: int, most: int, always_small: bool = True) -> list[dict]:
    """H5, H8: adjacent chunks of one parent and tier merged while they are short.

    ``always_small`` merges what is below ``small`` even beyond ``most`` (the
    older rule); without it ``most`` comes first.  Chunks are dicts in order
    with parent_id, tier and text; auxiliary ones stay alone.
    """
    out: list[dict] = []
    for chunk in chunks:
        last = out[-1] if out else None
        if last and last["parent_id"] == chunk["parent_id"] and last["tier"] == chunk["tier"] == "primary":
            both = len(last["text"]) + 1 + len(chunk["text"])
            short = min(len(last["text"]), len(chunk["text"]))
            if (always_small and short < small) or (both <= most and (short < small or len(last["text"]) < target)):
                out[-1] = {**last, "text": last["text"] + "\n" + chunk["text"], "ids": [*last["ids"], *chunk["ids"]]}
                continue
        out.append(dict(chunk))
    return out


def collapsed_parents(chunks: list[dict]) -> list[dict]:
    """H6: a support chunk with a single child is replaced by the child, to a fixed point."""
    rows = {c["chunk_id"]: dict(c) for c in chunks}
    order = [c["chunk_id"] for c in chunks]
    while True:
        kids: dict[str, list[str]] = {}
        for i in order:
            if rows[i]["parent_id"] in rows:
                kids.setdefault(rows[i]["parent_id"], []).append(i)
        lone = next((p for p in order if rows[p]["tier"] == "support" and len(kids.get(p, ())) == 1 and rows[kids[p][0]]["tier"] not in ("auxiliary", "big_support")), None)
        if lone is None:
            return [rows[i] for i in order]
        child = kids[lone][0]
        own = rows[lone]["text"]
        rows[child] = {**rows[child], "parent_id": rows[lone]["parent_id"], "text": rows[child]["text"] if own in rows[child]["text"] else own + "\n" + rows[child]["text"]}
        del rows[lone]
        order.remove(lone)


def integrated(chunks: DataFrame, small: int = 200, target: int = 400, most: int = 800, always_small: bool = True) -> DataFrame:
    """H7, H8: each document's chunks merged, collapsed and renumbered.

    ``chunks`` has doc, pos, chunk_id, parent_id, tier and text.  A document's
    chunks are one group: its size is that of one document.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = [
            {"chunk_id": r.chunk_id, "parent_id": r.parent_id if isinstance(r.parent_id, str) else None, "tier": r.tier, "text": r.text or "", "ids": [r.chunk_id]}
            for r in group.sort_values(["pos", "chunk_id"]).itertuples(index=False)
        ]
        rows = collapsed_parents(merged_siblings(rows, small, target, most, always_small))
        new = {old: f"{group.doc.iloc[0]}_{n:04d}" for n, row in enumerate(rows, 1) for old in row["ids"]}
        data = [(group.doc.iloc[0], new[r["chunk_id"]], new.get(r["parent_id"]), r["tier"], r["text"], len(r["ids"])) for r in rows]
        return pd.DataFrame(data, columns=["doc", "chunk_id", "parent_id", "tier", "text", "n_merged"])

    return chunks.groupBy("doc").applyInPandas(run, "doc string, chunk_id string, parent_id string, tier string, text string, n_merged int")
