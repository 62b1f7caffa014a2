"""Benchmark decontamination by a positional inverted index (operator 5).

The corpus is cut in segments of documents.  A segment is one row: its
documents with their first token positions, its term dictionary, and for every
term its ascending token positions.  Segments are independent, so a frequent
term is a long list in each of many segments and never one list in one task,
and a lost executor costs the segments that it was building.

A query sequence is answered inside each segment: its terms are ordered from
rare to frequent by their counts there, the rarest term's positions
less its offset are the candidates, and each further term's offset-adjusted
list is intersected with them.  Gaps between documents in position space keep a
match within one document.  Sequences with a term that the segment lacks are
left out at once; the others are intersected many at a time.

The benchmark is the query set: it is read in blocks of at most ``block_items``
items and ``BLOCK_BYTES`` of text (a longer item is a block of its own), each
block is one pass over the index, and one block at a time is on the driver and
goes to the tasks.

Defined results: null and empty texts have no words and are never hit; an item
without words occurs nowhere; repeated items count as one item id each time they
differ in id; a row with a null doc_id is returned with a null id; a null
item_id stands for no item.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, scratch

#: Words of a window; a shorter item, but not an empty one, is one window.
WINDOW = 10
#: Tokens after which a segment is closed; one longer document is a segment of its own.
SEGMENT_TOKENS = 1_000_000
#: Items, and bytes of their texts, in a block of queries.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 4 << 20
#: Sequences, and postings of their rarest terms, that are intersected at once.
SEQUENCES_AT_ONCE, POSTINGS_AT_ONCE = 100_000, 1_000_000

SEGMENT = "segment long, doc_ids array<long>, starts array<int>, sizes array<int>, terms binary, counts binary, positions binary"

#: A-Z to a-z; word bytes stay, all others become spaces.
_WORD_BYTES = bytes((b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20) for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


def _segment(ids: list, tokens: list[list[bytes]], gap: int) -> list:
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    flat: list[int] = []
    starts, sizes, spans, at = [], [], [], 0
    for found in tokens:
        starts.append(at)
        sizes.append(len(found))
        flat.extend(map(numbers.__getitem__, found))
        spans.append(np.arange(at, at + len(found), dtype=np.int64))
        at += len(found) + gap
    of = np.array(flat, np.int32)
    order = np.argsort(of, kind="stable")
    positions = np.concatenate(spans)[order].astype("<u4")
    counts = np.bincount(of, minlength=len(numbers)).astype("<u4")
    return [ids, starts, sizes, b" ".join(numbers), counts.tobytes(), positions.tobytes()]


def build_index(docs: DataFrame, gap: int = WINDOW, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """One row a segment; ``gap`` positions at least lie between two documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
        names = ["segment", "doc_ids", "starts", "sizes", "terms", "counts", "positions"]
        number = count(TaskContext.get().partitionId() << 32)

        def close(ids: list, tokens: list) -> pa.RecordBatch:
            values = [next(number), *_segment(ids, tokens, gap)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

        ids, tokens, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(text)
                ids.append(doc_id)
                tokens.append(found)
                held += len(found) + gap
                if held >= segment_tokens:
                    yield close(ids, tokens)
                    ids, tokens, held = [], [], 0
        if ids:
            yield close(ids, tokens)

    return documents(docs).mapInArrow(run, SEGMENT)


@dataclass
class Block:
    """Word sequences as numbers.

    ``flat`` holds the term numbers of all texts end to end; a sequence is
    ``widths`` terms from ``first`` on and belongs to the text ``owner``.
    """

    names: list[str]
    terms: dict[bytes, int]
    flat: np.ndarray
    first: np.ndarray
    widths: np.ndarray
    owner: np.ndarray


def block_of(texts: Iterable[tuple[str, str]], width: int | None = None) -> Block:
    """The windows of (id, text) pairs, or with no ``width`` each whole text as one sequence."""
    terms: dict[bytes, int] = defaultdict()
    terms.default_factory = terms.__len__
    names, flat, first, widths, owner, at = [], [], [], [], [], 0
    for k, (name, text) in enumerate(texts):
        found = words(text)
        names.append(name)
        if not found:
            continue
        flat.append(np.fromiter(map(terms.__getitem__, found), np.int32, len(found)))
        wide = min(width or len(found), len(found))
        n = len(found) - wide + 1
        first.append(np.arange(at, at + n))
        widths.append(np.full(n, wide))
        owner.append(np.full(n, k))
        at += len(found)
    whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return Block(names, dict(terms), whole(flat), whole(first), whole(widths), whole(owner))


class Segment:
    """One opened segment, with the lists of the terms ``asked`` for."""

    def __init__(self, segment: int, doc_ids: list, starts: list, sizes: list, terms: bytes, counts: bytes, positions: bytes, asked: dict[bytes, int]) -> None:
        self.segment, self.doc_ids, self.starts, self.sizes = segment, doc_ids, np.array(starts, np.int64), np.array(sizes, np.int64)
        held = np.frombuffer(counts, "<u4").astype(np.int64)
        names = terms.split(b" ") if terms else []
        self.positions = np.frombuffer(positions, "<u4").astype(np.int64)
        self._begin = np.cumsum(held) - held
        self.lists = {t: i for i, t in enumerate(names) if t in asked}
        # (term, position) as one ascending number: an entry of a term's list is found by bisection.
        self._entries = np.repeat(np.arange(len(held)) << 32, held) | self.positions
        self._held = held

    def postings(self, term: bytes) -> np.ndarray:
        i = self.lists.get(term)
        return self.positions[:0] if i is None else self.positions[self._begin[i] : self._begin[i] + self._held[i]]

    def occurrences(self, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Every (sequence, position of its first word) of a block, in parts."""
        local, counts = np.zeros(len(block.terms), np.int64), np.zeros(len(block.terms), np.int64)
        for term, i in self.lists.items():
            n = block.terms[term]
            local[n], counts[n] = i, self._held[i]
        lacking = np.concatenate([[0], np.cumsum(counts[block.flat] == 0)])
        whole = np.flatnonzero(lacking[block.first + block.widths] == lacking[block.first])
        for at in range(0, len(whole), SEQUENCES_AT_ONCE):
            yield from self._intersected(block, whole[at : at + SEQUENCES_AT_ONCE], local, counts)

    def _intersected(self, block: Block, asked: np.ndarray, local: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        widths = block.widths[asked]
        begin = np.cumsum(widths) - widths
        of = np.repeat(np.arange(len(asked)), widths)
        offset = np.arange(len(of)) - begin[of]
        term = block.flat[block.first[asked][of] + offset]
        rare_first = np.lexsort((offset, counts[term], of))
        term, offset = term[rare_first], offset[rare_first]
        n = counts[term[begin]]
        part = np.cumsum(n) // POSTINGS_AT_ONCE
        for some in np.split(np.arange(len(asked)), np.flatnonzero(np.diff(part)) + 1):
            which = np.repeat(some, n[some])
            nth = np.arange(len(which)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
            rarest = begin[which]
            at = self.positions[self._begin[local[term[rarest]]] + nth] - offset[rarest]
            which, at = which[at >= 0], at[at >= 0]
            step = 1
            while len(which) and step < widths[which].max():
                # A sequence that has no further term meets its last one again.
                j = begin[which] + np.minimum(step, widths[which] - 1)
                entry = local[term[j]] << 32 | (at + offset[j])
                place = np.searchsorted(self._entries, entry)
                there = self._entries[np.minimum(place, len(self._entries) - 1)] == entry
                which, at, step = which[there], at[there], step + 1
            if len(which):
                yield asked[which], at

    def near(self, query: tuple[bytes, ...], slop: int) -> list[tuple[int, int]]:
        """Spans (first, last) of at most len(query) + slop words that hold all terms in order.

        One span for each occurrence of the first term from which every next
        term is taken as early as it can be.
        """
        if not query or any(t not in self.lists for t in query):
            return []
        starts = self.postings(query[0])
        at, alive = starts.copy(), np.ones(len(starts), bool)
        for term in query[1:]:
            there = self.postings(term)
            k = np.searchsorted(there, at, side="right")
            alive &= k < len(there)
            at = np.where(k < len(there), there[np.minimum(k, len(there) - 1)], at)
        owner = lambda x: np.searchsorted(self.starts, x, side="right")
        alive &= (at - starts < len(query) + slop) & (owner(at) == owner(starts))
        return list(zip(starts[alive].tolist(), at[alive].tolist(), strict=True))


def _segments(index: DataFrame, task, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from task([batch.column(i)[row].as_py() for i in range(7)])

    return index.mapInArrow(run, schema)


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The query set in blocks of bounded size, read one after another."""
    block, held = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).filter("i is not null and t is not null")
    for row in rows.toLocalIterator():
        size = len(row.t.encode())
        if block and (len(block) >= block_items or held + size > block_bytes):
            yield block
            block, held = [], 0
        block.append((row.i, row.t))
        held += size
    if block:
        yield block


def search(index: DataFrame, queries: Iterable[tuple[str, str]], slop: int = 0) -> DataFrame:
    """Every exact occurrence of each query phrase; with ``slop``, proximity matches too.

    ``queries`` are (id, text) pairs of a bounded block.  Returns doc_id, id,
    position (of the first word in the document), width (words from the first to
    the last) and exact.
    """
    asked = list(queries)
    block = block_of(asked)
    phrases = [tuple(words(t)) for _, t in asked]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_()]

    def task(row: list) -> Iterator[pa.RecordBatch]:
        held, out = Segment(*row, asked=block.terms), []
        spans: dict[tuple[int, int, int], bool] = {}
        for which, at in held.occurrences(block):
            spans.update(((k, a, a + n - 1), True) for k, a, n in zip(block.owner[which].tolist(), at.tolist(), block.widths[which].tolist(), strict=True))
        for k, phrase in enumerate(phrases if slop else ()):
            for a, b in held.near(phrase, slop):
                spans.setdefault((k, a, b), False)
        for (k, first, last), exact in spans.items():
            d = int(np.searchsorted(held.starts, first, side="right")) - 1
            out.append((held.doc_ids[d], block.names[k], first - int(held.starts[d]), last - first + 1, exact))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "id", "position", "width", "exact"])

    return _segments(index, task, "doc_id long, id string, position long, width int, exact boolean")


def contamination(index: DataFrame, items: list[tuple[str, str]], width: int = WINDOW) -> DataFrame:
    """segment and ordinal, doc_id, n_words, hits (distinct hit word positions) and items, per document.

    Every document of the index has a row; a document lies in one segment, so
    nothing is shuffled.
    """
    block = block_of(items, width)

    def task(row: list) -> Iterator[pa.RecordBatch]:
        held = Segment(*row, asked=block.terms)
        end = int(held.starts[-1] + held.sizes[-1]) if len(held.starts) else 0
        marks, names = np.zeros(end + 1, np.int32), defaultdict(set)
        for which, at in held.occurrences(block):
            np.add.at(marks, at, 1)
            np.add.at(marks, at + block.widths[which], -1)
            owner = (np.searchsorted(held.starts, at, side="right") - 1) * len(block.names) + block.owner[which]
            for d, k in zip(*(x.tolist() for x in divmod(np.unique(owner), len(block.names))), strict=True):
                names[d].add(block.names[k])
        hit = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        cut = np.searchsorted(hit, np.r_[held.starts, end + 1])
        hits = [(hit[a:b] - s).tolist() for a, b, s in zip(cut, cut[1:], held.starts, strict=False)]
        n = len(hits)
        columns = [pa.array([held.segment] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(held.doc_ids, pa.int64()), pa.array(held.sizes)]
        columns += [pa.array(hits, pa.list_(pa.int64())), pa.array([sorted(names.get(d, ())) for d in range(n)], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["segment", "ordinal", "doc_id", "n_words", "hits", "items"])

    return _segments(index, task, "segment long, ordinal int, doc_id long, n_words long, hits array<long>, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items and contaminated for every row of ``docs``."""
    spark = docs.sparkSession
    index = materialize(build_index(docs, width), f"{scratch(spark, 'decontam')}/index")
    blocks = item_blocks(benchmark, block_items=block_items)
    first, second = next(blocks, []), next(blocks, None)
    every = contamination(index, first, width)
    if second is not None:
        # Every document from the first block, from the others those that are hit, united by their places in the index.
        folder = scratch(spark, "decontam-blocks")
        paths = [f"{folder}/0"]
        materialize(every, paths[0])
        for block in chain([second], blocks):
            paths.append(f"{folder}/{len(paths)}")
            materialize(contamination(index, block, width).filter(F.size("hits") > 0), paths[-1])
        every = spark.read.schema(every.schema).parquet(*paths).groupBy("segment", "ordinal").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
    return every.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_sort("items").alias("items"), (F.size("hits") > 0).alias("contaminated"))


def sha256_of(items: Iterable[str]) -> str:
    """The digest of the contract: item ids sorted as strings, comma-joined."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of the contract: items as a digest."""
    return decontaminate(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )
