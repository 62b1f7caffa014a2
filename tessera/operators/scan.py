"""The older scan (R12): every chunk of a stage scored by X17 for every question, without a row for a pair.

X17 falls into what a chunk has by itself and by the question's intent, a plan
of one row a chunk, and what the question's words find in its fields.  The words
of a block of questions form one automaton, and a task adds up both parts for all
of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.functions import text as X
from tessera.functions.patterns import Patterns
from tessera.operators import retrieval as R
from tessera.operators import understand as U

#: Bits of the fields in which a word is found; the last is what F5 searches.
BITS = {f: 1 << i for i, f in enumerate([*U.FIELD_POINTS, "said"])}
#: Points of a term by the fields that hold it.
TERM_POINTS = np.array([sum((p for f, p in U.FIELD_POINTS.items() if m & BITS[f]), 0.0) for m in range(2 * BITS["said"])])


def _bits(names: tuple[str, ...]) -> int:
    return sum(BITS[f] for f in names)


class Owners:
    """Who asks with each word: questions, or groups of words; one that has a word twice is named twice."""

    def __init__(self, words: list[tuple[str, int]], index: dict[str, int]) -> None:
        at = sorted((index.setdefault(w, len(index)), owner) for w, owner in words)
        self.word, self.owner = np.array([a for a, _ in at], np.int64), np.array([o for _, o in at], np.int64)

    def spread(self, word: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        """The owners of found words, and the values of these words once for each owner."""
        start = np.searchsorted(self.word, word)
        n = np.searchsorted(self.word, word, side="right") - start
        where = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return [self.owner[where], *(np.repeat(v, n) for v in values)]


class Relevance:
    """X17 and F5 of the questions of a block for some chunks at a time."""

    def __init__(self, asked: list, asking: list[tuple[str, bool]]) -> None:
        """``asked`` has the fields of ``U.asked_values`` of each question, ``asking`` what ``U.scanned_values`` was made for."""
        self.n, index = len(asked), {}
        self._terms = Owners([(t, q) for q, a in enumerate(asked) for t in a["terms"]], index)
        self._pictures = Owners([(a["pic"], q) for q, a in enumerate(asked) if a["pic"]], index)
        groups = [(q, g) for q, a in enumerate(asked) for g in a["groups"]]
        self._groups, self._of = Owners([(w, i) for i, (_, g) in enumerate(groups) for w in set(g)], index), np.array([q for q, _ in groups], np.int64)
        self._index, self._patterns = index, Patterns(index)
        self._asking = np.array([asking.index((a["intent"], a["safe"])) for a in asked], np.int64)
        self._all_terms = np.array([0 < a["n_terms"] == len(a["terms"]) for a in asked], bool)

    def _found(self, fields: dict[str, list[str]], rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, word and bits of fields of each word that a row has."""
        at: list[dict[int, int]] = [{} for _ in range(rows)]
        for f, bit in BITS.items():
            for held, text in zip(at, fields[f], strict=True):
                for w in self._patterns.within(text):
                    held[self._index[w]] = held.get(self._index[w], 0) | bit
        n = np.array([len(held) for held in at], np.int64)
        words, bits = chain.from_iterable(at), chain.from_iterable(held.values() for held in at)
        return np.repeat(np.arange(rows), n), np.fromiter(words, np.int64, int(n.sum())), np.fromiter(bits, np.int64, int(n.sum()))

    def scores(self, fields: dict[str, list[str]], points: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """X17 by chunk and question; minus infinity where a chunk is no row: F5 drops it, or it has no term and no points above 0 without one."""
        rows = len(points)
        row, word, bits = self._found(fields, rows)

        def sums(owner: np.ndarray, row: np.ndarray, value: np.ndarray) -> np.ndarray:
            return np.bincount(row * self.n + owner, value, rows * self.n).reshape(rows, self.n)

        q, at, b = self._terms.spread(word, row, bits)
        score = points[:, self._asking] + sums(q, at, TERM_POINTS[b])
        unmet = self._all_terms & (sums(q, at, (TERM_POINTS[b] > 0).astype(float)) == 0)
        score += np.where(unmet, U.UNMET_POINTS, 0.0)
        allowed = kept[:, self._asking]
        allowed = (allowed == 2) | ((allowed == 1) & (sums(q, at, (b & BITS["said"] > 0).astype(float)) > 0))
        q, at, b = self._pictures.spread(word, row, bits)
        for names, value in U.PICTURE_POINTS.items():
            score += sums(q, at, np.where(b & _bits(names) > 0, value, 0.0))
        if len(self._of):
            heading, body, neither = U.GROUP_POINTS
            best = np.full((rows, len(self._of)), U.GROUP_POINTS[neither])
            g, at, b = self._groups.spread(word, row, bits)
            np.maximum.at(best, (at, g), np.where(b & _bits(heading) > 0, U.GROUP_POINTS[heading], np.where(b & _bits(body) > 0, U.GROUP_POINTS[body], U.GROUP_POINTS[neither])))
            for i, owner in enumerate(self._of):
                score[:, owner] += best[:, i]
        return np.where(allowed & (~unmet | (score > 0)), np.round(score, 6), -np.inf)


def relevant_hits(chunks: DataFrame, asked: DataFrame, prefer_support: bool, k: int) -> DataFrame:
    """R12's scan: query_id, chunk_id, score and rank of each question's best k chunks by X17, filtered by F5 before they are taken.

    ``chunks`` has chunk_id (unique), tier, text and every field of a chunk that
    X17 reads; ``asked`` query_id, text, terms and intent.  All chunks are scored.
    One with none of a question's terms is a row if intent, picture id or groups
    bring it above 0, and a blank question has no rows.  A task hands on its best
    k of each question.
    """
    words = asked.filter(X.strip(F.coalesce("text", F.lit(""))) != "").select("query_id", U.asked_values(F.col("text"), F.col("terms"), F.col("intent")).alias("asked")).select("query_id", "asked.*").distinct()
    types = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField("chunk_id", chunks.schema["chunk_id"].dataType), StructField("score", DoubleType())])

    def block_hits(block: list) -> DataFrame:
        ids, questions = [r["query_id"] for r in block], [r.asDict() for r in block]
        asking = sorted({(q["intent"], q["safe"]) for q in questions}) or [("general", False)]
        fields = (F.col(c) for c in ("title", "section", "index_text", "text", "kind", "tier"))
        read = U.scanned_values(asking, *fields, F.lit(prefer_support), F.col("pic_ids"), F.col("flags"), F.col("note"))
        size = max(1, min(R.SCORE_ROWS, R.SCORE_PAIRS // max(1, len(ids))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, best = Relevance(questions, asking), R.Best(len(ids), k, -np.inf)
            for batch in (b.slice(i, size) for b in batches for i in range(0, b.num_rows, size) if ids):
                chunk_ids = batch.column(0).to_pylist()
                order = sorted(range(len(chunk_ids)), key=lambda i: (chunk_ids[i] is not None, chunk_ids[i]))
                rows = batch.take(pa.array(order))
                values = dict(zip([f.name for f in rows.schema.field(1).type], rows.column(1).flatten(), strict=True))
                points, kept = (np.array(values.pop(name).to_pylist(), float) for name in ("points", "kept"))
                best.add([chunk_ids[i] for i in order], held.scores({f: v.to_pylist() for f, v in values.items()}, points, kept))
            yield from R.arrow_rows([(ids[q], c, v) for q, mine in enumerate(best.held) for v, c in mine], types)

        return chunks.select("chunk_id", read.alias("read")).mapInArrow(run, types)

    return R.ranked(R.blockwise(words, block_hits), [F.desc("score"), F.asc("chunk_id")]).filter(F.col("rank") <= k)
