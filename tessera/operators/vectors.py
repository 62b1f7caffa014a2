"""A vector index of cells: partitions of a written table, of which a search reads a few.

``build_index`` fits cell centres on a bounded sample, writes every vector to
the partition of its nearest centre together with the columns that filters name,
and finds out on that sample how many cells a search must read to reach a given
recall.  ``search`` reads only the partitions that some question of a block
probes (Spark prunes them by name), filters rows before it scores them, and
scores a row against the questions that probe its cell and no others.  A question
that finds fewer than k rows, because a filter leaves few, goes on to more cells
until it has k or has seen every cell.

Scale: the centres (at most ``MOST_CELLS``) and a block of questions are all that
tasks are sent; every vector is read once to be placed, in one shuffle that
Spark balances by size, so a cell that holds a third of the vectors is several
files; a task hands on its best k of each question.

Edges: null, empty and zero vectors are neither indexed nor asked with; vectors
of another length than the first one's are an error; equal scores go by id; no
vectors and no questions give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tessera.operators.retrieval import ranked
from tessera.sources.store import shared_folder, stored

#: Vectors that centres are fitted on, and the most centres there are.
SAMPLE_ROWS, MOST_CELLS = 20_000, 4_096
#: Rounds of fitting, and questions of the sample by which the probes are found.
ROUNDS, TRIALS = 12, 400
#: Questions that a search sends to the tasks at once.
QUESTIONS = 2_000
_CELL = "index_cell"


@dataclass(frozen=True)
class CellIndex:
    """A written index: its folder, cell centres (one row each), and the cells to read for the recall it was built for."""

    folder: str
    centres: np.ndarray
    probes: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/rows")


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)


def fit_centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres on the sphere: each the mean direction of the sample rows nearest to it; a centre without rows takes the row that fits worst."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        likeness = sample @ centres.T
        nearest = likeness.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        empty = np.flatnonzero(np.bincount(nearest, minlength=cells) == 0)
        sums[empty] = sample[np.argsort(likeness.max(1))[: len(empty)]]
        centres = _unit(sums)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, recall: float, k: int) -> int:
    """The least number of cells with which rows of the sample find this share of their k nearest sample rows."""
    asked = sample[:: max(1, len(sample) // TRIALS)]
    home = (sample @ centres.T).argmax(1)
    near = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, : min(k, len(sample))]
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def build_index(corpus: DataFrame, id_col: str, vector_col: str, kept: list[str] | None = None, cells: int | None = None, recall: float = 0.97, k: int = 10, folder: str | None = None) -> CellIndex:
    """Index every row of ``corpus``: the id as chunk_id, the unit vector as v, and the columns ``kept`` for filters.

    ``cells`` defaults to the square root of the rows, ``MOST_CELLS`` at most.
    Centres and probes come from ``SAMPLE_ROWS`` rows at most, those of least
    hash of their id.
    """
    spark = corpus.sparkSession
    folder = folder or f"{shared_folder(spark)}/tessera-vectors-{np.random.default_rng().integers(2**62):x}"
    length = F.aggregate(F.col(vector_col), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    whole = corpus.filter(F.coalesce(length > 0, F.lit(False))).select(F.col(id_col).alias("chunk_id"), F.col(vector_col).cast("array<double>").alias("v"), *(kept or []))
    total = whole.count()
    drawn = [r["v"] for r in whole.select("v", F.xxhash64("chunk_id").alias("h"), "chunk_id").orderBy("h", "chunk_id").limit(SAMPLE_ROWS).collect()]
    sample = _unit(np.array(drawn)) if drawn else np.zeros((0, 1))
    cells = min(cells or round(total**0.5), MOST_CELLS, max(1, len(sample)))
    centres = fit_centres(sample, cells) if len(sample) else np.zeros((0, 1))
    schema = StructType([*whole.schema.fields, StructField(_CELL, IntegerType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column(1), centres.shape[1])
            cell = pa.array((rows @ centres.T).argmax(1).astype(np.int32))
            flat = pa.array(rows.ravel())
            v = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, rows.shape[1]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), v, *batch.columns[2:], cell], names=schema.names)

    placed = whole.mapInArrow(place, schema).hint("rebalance", _CELL)
    placed.write.partitionBy(_CELL).parquet(f"{folder}/rows")
    return CellIndex(folder, centres, min(probes_for(sample, centres, recall, k), cells) if len(sample) else 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False)
    if len(rows) != len(column) * width:
        raise ValueError(f"a vector of another length than {width}")
    return _unit(rows.reshape(len(column), width).astype(float))


class _Best:
    """The best k rows of each question so far."""

    def __init__(self, k: int) -> None:
        self._k, self._parts, self._held = k, [], 0

    def add(self, asked: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` has a row for each id and a column for each question; ties with the last kept one stay."""
        if len(ids) > self._k:
            least = -np.partition(-scores, self._k - 1, axis=0)[self._k - 1]
            row, column = np.nonzero(scores >= least)
        else:
            row, column = (x.ravel() for x in np.indices(scores.shape))
        self._parts.append((asked[column], scores[row, column], ids[row]))
        self._held += len(row)
        if self._held > 200_000:
            self._parts = [self.rows()]
            self._held = len(self._parts[0][0])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        asked, scores, ids = (np.concatenate(c) for c in zip(*self._parts, strict=True))
        order = np.lexsort((ids, -scores, asked))
        asked, scores, ids = asked[order], scores[order], ids[order]
        first = np.maximum.accumulate(np.where(np.append(True, asked[1:] != asked[:-1]), np.arange(len(asked)), 0))
        keep = np.arange(len(asked)) - first < self._k
        return asked[keep], scores[keep], ids[keep]


def _block_hits(index: CellIndex, rows: DataFrame, ids: list, asked: np.ndarray, skip: int, probes: int, k: int, types: StructType) -> DataFrame:
    """Hits of one block of questions in their cells number ``skip`` to ``probes``."""
    order = np.argsort(-(asked @ index.centres.T), axis=1, kind="stable")[:, skip:probes]
    probing = {int(c): np.flatnonzero((order == c).any(1)) for c in np.unique(order)}
    width = index.centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, found = _Best(k), False
        for batch in batches:
            if not batch.num_rows:
                continue
            held, cell = _matrix(batch.column(1), width), batch.column(2).to_numpy()
            chunk = np.array(batch.column(0).to_pylist())
            for c in np.unique(cell):
                mine, of = np.flatnonzero(cell == c), probing[int(c)]
                best.add(of, np.round(held[mine] @ asked[of].T, 6), chunk[mine])
                found = True
        if found:
            of, scores, chunk = best.rows()
            columns = [[ids[i] for i in of.tolist()], chunk.tolist(), scores.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, types.fields, strict=True)], names=types.names)

    return rows.filter(F.col(_CELL).isin(list(probing))).select("chunk_id", "v", _CELL).mapInArrow(run, types)


def search(index: CellIndex, queries: DataFrame, k: int = 5, metadata: Column | None = None, probes: int | None = None) -> DataFrame:
    """query_id, chunk_id, score and rank of about the nearest k rows that pass ``metadata``.

    ``queries`` has query_id and qv.  Blocks of questions are searched one after
    another and their hits are written; within a block, those that found fewer
    than k go on to four times as many cells.
    """
    spark = queries.sparkSession
    rows = index.rows(spark) if len(index.centres) else None
    chunk_type = rows.schema["chunk_id"].dataType if rows is not None else queries.schema["query_id"].dataType
    types = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("chunk_id", chunk_type), StructField("score", DoubleType())])
    parts: list[DataFrame] = []
    if rows is not None:
        rows = rows if metadata is None else rows.filter(metadata)
        block: list = []

        def ask(block: list) -> None:
            ids, asked = [r["query_id"] for r in block], _unit(np.array([r["qv"] for r in block], float))
            skip, most, left = 0, min(probes or index.probes, len(index.centres)), np.arange(len(ids))
            counts = np.zeros(len(ids), int)
            place = {q: i for i, q in enumerate(ids)}
            while len(left):
                hits = stored(_block_hits(index, rows, [ids[i] for i in left], asked[left], skip, most, k, types), "hits")
                parts.append(hits)
                if most == len(index.centres):
                    break
                for r in hits.groupBy("query_id").count().collect():  # one row a question of the block
                    counts[place[r["query_id"]]] += r["count"]
                left = left[counts[left] < k]
                skip, most = most, min(4 * most, len(index.centres))

        for r in queries.select("query_id", "qv").toLocalIterator():
            if r["qv"] and any(r["qv"]):
                block.append(r)
            if len(block) >= QUESTIONS:
                ask(block)
                block = []
        if block:
            ask(block)
    found = spark.createDataFrame([], types)
    for part in parts:
        found = found.unionAll(part)
    return ranked(found, [F.desc("score"), F.asc("chunk_id")]).filter(F.col("rank") <= k)
