"""Executed bin-packed compaction of a folder of sorted files (op 12).

``write_sorted_files`` writes one file for each value of a key, ``plan_groups``
packs the small files of each scope first-fit, ``compact`` carries the plan out
in place, and ``file_digests`` reads the files that are there afterwards.

First fit keeps its open groups in a Fenwick tree over compressed residuals: a
residual is known by the number of distinct file sizes that it can take, each
place of the tree covers a range of these numbers and holds the groups in it as
a heap, and a group that has moved on leaves its old entry behind until that
comes to the top.  The earliest group with room is the least top along a suffix.

Scale: rows move by Spark alone (hash by file, sort within a task, one file a
task at a time, streaming).  A plan has one row a file; the contract's sizes
follow the table, so there are at most 600 files and four a day more, however
many rows; the driver renames and removes files and sees no row.  A task that
runs twice is harmless: Spark's committer publishes one attempt, and sources go
only after every merged file is in its place.

Edges: rows without arrived_at form a day of their own (null, file name
``null``), a null key hashes as empty text and sorts first, a null or broken
value counts 0, rows that are equal stay as often as they occur, an empty table
gives no files and no rows, and columns of the table keep their names whatever
they are called.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import materialize, scratch

#: Rows of a lot, of a file too large to merge and of a merged file, as parts of the table.
LOT, SMALL, FULL = 150, 600, 400


class FirstFit:
    """Open groups with a capacity; ``place`` names the earliest that has room."""

    def __init__(self, sizes: Sequence[int], capacity: int) -> None:
        self._steps = sorted({s for s in sizes if s <= capacity})
        self._heaps: list[list[int]] = [[] for _ in range(len(self._steps) + 1)]
        self._room: list[int] = []
        self._capacity = capacity

    def _put(self, group: int) -> None:
        """Enter a group wherever a suffix that has its residual is covered."""
        at = bisect.bisect_right(self._steps, self._room[group])
        while at:
            heapq.heappush(self._heaps[at], group)
            at -= at & -at

    def _top(self, place: int) -> int | None:
        """The earliest group of a place, stale entries dropped: those that now fit less than the place begins with."""
        heap = self._heaps[place]
        while heap and self._room[heap[0]] < self._steps[place - 1]:
            heapq.heappop(heap)
        return heap[0] if heap else None

    def place(self, size: int) -> int:
        """The group that takes ``size`` rows: the earliest with room, else a new one."""
        at, best = bisect.bisect_left(self._steps, size) + 1, None
        while at <= len(self._steps):
            found = self._top(at)
            best = found if best is None or (found is not None and found < best) else best
            at += at & -at
        if best is None:
            best = len(self._room)
            self._room.append(self._capacity)
        self._room[best] -= size
        self._put(best)
        return best


def plan_groups(files: DataFrame, scope: str, small: int, full: int, order: Sequence[str]) -> DataFrame:
    """files (scope, name, n_rows, the order columns) with ``head`` (the first file of its group) and ``seq`` in it.

    Within each scope, files under ``small`` rows, by descending rows and then
    ``order``, join first-fit; every other file is a group by itself.
    """
    names = [scope, "name", "n_rows", *order]

    def pack(part):
        part = part.sort_values(["n_rows", *order], ascending=[False] + [True] * len(order), kind="stable")
        sizes = [n for n in part["n_rows"] if n < small]
        fit, heads, counts, out = FirstFit(sizes, full), {}, {}, []
        for name, n in zip(part["name"], part["n_rows"], strict=True):
            group = fit.place(int(n)) if n < small else name
            head, seq = heads.setdefault(group, name), counts.get(group, 0)
            counts[group] = seq + 1
            out.append((head, seq))
        part["head"], part["seq"] = [h for h, _ in out], [s for _, s in out]
        return part[[*names, "head", "seq"]]

    schema = StructType([files.schema[c] for c in names] + [StructField("head", StringType()), StructField("seq", LongType())])
    return files.select(*names).groupBy(scope).applyInPandas(pack, schema)


def _files(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _publish(spark: SparkSession, staging: str, folder: str, key: str) -> None:
    """Move each file of a partitioned write to ``folder``, named by its key."""
    fs, path = _files(spark, folder)
    fs.mkdirs(path(folder))
    if not fs.exists(path(staging)):
        return
    for part in fs.listStatus(path(staging)):
        if not part.isDirectory():
            continue
        name = part.getPath().getName().removeprefix(f"{key}=")
        found = [f.getPath() for f in fs.listStatus(part.getPath()) if f.getPath().getName().endswith(".parquet")]
        if len(found) != 1:
            raise RuntimeError(f"{len(found)} files for {name}; one is expected")
        if not fs.rename(found[0], path(f"{folder}/{name}.parquet")):
            raise RuntimeError(f"{name}.parquet could not be moved to {folder}")


def _fresh(columns: Sequence[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as make it new."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def _tasks(spark: SparkSession) -> int:
    """Tasks to write with: small files cost time each, so they are not put together by size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_sorted_files(rows: DataFrame, key: str, order: Sequence[str], folder: str) -> None:
    """One file ``<key>.parquet`` for each value of the column ``key``, with all other columns of ``rows``, sorted by ``order``."""
    spark, staging = rows.sparkSession, f"{folder}/_staging"
    dealt = rows.repartition(_tasks(spark), key).sortWithinPartitions(key, *(F.col(f"`{c}`").asc_nulls_first() for c in order))
    dealt.write.partitionBy(key).option("maxRecordsPerFile", 0).option("compression", "zstd").parquet(staging)
    _publish(spark, staging, folder, key)
    fs, path = _files(spark, folder)
    fs.delete(path(staging), True)


def _read(spark: SparkSession, folder: str, schema: StructType) -> tuple[DataFrame, str, str]:
    """The rows of all files with their file's name (without ending) and their number in it."""
    name, at = _fresh(schema.names, "file_name", "file_row")
    rows = spark.read.schema(schema).parquet(folder)
    meta = rows.metadataColumn("_metadata")
    return rows.select(*(F.col(f"`{c}`") for c in rows.columns), F.regexp_replace(meta["file_name"], r"\.parquet$", "").alias(name), meta["row_index"].alias(at)), name, at


def compact(folder: str, plan: DataFrame, schema: StructType) -> None:
    """Carry out a plan: one file ``merged-<head>`` replaces each group of several, the rest stays as it is."""
    spark = plan.sparkSession
    several = plan.join(plan.filter("seq = 1").select("head"), "head", "left_semi")
    members = [r["name"] for r in several.select("name").toLocalIterator()]
    if not members:
        return
    rows, name, at = _read(spark, folder, schema)
    head, seq = _fresh(rows.columns, "merged_key", "merged_seq")
    steps = several.select(F.col("name").alias(name), F.concat(F.lit("merged-"), "head").alias(head), F.col("seq").alias(seq))
    staging = f"{folder}/_staging"
    merged = rows.join(steps, name).repartition(_tasks(spark), head).sortWithinPartitions(head, seq, at)
    merged.select(*(F.col(f"`{c}`") for c in schema.names), head).write.partitionBy(head).option("maxRecordsPerFile", 0).option("compression", "zstd").parquet(staging)
    _publish(spark, staging, folder, head)
    fs, path = _files(spark, folder)
    for m in members:
        fs.delete(path(f"{folder}/{m}.parquet"), False)
    fs.delete(path(staging), True)


def file_digests(spark: SparkSession, folder: str, schema: StructType, id_col: str, value_col: str) -> DataFrame:
    """name, n_rows, min and max id, cents and the digest of the ids of every file, read in file order."""
    rows, name, at = _read(spark, folder, schema)
    cents = F.coalesce(F.floor(F.col(f"`{value_col}`") * 100 + F.lit(0.5)), F.lit(0)).cast("long")
    slim = rows.select(F.col(name).alias("name"), F.col(at).alias("at"), F.col(f"`{id_col}`").cast("long").alias("id"), cents.alias("cents"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_name, digest, state = None, None, None

        def row() -> pa.RecordBatch:
            values = [open_name, state[0], state[1], state[2], state[3], digest.hexdigest()]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["name", "n_rows", "min_id", "max_id", "cents", "ids_sha256"])

        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            ids, worth = batch.column(2).to_pylist(), batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)] if len(names) else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if names[a] != open_name:
                    if open_name is not None:
                        yield row()
                    open_name, digest, state = names[a], hashlib.sha256(), [0, None, None, 0]
                known = [i for i in ids[a:b] if i is not None]
                text = ",".join("" if i is None else str(i) for i in ids[a:b])
                digest.update((("," if state[0] else "") + text).encode())
                state[0] += b - a
                if known:
                    state[1] = min(known) if state[1] is None else min(state[1], *known)
                    state[2] = max(known) if state[2] is None else max(state[2], *known)
                state[3] += int(worth[a:b].sum())
        if open_name is not None:
            yield row()

    ordered = slim.repartition("name").sortWithinPartitions("name", "at")
    return ordered.mapInArrow(run, "name string, n_rows long, min_id long, max_id long, cents long, ids_sha256 string")


def compacted_clicks(clicks: DataFrame) -> DataFrame:
    """The rows of the contract: starting files by day, lot and piece, compacted, one row a final file."""
    spark, columns = clicks.sparkSession, clicks.columns
    folder = scratch(spark, "compaction")
    files = f"{folder}/clicks"
    day, other, n_day, h, key = _fresh(columns, "c_day", "c_other_day", "c_rows", "c_hash", "c_key")
    keyed = clicks.withColumns({
        day: F.unix_date(F.to_date("arrived_at")).cast("long"),
        h: F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit("")).cast("binary")),
    })
    days = materialize(keyed.groupBy(F.col(day).alias(other)).agg(F.count("*").alias(n_day)), f"{folder}/days")
    total = days.agg(F.coalesce(F.sum(n_day), F.lit(0))).first()[0]
    lot_rows, small, full = (1 + total // x for x in (LOT, SMALL, FULL))
    keyed = keyed.join(days, F.col(day).eqNullSafe(F.col(other)))
    lot = F.expr(f"(`{h}` div 16) % (1 + `{n_day}` div {lot_rows})")
    piece = F.least(F.expr(f"`{h}` % 4"), F.expr(f"(`{h}` div 4) % 4"))
    keyed = keyed.withColumn(key, F.concat_ws("_", F.coalesce(F.col(day).cast("string"), F.lit("null")), lot, piece))
    write_sorted_files(keyed.select(*(F.col(f"`{c}`") for c in columns), key), key, ["arrived_at", "click_id"], files)
    part = F.split("name", "_")
    started = keyed.groupBy(F.col(key).alias("name")).agg(F.count("*").alias("n_rows"))
    started = started.select("name", "n_rows", F.expr("try_cast(split(name, '_')[0] AS long)").alias("day"), part[1].cast("long").alias("lot"), part[2].cast("long").alias("piece"))
    plan = materialize(plan_groups(started, "day", small, full, ["lot", "piece"]), f"{folder}/plan")
    compact(files, plan, clicks.schema)
    steps = F.sort_array(F.collect_list(F.struct("seq", F.concat_ws("-", "lot", "piece").alias("source"))))
    groups = plan.groupBy("head").agg(F.array_join(steps["source"], ",").alias("sources"), *(F.min_by(c, "seq").alias(c) for c in ("day", "lot", "piece")), (F.count("*") > 1).alias("rewritten"))
    groups = groups.withColumn("name", F.when(F.col("rewritten"), F.concat(F.lit("merged-"), "head")).otherwise(F.col("head")))
    found = file_digests(spark, files, clicks.schema, "click_id", "value")
    return found.join(groups, "name").select(
        "day", "lot", "piece", "n_rows", F.col("min_id").alias("min_click_id"), F.col("max_id").alias("max_click_id"), "cents", "sources", "ids_sha256",
        F.lit(",".join(columns)).alias("columns"), F.concat(F.lit(f"{files}/"), "name", F.lit(".parquet")).alias("path"), "rewritten",
    )
