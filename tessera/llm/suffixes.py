"""A distributed suffix array by a difference cover (skew) of period three.

A string is a table of (pos, c) with dense positions and names c >= 1.  The
triples at positions 1 and 2 modulo 3 are sorted and named in their order; where
names repeat, the string of names is half solved by the same step; the other
suffixes are merged by (c, rank of the next) and (c, next c, rank of the one
after).  Both merges are a sort of the whole string each, in which a suffix
counts those of the other kind before it, so nothing passes through one task.

A collection of texts that end in names of their own (``text_ranks``) is sorted
by its first ``TUPLE`` names before that, which are at hand in the task that
holds the text; suffixes that agree so far are sorted by the places of their
``TUPLE``-th rows, and so on ``LEVELS`` times.  What still agrees goes on to the
difference cover: as the string of these places, at the rows one comparison
looks at, each stretch closed by a suffix that stands alone.

A sort is a range partitioning with a running number in each task; what the
tasks before it hold comes from one row a partition.  Sorts end with the
position, so that a triple which a third of the string repeats is dealt to many
tasks.  Every level is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from .common import discard, materialize, release

#: Positions of a block in which neighbours are looked up, and rows of a sorted partition.
BLOCK, PART_ROWS = 16_384, 150_000
#: Names by which the suffixes of texts are sorted at once, and how often, before the difference cover takes the rest.
TUPLE, LEVELS = 16, 2


def numbered(df: DataFrame, order: Sequence[str | Column], path: str, rows: int, equal: Sequence[str] = (), flag: str | None = None, outer: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """``df`` in a global order, without ``drop``, with ``at`` (0, 1, ...), ``head``, ``outer`` and ``before``, all long, and ``lone``.

    ``head`` is the ``at`` of the first row that agrees in the columns
    ``equal``, and ``lone`` says that no other row agrees; ``outer`` is the
    ``at`` of the first that agrees in those columns; ``before`` counts the rows
    before whose column ``flag`` is 0.
    """
    parts = max(1, rows // PART_ROWS + 1)
    kept, heads = [f for f in df.schema.fields if f.name not in drop], {"head": list(equal), "outer": list(outer)}
    longs = ["at", "head", "outer", "before"]
    keys = [StructField(f"{h}_{c}", df.schema[c].dataType) for h, cs in heads.items() for c in cs]
    ends = StructType([StructField("part", IntegerType()), *(StructField(c, LongType()) for c in longs), StructField("lone", BooleanType())])
    stay = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, base, before, held = TaskContext.get().partitionId(), 0, 0, None
        last: dict[str, tuple] = {}

        def made(columns: list, starts: np.ndarray, after: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*columns, pa.array(starts & np.append(starts[1:], after))], names=[*stay, *ends.names])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = base + np.arange(n)
            found, zeros, starts = {"head": at, "outer": at}, np.zeros(n, np.int64), np.ones(n, bool)
            for name, columns in heads.items():
                if not columns:
                    continue
                values = [batch.column(c).to_numpy() for c in columns]
                new, known = np.zeros(n, bool), last.get(name)
                new[0] = known is None or any(v[0] != x for v, x in zip(values, known[1], strict=True))
                for v in values:
                    new[1:] |= v[1:] != v[:-1]
                found[name] = np.maximum.accumulate(np.where(new, at, known[0] if known else 0))
                last[name] = int(found[name][-1]), [v[-1] for v in values]
                if name == "head":
                    starts = new
            if flag:
                zero = batch.column(flag).to_numpy() == 0
                zeros = before + np.cumsum(zero) - zero
                before += int(zero.sum())
            base += n
            if held:  # whether its last row stands alone shows now
                yield made(*held, starts[0])
            held = [*(batch.column(c) for c in stay), pa.array(np.full(n, part), pa.int32()), *(pa.array(x, pa.int64()) for x in (at, found["head"], found["outer"], zeros))], starts
        if held:
            yield made(*held, True)

    table = materialize(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, StructType([*kept, *ends.fields])), path)
    last_zero = (F.col(flag) == 0).cast("long") if flag else F.lit(0).cast("long")
    key = F.struct(*(F.col(c).alias(k.name) for k, c in zip(keys, [*equal, *outer], strict=True)), F.lit(0).alias("none"))
    summary = table.groupBy("part").agg(F.count("*").alias("n"), F.max(F.struct("at", (F.col("before") + last_zero).alias("zeros"), "head", "outer", key.alias("key"))).alias("last"), F.min(F.struct("at", key.alias("key"))).alias("first"))
    offsets, at, zeros, known, reached = [], 0, 0, None, {}
    for r in summary.orderBy("part").collect():  # one row a partition
        goes_on = {h: bool(cs) and known is not None and all(known[f"{h}_{c}"] == r["first"]["key"][f"{h}_{c}"] for c in cs) for h, cs in heads.items()}
        carried = {h: reached[h] if goes_on[h] else None for h in heads}
        if goes_on["head"]:
            offsets[-1][-1] = True
        offsets.append([r["part"], at, zeros, carried["head"], carried["outer"], r["n"], False])
        reached = {h: carried[h] if goes_on[h] and r["last"][h] == 0 else at + r["last"][h] for h in heads}
        known, at, zeros = r["last"]["key"], at + r["n"], zeros + r["last"]["zeros"]
    bases = df.sparkSession.createDataFrame(offsets, "part int, base long, zeros long, to_head long, to_outer long, n_rows long, goes_on boolean")
    lone = F.col("lone") & ~((F.col("head") == 0) & F.col("to_head").isNotNull()) & ~((F.col("at") == F.col("n_rows") - 1) & F.col("goes_on"))
    own = [F.when((F.col(h) == 0) & F.col(f"to_{h}").isNotNull(), F.col(f"to_{h}")).otherwise(F.col("base") + F.col(h)).alias(h) for h in heads]
    return table.join(F.broadcast(bases), "part").select(*stay, (F.col("base") + F.col("at")).alias("at"), *own, (F.col("zeros") + F.col("before")).alias("before"), lone.alias("lone"))


def following(df: DataFrame, wanted: dict[str, Column], pos: str = "pos", reach: int = 2, back: int = 0) -> DataFrame:
    """``df`` with columns of rows at the next (or earlier) positions.

    ``wanted`` builds columns by F.lead and F.lag over a window that is put in
    here, at most ``reach`` rows on and ``back`` rows before; blocks of
    positions get the edges of their neighbours.
    """
    p, at = F.col(pos), F.col(pos) % BLOCK
    block = F.floor(p / BLOCK).cast("long")
    blocks = F.array(block)
    if reach:
        blocks = F.concat(blocks, F.when((at < reach) & (block > 0), F.array(block - 1)).otherwise(F.array().cast("array<bigint>")))
    if back:
        blocks = F.concat(blocks, F.when(at >= BLOCK - back, F.array(block + 1)).otherwise(F.array().cast("array<bigint>")))
    window = Window.partitionBy("of_block").orderBy(pos)
    spread = df.withColumn("of_block", F.explode(blocks))
    return spread.select("*", *(c.over(window).alias(name) for name, c in wanted.items())).filter(F.col("of_block") == block).drop("of_block")


def suffix_ranks(string: DataFrame, n: int, folder: str) -> DataFrame:
    """pos and rank (1 to n) of every suffix of ``string`` (pos, c); a suffix that ends sorts first.

    No positions give no rows.
    """
    levels, current, size = [], string, n
    while True:
        at = f"{folder}/{len(levels)}"
        dummy = size % 3 == 1
        triples = following(current, {"c1": F.lead("c", 1, 0), "c2": F.lead("c", 2, 0)}).filter("pos % 3 != 0")
        if dummy:
            triples = triples.unionAll(string.sparkSession.range(1).select(F.lit(size).cast("long").alias("pos"), *(F.lit(0).cast("long").alias(c) for c in ("c", "c1", "c2"))))
        n0, n2 = (size + 2) // 3, size // 3
        m = (n0 if dummy else (size + 1) // 3) + n2
        if not m:
            ranks = current.select("pos", F.lit(1).cast("long").alias("rank"))
            break
        named = numbered(triples, ["c", "c1", "c2", "pos"], f"{at}/triples", m, equal=["c", "c1", "c2"])
        levels.append((current, size, dummy, at))
        if named.filter(F.col("head") != F.col("at")).isEmpty():
            ranks = named.select("pos", (F.col("head") + 1).alias("rank"))
            levels[-1] += (ranks,)
            break
        short = F.when(F.col("pos") % 3 == 1, F.expr("pos div 3")).otherwise(F.expr(f"{n0} + pos div 3"))
        current, size = materialize(named.select(short.alias("pos"), (F.col("head") + 1).alias("c")), f"{at}/names"), m
        discard(string.sparkSession, f"{at}/triples")
        release(string.sparkSession)
    below = None
    for current, size, dummy, at, *solved in reversed(levels):
        if not solved:
            n0 = (size + 2) // 3
            ranks = ranks.select(F.when(F.col("pos") < n0, 3 * F.col("pos") + 1).otherwise(3 * (F.col("pos") - n0) + 2).alias("pos"), "rank")
        ranks = _merged(current, ranks, size, dummy, at)
        if below:  # what it held has been read
            discard(string.sparkSession, below)
        release(string.sparkSession)
        below = at
    return ranks


def _whole_runs(df: DataFrame, columns: Sequence[str], schema: str, f: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]) -> DataFrame:
    """``f`` of the columns of ``df`` by text and position; it gets whole stretches that end with a ``stop``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict[str, np.ndarray]] = []
        for batch in batches:
            now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
            stops = np.flatnonzero(now["stop"])
            cut = stops[-1] + 1 if len(stops) else 0
            if cut:
                waiting.append({c: v[:cut] for c, v in now.items()})
                made = f({c: np.concatenate([w[c] for w in waiting]) for c in columns})
                waiting = []
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in made.values()], names=list(made))
            if cut < batch.num_rows:
                waiting.append({c: v[cut:] for c, v in now.items()})

    return df.select(*columns).repartition("uid").sortWithinPartitions("uid", "pos").mapInArrow(run, schema)


def text_ranks(string: DataFrame, n: int, names: int, folder: str) -> DataFrame:
    """uid, pos and rank (1 to n) of every suffix of the texts ``string`` (uid, pos, c, stop).

    Names c lie in 1 to ``names``.  A row with ``stop`` has a name that occurs
    once in all texts, and the last row of each text is one: no comparison of
    two suffixes goes beyond it, and two that agree in k names have k more rows
    before the next stop.
    """
    spark, per = string.sparkSession, 2 if max(n, names) < 2**31 else 1
    keys = [f"k{i}" for i in range(TUPLE // per)]

    def tuples(stride: int, run: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Of suffixes that share their place: the places at each ``stride``-th row, up to one that stands alone."""
        c, lone, at = run["c"], run["lone"], np.flatnonzero(~run["lone"]) if stride > 1 else np.arange(len(run["c"]))
        made, inside, places = [], np.ones(len(at), bool), at
        for k in range(TUPLE):
            name = np.where(inside, c[places], 0)
            inside &= ~lone[places]
            places = np.where(inside, places + stride, 0)
            if k % per:
                made[-1] = (made[-1] << 32) | name
            else:
                made.append(name)
        return {x: run[x][at] for x in ("uid", "pos", "stop", "c")} | dict(zip(keys, made, strict=True))

    current, solved, size, stride = string.withColumn("lone", F.col("stop")), None, n, 1
    for level in range(LEVELS):
        made = _whole_runs(current, ["uid", "pos", "c", "stop", "lone"], f"uid long, pos long, stop boolean, c long, {', '.join(f'{k} long' for k in keys)}", partial(tuples, stride))
        made = made.withColumn("c", F.lit(1).cast("long")) if not level else made
        first = numbered(made, ["c", *keys, "uid", "pos"], f"{folder}/{level}", size, equal=["c", *keys], outer=["c"])
        first = first.select("uid", "pos", (F.col("c") + F.col("head") - F.col("outer")).alias("c"), "stop", "lone")
        settled = first.filter("lone")
        solved = solved.unionAll(settled) if solved else settled
        size, stride = first.filter("NOT lone").count(), stride * TUPLE
        if not size:
            return solved.select("uid", "pos", F.col("c").alias("rank"))
        current = solved.unionAll(first.filter("NOT lone"))
        release(spark)

    def stretches(run: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Each ``stride``-th row of those that share their place, with the next one that does not."""
        shared = ~run["lone"]
        taken = shared.copy()
        taken[stride:] |= shared[:-stride]
        places = np.flatnonzero(taken)
        places = places[np.argsort(places % stride, kind="stable")]
        return {x: run[x][places] for x in ("uid", "pos", "c")} | {"shared": shared[places]}

    rest = _whole_runs(current, ["uid", "pos", "c", "stop", "lone"], "uid long, pos long, c long, shared boolean", stretches)
    bases, total = [], 0
    rest = materialize(rest.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(2**33 - 1).alias("idx"), "*"), f"{folder}/rest")
    for r in rest.groupBy("part").agg(F.max("idx").alias("last")).orderBy("part").collect():  # one row a partition
        bases.append((r["part"], total))
        total += r["last"] + 1
    rest = rest.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part").withColumn("of", F.col("base") + F.col("idx"))
    order = suffix_ranks(rest.select(F.col("of").alias("pos"), "c"), total, f"{folder}/cover").withColumnsRenamed({"pos": "of", "rank": "place"})
    placed = materialize(rest.filter("shared").select("of", "uid", "pos", "c").join(order, "of").select("uid", "pos", "c", "place"), f"{folder}/placed")
    least = placed.groupBy("c").agg(F.min("place").alias("least"))
    placed = placed.join(least, "c").select("uid", "pos", (F.col("c") + F.col("place") - F.col("least")).alias("rank"))
    return solved.select("uid", "pos", F.col("c").alias("rank")).unionAll(placed)


def _merged(string: DataFrame, sample: DataFrame, n: int, dummy: bool, at: str) -> DataFrame:
    """Ranks of all suffixes from those at positions 1 and 2 modulo 3."""
    both = string.join(sample.withColumnRenamed("pos", "at_pos"), F.col("pos") == F.col("at_pos"), "left").select("pos", "c", "rank")
    known = following(both, {"c1": F.lead("c", 1, 0), "r1": F.lead("rank", 1, 0), "r2": F.lead("rank", 2, 0)})
    known = known.withColumn("kind", (F.col("pos") % 3).cast("int"))
    known = materialize(known, f"{at}/known")
    one = numbered(known.filter("kind != 2").select("pos", "c", "r1", "rank", "kind"), ["c", "r1"], f"{at}/one", 2 * n // 3 + 1, flag="kind")
    two = numbered(known.filter("kind != 1").select("pos", "c", "c1", "r2", "rank", "kind"), ["c", "c1", "r2"], f"{at}/two", 2 * n // 3 + 1, flag="kind")
    own = F.col("rank") - int(dummy) + F.col("before")
    first = one.select("pos", F.when(F.col("kind") == 0, F.col("at") + 1).otherwise(own).alias("rank"))
    second = two.select("pos", F.when(F.col("kind") == 0, F.col("at") - F.col("before")).otherwise(own).alias("rank"))
    return first.unionAll(second).groupBy("pos").agg(F.sum("rank").alias("rank"))
