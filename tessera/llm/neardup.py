"""Near-duplicate detection by one-permutation MinHash (operator 10).

A document's set holds the 64-bit hashes of its distinct word shingles.  One
hash value serves both as the element and as its place in the permutation: the
value range is cut into ``bins`` equal parts, a bin's minimum is the first
element of the sorted set in that part, and empty bins borrow from a non-empty
bin that a 2-universal sequence of their own chooses (optimal densification).

Plan
----
1. One Arrow pass makes a sketch per document; sketches are written once.
2. Equal sets are one class; only a class representative goes on, with the
   least doc_id of its class as its node.
3. Every bucket of (band, key) proposes a star: edges from its least node to
   the others.  The count of edges is at most the count of bucket entries.
4. Full sets are computed again for documents on an edge and every edge is
   confirmed on them; components come from large-star / small-star rounds.
5. A bucket whose members, but for its hub, lie in one component is done.  The
   members of the others go on as differences from a middle: the elements that
   more than half of the texts around one component hold.  For differences P
   and Q of sets A and B the symmetric difference of A and B has
   |P| + |Q| - 2 |P and Q| elements, so a link asks for so many common elements
   of P and Q that, where any are needed, both must have m of them among the first
   of their elements, rarest first (prefix filter).  Keys are combinations of m
   elements: m grows with the number needed while a member's combinations stay
   few, so members of a template that share a few of its common values form no
   pair; m is what costs a member least in combinations and expected pairs.  Elements that the same
   members have count as one of their joint weight.  Elements that one difference
   alone has are in no intersection and stand in no list; pairs whose sizes
   exclude the overlap they need are not formed; the others are confirmed on
   full sets.  Where no common element is needed, the member nearest to the
   middle is linked with all such members, and one more star finds them.  So
   every link among documents that share a bucket is found, or implied, and
   the pairs formed follow the lists of rare differences and of combinations, not
   the square of a bucket.

With ``rows`` = 6 and ``bands`` = 50, two documents of similarity 0.8 share no
bucket with probability (1 - 0.8**6)**50 = 2.6e-7.

Defined results: a null or empty text has an empty set, ``n_shingles`` 0, its
own doc_id as component and ``kept`` true; a row whose doc_id is null is linked
with nothing, has a null component and is kept; repeated rows get equal results.
Rows that share a doc_id count as one document: if their texts differ, it is
linked with whatever any of its texts is linked with.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, scratch
from .components import connected_components

#: Shingles of 2 words and similarity 0.8, by the contract of the query.
SHINGLE, THRESHOLD_PERCENT = 2, 80
#: 50 bands of 6 of the 300 bins.
ROWS, BANDS = 6, 50
#: Members of one list of a difference element that a key of the join holds; longer lists are dealt to more keys.
LIST_PART = 4_000
#: Combinations that a member of a group stands under at most where it could stand under single elements, their greatest length, and what a pair costs in combinations.
COMBINATIONS, LONGEST, PAIR = 128, 8, 4
#: Words whose hashes a task keeps at once.
WORD_CACHE = 400_000

_MIX1, _MIX2, _MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_EMPTY = np.zeros(0, np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, computed once each while the cache has room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    x = (x ^ (x >> np.uint64(27))) * _MIX3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text.

    ``bytes.lower`` touches A-Z only and ``bytes.split`` cuts at 0x20 and
    0x09-0x0D only.  A text of fewer than ``k`` words, but not none, has its
    whole sequence as its one shingle.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return _EMPTY
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(k, len(h))
    with np.errstate(over="ignore"):
        mixed = np.full(len(h) - width + 1, width, np.uint64)
        for i in range(width):
            mixed = _mixed(mixed * _MIX1 + h[i : len(h) - width + 1 + i])
    return np.unique(mixed)


@lru_cache(maxsize=4)
def _detours(bins: int) -> np.ndarray:
    """For each bin the bins that it asks in turn while it is empty."""
    i, j = np.meshgrid(np.arange(bins, dtype=np.uint64), np.arange(1, 16 * bins + 1, dtype=np.uint64), indexing="ij")
    with np.errstate(over="ignore"):
        return (_mixed(i * _MIX1 + j * _MIX2) % np.uint64(bins)).astype(np.int32)


def one_permutation(values: np.ndarray, bins: int) -> np.ndarray:
    """The densified one-permutation sketch of a sorted non-empty set."""
    at = ((values >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    sketch, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    sketch[at[first]], full[at[first]] = values[first], True
    empty = np.flatnonzero(~full)
    detours = _detours(bins)
    for step in range(0, detours.shape[1], 32):
        if not len(empty):
            break
        asked = detours[empty, step : step + 32]
        hit = full[asked]
        found = hit.any(axis=1)
        rows = np.flatnonzero(found)
        sketch[empty[rows]] = sketch[asked[rows, hit[rows].argmax(axis=1)]]
        empty = empty[~found]
    if len(empty):  # a set of very few elements: the next full bin
        there = np.flatnonzero(full)
        sketch[empty] = sketch[there[np.searchsorted(there, empty) % len(there)]]
    return sketch


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key a band; the number of the band is part of it."""
    cut = sketch.reshape(-1, rows)
    with np.errstate(over="ignore"):
        key = _mixed(np.arange(1, len(cut) + 1, dtype=np.uint64) * _MIX1)
        for i in range(rows):
            key = _mixed((key ^ cut[:, i]) * _MIX1)
    return key


def _list_column(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else _EMPTY
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.uint64).view(np.int64)))


def sketches(docs: DataFrame, k: int = SHINGLE, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, fp (128-bit digest of the set, null if empty), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch.column(1).to_pylist():
                values = shingle_set(text, hashes, k)
                sizes.append(len(values))
                digests.append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
                keys.append(band_keys(one_permutation(values, rows * bands), rows) if len(values) else _EMPTY)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _list_column(keys)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "fp", "bands"])

    return documents(docs).mapInArrow(run, "doc_id long, n_shingles long, fp binary, bands array<long>")


def full_sets(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, the digest of its set and its whole sorted set; docs has the columns doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(text, hashes, k) for text in batch.column(1).to_pylist()]
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), digests, _list_column(sets)], names=["doc_id", "fp", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp binary, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity asked for."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - both
    return pairs.select("a", "b").join(right, "b").join(left, "a").filter(100 * both >= percent * union).select("a", "b").distinct()


def differences(members: DataFrame, percent: int, folder: str) -> DataFrame:
    """Each member as its difference from the middle of its group.

    ``members`` has grp, node, fp, component and shingles.  The result has for
    each of them the sizes that the bounds use and ``common``, the elements of
    the difference that another member has too, rarest first; of elements that
    the same members have, the least stands for all with their number.
    """
    sizes = members.groupBy("grp").agg(F.count("*").alias("m"))
    held = members.join(sizes, "grp").select("grp", "m", F.explode("shingles").alias("e")).groupBy("grp", "m", "e").agg(F.count("*").alias("c"))
    middles = held.filter("2 * c > m").groupBy("grp").agg(F.collect_list("e").alias("middle"))
    middles = materialize(middles, f"{folder}/middles")
    empty = F.expr("cast(array() AS array<bigint>)")
    middle = F.coalesce("middle", empty)
    apart = members.join(middles, "grp", "left").select(
        "grp", "node", "fp", "component", F.size("shingles").alias("n"), F.concat(F.array_except("shingles", middle), F.array_except(middle, F.col("shingles"))).alias("diff")
    )
    apart = materialize(apart, f"{folder}/apart")
    entries = apart.select("grp", "node", "fp", F.explode("diff").alias("e"))
    shared = entries.groupBy("grp", "e").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node", "fp")).alias("who")).filter("c > 1")
    stand = shared.groupBy("grp", "c", "who").agg(F.min("e").alias("e"), F.count("*").alias("w")).select("grp", "e", "c", "w")
    common = entries.join(stand, ["grp", "e"]).groupBy("grp", "node", "fp").agg(F.array_sort(F.collect_list(F.struct("c", "e", "w"))).alias("common"))
    # A link of x and y asks for bound_x + bound_y <= 2 * (100 + percent) * (common elements of their differences).
    out = apart.join(common, ["grp", "node", "fp"], "left").withColumn("common", F.coalesce("common", F.expr("cast(array() AS array<struct<c:bigint,e:bigint,w:bigint>>)")))
    weight = F.aggregate("common", F.lit(0).cast("long"), lambda x, y: x + y["w"])
    return out.select("grp", "node", "component", "n", weight.alias("size"), ((100 + percent) * F.size("diff") - (100 - percent) * F.col("n")).alias("bound"), "common")


def prefixes(common: list[dict], needed: int, members: int) -> list[int]:
    """How many of the first elements must hold m elements in common with a partner, for m = 1, 2, ...

    A partner has elements of the weight ``needed``.  The m-th of the common ones
    has all but the first m - 1 at or behind it, so what the list weighs from
    there on is at least ``needed`` less the m - 1 heaviest.  The list ends at the
    m that costs least, in combinations and in the partners that they would
    find in a group of so many members if its elements were independent.
    """
    behind = np.cumsum([x["w"] for x in reversed(common)])[::-1]
    heaviest = sorted((x["w"] for x in common), reverse=True)
    out: list[int] = []
    best, costs = 1, np.inf
    for m in range(1, LONGEST + 1):
        least = needed - sum(heaviest[: m - 1])
        first = int((behind >= least).sum())
        if m > 1 and (least <= 0 or comb(first, m) > COMBINATIONS):
            break
        out.append(first)
        chances = np.zeros(m + 1)  # sums of products of 0, 1, ... m shares
        chances[0] = 1
        for x in common[:first]:
            chances[1:] += chances[:-1] * min(1.0, x["c"] / members)
        cost = comb(first, m) + PAIR * members * chances[m]
        if cost < costs:
            best, costs = m, cost
    return out[:best]


_TIERED = "grp long, node long, component long, n int, bound int, reach long, common array<struct<c:bigint,e:bigint,w:bigint>>, firsts array<int>"
_KEYED = "grp long, node long, component long, n int, bound int, reach long, tier int, m int, e long, c long"


def tiered(rows: DataFrame) -> DataFrame:
    """The members with ``firsts``, the lengths of their prefixes; ``needed`` is the least weight in common with a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = [prefixes(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("common", "needed", "members")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(firsts, pa.list_(pa.int32()))], names=[*batch.schema.names[:-2], "firsts"])

    return rows.select("grp", "node", "component", F.col("n").cast("int"), F.col("bound").cast("int"), F.col("reach").cast("long"), "common", F.col("needed").cast("long"), "members").mapInArrow(run, _TIERED)


def keyed(rows: DataFrame) -> DataFrame:
    """A row for each combination of m first elements of a member, for its own m (its tier) and for lesser ones that partners have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["grp", "node", "component", "n", "bound", "reach"]
        for batch in batches:
            at, tiers, ms, keys, counts = [], [], [], [], []
            for i, (common, firsts, others) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("common", "firsts", "others")), strict=True)):
                for m, first in enumerate(firsts, 1):
                    if m != len(firsts) and m not in others:
                        continue
                    for some in combinations(common[:first], m):
                        at.append(i)
                        tiers.append(len(firsts))
                        ms.append(m)
                        keys.append(xxhash.xxh3_64_intdigest(np.array([x["e"] for x in some], np.int64).tobytes()))
                        counts.append(min(x["c"] for x in some))
            kept = batch.select(names).take(pa.array(at, pa.int64()))
            more = [pa.array(tiers, pa.int32()), pa.array(ms, pa.int32()), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *more], names=[*names, "tier", "m", "e", "c"])

    return rows.mapInArrow(run, _KEYED)


def open_pairs(members: DataFrame, percent: int, folder: str) -> DataFrame:
    """Pairs (a, b) of members of a group, in different components, that may still be linked.

    A group is named after one component, so one of a pair is outside of it.
    """
    twice, outside = 2 * (100 + percent), F.col("component") != F.col("grp")
    apart = materialize(differences(members, percent, folder), f"{folder}/differences")
    reach = (F.lit(twice) * F.col("size") - F.col("bound")).alias("reach")  # the largest bound a partner may have
    edges = apart.groupBy("grp").agg(F.min(F.when(outside, F.col("bound"))).alias("least_out"), F.count("*").alias("members"), F.min("bound").alias("least"), F.max(reach).alias("most"), F.min(F.struct("bound", "node", "component")).alias("near"))
    known = apart.join(edges, "grp").withColumn("reach", reach)
    # Links that need no common element: with the member nearest to the middle.
    near = known.filter((F.col("near.bound") + F.col("bound") <= 0) & (F.col("near.component") != F.col("component"))).select(F.col("near.node").alias("x"), F.col("node").alias("y"))

    def side(rows: DataFrame, least: str) -> DataFrame:
        """Members with the weight that the least bound of a partner asks for."""
        return tiered(rows.withColumn("needed", F.greatest(F.lit(1), F.ceil((F.col("bound") + F.col(least)) / twice))).filter("size >= needed"))

    def listed(rows: DataFrame, partners: DataFrame, x: str) -> DataFrame:
        others = partners.groupBy("grp").agg(F.collect_set(F.size("firsts")).alias("others"))
        return keyed(rows.join(others, "grp")).select("grp", "m", "e", "c", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "n", "bound", "reach", "tier")))

    viable = known.filter(F.col("reach") >= F.col("least"))
    ours = materialize(side(viable.filter(outside & (F.col("bound") <= F.col("most"))), "least"), f"{folder}/left")
    theirs = materialize(side(viable.filter(F.col("reach") >= F.col("least_out")), "least_out"), f"{folder}/right")
    parts = F.ceil(F.col("c") / LIST_PART).cast("int")
    left = listed(ours, theirs, "a").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("c")
    right = listed(theirs, ours, "b").withColumn("part", F.pmod(F.hash("node_b"), parts)).drop("c")
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    pairs = left.join(right, ["grp", "m", "e", "part"]).filter((F.col("m") == F.least("tier_a", "tier_b")) & (F.col("component_a") != F.col("component_b")) & fits & (F.col("bound_a") <= F.col("reach_b")) & (F.col("bound_b") <= F.col("reach_a")))
    both = pairs.select(F.col("node_a").alias("x"), F.col("node_b").alias("y")).unionAll(near)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD_PERCENT, k: int = SHINGLE, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    spark = docs.sparkSession
    folder = scratch(spark, "neardup")
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")  # no similarity is above the ratio of the sizes

    made = materialize(sketches(docs, k, rows, bands), f"{folder}/sketches")
    classes = (
        made.filter(F.col("fp").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("fp")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    )
    classes = materialize(classes, f"{folder}/classes")

    # Stars: a bucket's least node with each of its others.
    entries = classes.select(F.explode("bands").alias("key"), "node", "n", "fp")
    hubs = entries.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("members"))
    hubs = hubs.filter("members > 1").select("key", F.col("hub.node").alias("hub"), F.col("hub.n").alias("n_hub"))
    buckets = materialize(entries.join(hubs, "key"), f"{folder}/buckets")
    stars = (
        buckets.filter(F.col("hub") != F.col("node"))
        .select(F.col("hub").alias("a"), F.col("node").alias("b"), F.col("n_hub").alias("n_a"), F.col("n").alias("n_b"))
        .filter(fits)
        .select("a", "b")
        .distinct()
    )
    stars = materialize(stars, f"{folder}/stars")

    # Sets of the documents in shared buckets, from their texts once more.
    wanted = buckets.select(F.col("node").alias("doc_id"), "fp").distinct()
    texts = documents(docs).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = materialize(full_sets(texts, k).join(wanted, ["doc_id", "fp"], "left_semi").dropDuplicates(["doc_id", "fp"]), f"{folder}/sets")

    # A document of several texts holds their classes together.
    texts_of = made.filter(F.col("fp").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "fp")
    several = texts_of.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo != hi").select("doc_id")
    own = texts_of.join(several, "doc_id", "left_semi").distinct().join(classes.select("fp", "node"), "fp").filter("node != doc_id").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    links = materialize(confirmed(stars, sets, percent).unionAll(own), f"{folder}/links")
    labels = connected_components(links, f"{folder}/components")

    # Buckets that stars leave open: two components besides the hub, whose own pairs are all decided.
    placed = buckets.join(labels.withColumnRenamed("id", "node"), "node", "left").filter("node != hub").select("key", "node", "fp", F.coalesce("component", "node").alias("component"))
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "component")).alias("most"), F.count("*").alias("parts"))
    parts = parts.filter("parts > 1").select("key", F.col("most.component").alias("grp"))
    members = placed.join(parts, "key").select("grp", "node", "fp", "component").distinct()
    members = materialize(members.join(sets.withColumnRenamed("doc_id", "node"), ["node", "fp"]), f"{folder}/members")
    rest = materialize(open_pairs(members, percent, f"{folder}/open").join(stars, ["a", "b"], "left_anti"), f"{folder}/rest")
    more = materialize(confirmed(rest, sets, percent), f"{folder}/more")
    merged = more.join(labels.select(F.col("id").alias("a"), F.col("component").alias("of_a")), "a", "left").join(labels.select(F.col("id").alias("b"), F.col("component").alias("of_b")), "b", "left")
    merged = merged.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).filter("a != b").distinct()
    over = connected_components(materialize(merged, f"{folder}/merged"), f"{folder}/components-over")

    # From representatives back to every row.
    final = (
        classes.select("fp", "node")
        .join(labels.withColumnRenamed("id", "node"), "node", "left")
        .select("fp", F.coalesce("component", "node").alias("id"))
        .join(over.withColumnRenamed("component", "top"), "id", "left")
        .select("fp", F.coalesce("top", "id").alias("component_id"))
    )
    out = made.select("doc_id", "n_shingles", "fp").join(final, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
