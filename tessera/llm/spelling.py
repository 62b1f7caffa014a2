"""Spelling variants: words at distance one by trie and automaton (op 11).

Words are sorted and cut into shards of a fixed number of words; each shard is
a compact trie (nodes in breadth-first order, one character, one first child and
one word number a node, so that the children of a node lie side by side and a
child is found by a search in a slice).  A few shards at a time are broadcast,
never more than ``BROADCAST_BYTES``, and every partition of the sorted words is
met with each of them: the states of a word's distance-one Levenshtein automaton
walk down the trie, and words that share a beginning share the states of it, so
that a partition costs the states of its own trie, depth first.  A word gives a
shard at most one row (how many neighbours, the best of them), never its pairs;
shards are reduced by word.

Scale: counting combines in the task before it shuffles one row a word; words
shuffle once to be sorted; a shard is built by one task and passes the driver as
a block of fixed size; jobs grow with the vocabulary, and a shard that holds
nothing near a beginning ends at that beginning.

Edges: a null text has no words and a null doc_id hashes as an empty one;
repeated rows count as often as they occur; a run may be of any length; no words
give no rows; ties go to the word that is first in code-point order; other
columns of the table are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, scratch

#: A run of letters that can become a word; shorter ones stay shorter.
LEAST_LETTERS, LEAST_COUNT, RATIO, ONE_IN = 7, 2, 10, 31
SHARD_WORDS, BROADCAST_BYTES = 50_000, 24_000_000
_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LETTERS)
#: Distinct words that a task holds before it hands its counts on.
_HELD = 200_000


def run_counts(text: str, doc_id: int | None) -> Counter:
    """The words of one text after its own deletions, counted."""
    low, found = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), Counter()
    head = "" if doc_id is None else str(doc_id)
    for run, n in Counter(_RUN.findall(low)).items():
        h = zlib.crc32(f"{head}:{run}".encode())
        if h % ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LETTERS:
                continue
        found[run] += n
    return found


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n of every word of the table that is long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    held.update(run_counts(text, doc_id))
                if len(held) >= _HELD:
                    yield handed()
                    held.clear()
        if held:
            yield handed()

    return documents(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


class Trie:
    """Sorted distinct words with their counts as a compact trie."""

    def __init__(self, words: list[str], counts: list[int]) -> None:
        self.words, self.counts = words, counts
        chars: list[list[str]] = [[""]]
        owner: list[list[int]] = [[0]]
        ends: list[list[int]] = [[-1]]
        before = ""
        for number, word in enumerate(words):
            same = 0
            while same < len(before) and same < len(word) and before[same] == word[same]:
                same += 1
            for depth in range(same, len(word)):
                if depth + 1 == len(chars):
                    chars.append([]), owner.append([]), ends.append([])
                chars[depth + 1].append(word[depth])
                owner[depth + 1].append(number)
                ends[depth + 1].append(-1)
            if word:
                ends[len(word)][-1] = number
            before = word
        bases = np.cumsum([0, *map(len, chars)])
        first = [bases[d + 1] + np.searchsorted(owner[d + 1], owner[d]) for d in range(len(chars) - 1)] + [np.full(len(chars[-1]), bases[-1])]
        # a node without children begins where the next node's children begin, so that its slice is empty
        self.first = np.append(np.concatenate(first), bases[-1]).astype(np.int64).tolist()
        self.chars = "\0" + "".join(c for level in chars[1:] for c in level)
        self.ends = [e for level in ends for e in level]

    def pack(self) -> dict:
        return {"words": "\n".join(self.words), "counts": np.array(self.counts, "<i8").tobytes(), "chars": self.chars, "first": np.array(self.first, "<i4").tobytes(), "ends": np.array(self.ends, "<i4").tobytes()}

    @classmethod
    def unpack(cls, made: dict) -> Trie:
        trie = cls.__new__(cls)
        trie.words, trie.chars = made["words"].split("\n") if made["words"] else [], made["chars"]
        trie.counts = np.frombuffer(made["counts"], "<i8").tolist()
        trie.first, trie.ends = np.frombuffer(made["first"], "<i4").tolist(), np.frombuffer(made["ends"], "<i4").tolist()
        return trie


def neighbours(trie: Trie, words: list[str]) -> Iterator[tuple[int, int, int, str]]:
    """For each of the sorted ``words`` with any: its index, its neighbours in the trie, the count and name of the best.

    A state is a node and the number of edits so far: ``exact`` is the node of
    the word's own beginning (-1: none), ``edited`` the nodes after one edit.
    The states after each beginning of the present word are kept on a stack.
    """
    chars, first, ends, counts = trie.chars, trie.first, trie.ends, trie.counts
    find = chars.find
    stack: list[tuple[int, set[int]]] = [(0, set(range(first[0], first[1])))]
    before, dead = "", None
    for number, word in enumerate(words):
        if dead is not None and word.startswith(dead):
            continue
        dead, same, most = None, 0, min(len(before), len(word), len(stack) - 1)
        while same < most and before[same] == word[same]:
            same += 1
        del stack[same + 1 :]
        before = word
        for depth in range(same, len(word)):
            c, (exact, edited) = word[depth], stack[-1]
            now = {find(c, first[v], first[v + 1]) for v in edited}
            now.discard(-1)
            if exact >= 0:
                a, b = first[exact], first[exact + 1]
                met = find(c, a, b)
                now.update(range(a, b))  # another character in its place
                now.add(exact)  # this character left out
                if met >= 0:
                    now.discard(met)
                    now.update(range(first[met], first[met + 1]))  # one character more
                exact = met
            if exact < 0 and not now:
                dead = word[: depth + 1]
                break
            stack.append((exact, now))
        if dead is not None:
            continue
        found = [ends[v] for v in stack[-1][1] if ends[v] >= 0]
        if found:
            best = min(found, key=lambda i: (-counts[i], i))
            yield number, len(found), counts[best], trie.words[best]


def build_shards(ordered: DataFrame, path: str, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The tries of sorted words (word, n), one row a shard of at most ``shard_words`` words."""
    schema = "shard string, size long, words string, counts binary, chars string, first binary, ends binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, words, counts = TaskContext.get().partitionId(), 0, [], []

        def shard() -> pa.RecordBatch:
            own = sorted(zip(words[:shard_words], counts[:shard_words], strict=True))  # a task may read several files
            packed = Trie([w for w, _ in own], [n for _, n in own]).pack()
            size = sum(len(v) for v in packed.values())
            row = {"shard": f"{part:06d}-{made:06d}", "size": size} | packed
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.string()), ("size", pa.int64()), ("words", pa.string()), ("counts", pa.binary()), ("chars", pa.string()), ("first", pa.binary()), ("ends", pa.binary())]))

        for batch in batches:
            words += batch.column(0).to_pylist()
            counts += batch.column(1).to_pylist()
            while len(words) >= shard_words:
                yield shard()
                made, words, counts = made + 1, words[shard_words:], counts[shard_words:]
        if words:
            yield shard()

    return materialize(ordered.select("word", "n").mapInArrow(run, schema), path)


def _blocks(shards: DataFrame, most: int) -> Iterator[list[str]]:
    """Names of shards, so many at a time as fit into one broadcast."""
    block, size = [], 0
    for row in shards.select("shard", "size").orderBy("shard").toLocalIterator():
        if block and size + row["size"] > most:
            yield block
            block, size = [], 0
        block.append(row["shard"])
        size += row["size"]
    if block:
        yield block


def near_words(ordered: DataFrame, folder: str, shard_words: int = SHARD_WORDS, most: int = BROADCAST_BYTES) -> DataFrame:
    """word, n_near, near_n and near (the best neighbour) of each sorted word that has neighbours."""
    spark = ordered.sparkSession
    shards = build_shards(ordered, f"{folder}/shards", shard_words)
    found = None
    for number, block in enumerate(_blocks(shards, most)):
        held = spark.sparkContext.broadcast([r.asDict() for r in shards.filter(F.col("shard").isin(block)).collect()])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            tries = [Trie.unpack(x) for x in held.value]
            for batch in batches:
                words = batch.column(0).to_pylist()
                rows = [(words[i], *rest) for trie in tries for i, *rest in neighbours(trie, words)]
                names, kinds = ["word", "n_near", "near_n", "near"], [pa.string(), pa.int64(), pa.int64(), pa.string()]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        part = materialize(ordered.select("word").mapInArrow(run, "word string, n_near long, near_n long, near string"), f"{folder}/near-{number}")
        found = part if found is None else found.unionAll(part)
        held.destroy()
    if found is None:
        return ordered.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("near_n"), F.lit(None).cast("string").alias("near")).filter("false")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.order")).alias("near_n"), F.col("best.near").alias("near"))


def follow_forms(forms: DataFrame, folder: str) -> DataFrame:
    """word and root of every row of ``forms`` (word, form): the end of the chain, found by doubling the steps.

    A form is at least ten times as frequent as its word, so a chain has fewer
    steps than the largest count has digits.
    """
    current, step = materialize(forms.select("word", F.col("form").alias("root")), f"{folder}/root-0"), 0
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = current.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step += 1
        moved = materialize(moved, f"{folder}/root-{step}")
        if moved.filter("moved").isEmpty():
            return current
        current = moved.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The rows of the contract: every word with its form, its root and its neighbours."""
    spark = docs.sparkSession
    folder = scratch(spark, "spelling")
    ordered = materialize(word_counts(docs).repartitionByRange("word").sortWithinPartitions("word"), f"{folder}/words")
    near = near_words(ordered, folder)
    is_form = F.col("near_n") >= RATIO * F.col("n")
    words = ordered.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near_n")).alias("form_n")
    )
    words = materialize(words, f"{folder}/variants")
    roots = follow_forms(words.filter("form IS NOT NULL"), folder)
    return words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
