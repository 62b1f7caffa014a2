"""Token ids as flat binary files with document offsets (operator 3).

A shard is two files: ``.bin`` holds unsigned little-endian ids end to end (16
bits wide if the vocabulary allows, else 32), ``.idx`` holds 64-bit offsets, in
ids: one for each document's start and one for the end.  Shards follow
ascending doc_id; documents are range-partitioned and sorted, every partition
writes its shards one after another, each up to ``SHARD_BYTES``, and the position
of a shard in the whole stream is the prefix sum of the sizes before it.  Readers
memory-map the shards.

Ids go to the file as they are made; of a shard a task holds the offsets only.
A shard is written under the name of its attempt and renamed when complete, so
a task that runs twice leaves one whole shard.  Files go to a folder in the
shared store, named as the session's file system names it: through the local
file system where that is mounted, else by Arrow's file system of the scheme.

Tokenising: a word's ids depend on the word alone, so each distinct word goes
through the tokenizer once per worker while the cache has room.  Texts with
characters outside a range whose word boundaries need no Unicode tables go
through the tokenizer whole.

Defined results: a null text is an empty one and still gets its end id; rows of
a null doc_id come first; rows of equal doc_id are ordered by their texts.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from functools import lru_cache
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from .common import documents, materialize, scratch

TOKENIZER_FILE = "word_bpe_49k.json"
#: The end id of the contract.
END_ID = 2
#: A shard is closed once it has so many bytes; one longer document is never cut.
SHARD_BYTES = 1 << 30
#: Words whose ids a worker keeps, over its tasks.
CACHE = 600_000

#: Characters whose class, case and normal form need no table: no white space but ASCII's.
_UNSAFE = re.compile("[^\t\n\r -~¡-įı-ſ‐-‧‰-⁞€]")
_LETTERS, _NUMBERS = "a-zªµºß-öø-ſ", "0-9²³¹¼½¾"
_RUNS = f"[{_LETTERS}]+|[{_NUMBERS}]|[^ \t\n\r{_LETTERS}{_NUMBERS}]+"
_WORDS, _WORDS_WITH_ENDINGS = re.compile(_RUNS), re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|{_RUNS}")


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


class WordTokenizer:
    """The ids of whole texts, equal to the tokenizer's own on them."""

    def __init__(self, path: str, width: int = 0) -> None:
        self._tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if (width or self.vocabulary) <= 1 << 16 else "<u4")
        self._last = np.zeros(self.vocabulary, bool)
        for piece, i in self._tokenizer.get_vocab(with_added_tokens=False).items():
            self._last[i] = piece.endswith("</w>")
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._words: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, new: list[str]) -> None:
        """Words joined by spaces are the same words; a word ends at an end-of-word id."""
        ids = np.array(self._tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self._last[ids]) + 1
        if len(ends) == len(new):
            flat = ids.astype(self.dtype).tobytes()
            cuts = [0, *(ends * self.dtype.itemsize).tolist()]
            self._words.update(zip(new, (flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))
        else:
            self._words.update((w, self._whole(w)) for w in new)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text, without an end id."""
        cut: list[list[str] | bytes] = []
        new: set[str] = set()
        known = self._words
        if len(known) > CACHE:
            known.clear()
        for text in texts:
            if not text:
                cut.append(b"")
            elif _UNSAFE.search(text) or any(s in text for s in self._special):
                cut.append(self._whole(text))
            else:
                found = (_WORDS_WITH_ENDINGS if "'" in text else _WORDS).findall(text.lower())
                cut.append(found)
                new |= set(found).difference(known)
        todo = list(new)
        for i in range(0, len(todo), 5_000):
            self._learn(todo[i : i + 5_000])
        return [c if isinstance(c, bytes) else b"".join(map(known.__getitem__, c)) for c in cut]


@lru_cache(maxsize=2)
def worker_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this process, kept for the worker's next tasks."""
    return WordTokenizer(path)


class Store:
    """Files of a folder in the shared store."""

    def __init__(self, folder: str) -> None:
        self.local = folder.removeprefix("file://") if folder.startswith(("file:", "/")) else None
        if self.local and self.local.startswith("file:"):
            self.local = self.local.removeprefix("file:")
        if self.local is None:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(folder)

    @contextmanager
    def create(self, name: str) -> Iterator[BinaryIO]:
        """A file to write to; it appears under its name once it is whole."""
        attempt = f"{name}.{uuid.uuid4().hex}.attempt"
        if self.local:
            os.makedirs(self.local, exist_ok=True)
            with open(f"{self.local}/{attempt}", "wb") as out:
                yield out
            os.replace(f"{self.local}/{attempt}", f"{self.local}/{name}")
        else:
            self.fs.create_dir(self.root, recursive=True)
            with self.fs.open_output_stream(f"{self.root}/{attempt}") as out:
                yield out
            self.fs.move(f"{self.root}/{attempt}", f"{self.root}/{name}")

    def map(self, name: str, dtype: np.dtype) -> np.ndarray:
        """The numbers of a file, memory-mapped where it is mounted."""
        if self.local:
            path = f"{self.local}/{name}"
            return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
        with self.fs.open_input_file(f"{self.root}/{name}") as held:
            return np.frombuffer(held.read(), dtype)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that the session's file system gives it: no path means one store to Spark and another to a task."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


class Shards:
    """The shards of one partition, written one after another."""

    def __init__(self, store: Store, partition: int, dtype: np.dtype, shard_bytes: int) -> None:
        self._store, self._prefix, self._dtype, self._limit = store, f"shard-{partition:06d}", dtype, shard_bytes
        self._made, self._open = 0, None

    def append(self, packed: bytes) -> tuple[str, int, int]:
        """Write a document's ids; returns the file, its index there and its size in ids."""
        if self._open is None:
            self._offsets, self._open = [0], ExitStack()
            self._stem = f"{self._prefix}-{self._made:06d}"
            self.name = f"{self._stem}.bin{8 * self._dtype.itemsize}"
            self._out = self._open.enter_context(self._store.create(self.name))
            self._made += 1
        name, at, n = self.name, len(self._offsets) - 1, len(packed) // self._dtype.itemsize
        self._out.write(packed)
        self._offsets.append(self._offsets[-1] + n)
        if self._offsets[-1] * self._dtype.itemsize >= self._limit:
            self.close()
        return name, at, n

    def close(self) -> None:
        if self._open is not None:
            self._open.close()
            self._open = None
            with self._store.create(f"{self._stem}.idx") as out:
                out.write(np.array(self._offsets, "<i8").tobytes())


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int | None = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards; returns shard, doc_id, at (index in the shard) and n_tokens.

    The result is lazy: shards are written when their partition is computed.
    Their names are the number of the partition and their own in it; a partition
    computed twice writes the same bytes.
    """
    path, folder = tokenizer_path or default_tokenizer_path(), qualified(docs.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = worker_tokenizer(path)
        shards = Shards(Store(folder), TaskContext.get().partitionId(), coder.dtype, shard_bytes)
        end = b"" if end_id is None else np.array([end_id], coder.dtype).tobytes()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [shards.append(flat + end) for flat in coder.encode_batch(part.column(1).to_pylist())]
                names, at, sizes = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(names), part.column(0), pa.array(at, pa.int64()), pa.array(sizes, pa.int64())], names=["shard", "doc_id", "at", "n_tokens"])
        shards.close()

    ordered = documents(docs)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return ordered.mapInArrow(run, "shard string, doc_id long, at long, n_tokens long")


def shard_bases(manifest: DataFrame) -> list[tuple[str, int, int]]:
    """Each shard in order, with the ids before it and its own: one row for up to ``SHARD_BYTES``."""
    sizes = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    out, base = [], 0
    for row in sizes:
        out.append((row.shard, base, row.n))
        base += row.n
    return out


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the mapped files.

    ``manifest`` says which documents a shard holds; numbers come from the files.
    """
    spark = manifest.sparkSession
    folder = qualified(spark, folder)
    bases = spark.createDataFrame(shard_bases(manifest), StructType([StructField("shard", StringType()), StructField("base", LongType()), StructField("total", LongType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        opened: tuple = ("", None, None)
        for batch in batches:
            out: list[tuple] = []
            for shard, doc_id, at, base in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if opened[0] != shard:
                    opened = (shard, store.map(shard, np.dtype("<u2" if shard.endswith("16") else "<u4")), store.map(f"{shard.rpartition('.')[0]}.idx", np.dtype("<i8")))
                _, ids, index = opened
                a, b = int(index[at]), int(index[at + 1])
                out.append((doc_id, base + a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes())))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.join(F.broadcast(bases), "shard").select("shard", "doc_id", "at", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """The rows of the contract: write the files, then read them back."""
    folder = scratch(docs.sparkSession, "tokens")
    manifest = materialize(write_token_files(docs, f"{folder}/shards", tokenizer_path), f"{folder}/manifest")
    return read_token_files(manifest, f"{folder}/shards")
