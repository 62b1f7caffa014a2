"""Byte-level BPE encoding and decoding on a serialised sentencepiece model (operator 1).

No tokenizer is trained: the rank file is turned into a sentencepiece model by
writing its protocol buffer.  Every byte is mapped to one printable character;
a token is a piece of such characters whose score is its negative rank, so the
best-scored merge is the one of lowest rank; the normaliser is the identity and
adds, removes and escapes nothing.  A text is cut in pre-tokens by the public
pattern, each pre-token is encoded on its own, and ids are decoded by the
inverse of the mapping.

Defined results: a null text is an empty one: no ids, zero bytes.  Repeated rows
get equal results; a null doc_id is returned as null.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import documents

RANK_FILE = "byte_bpe_50k.tiktoken"
#: Pre-tokens whose ids a worker keeps over its tasks, and the longest kept.
CACHE, CACHED_LENGTH = 300_000, 64


def default_rank_path() -> str:
    """Where the public vocabulary lies on this machine; a parameter elsewhere."""
    import public_tokenizers

    return public_tokenizers.path(RANK_FILE)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


#: A byte's character: 256 letters from U+4E00 on, none of which is white space or a control.
_BYTE_CHARS = {b: chr(0x4E00 + b) for b in range(256)}
_TO_CHARS = str.maketrans({chr(b): c for b, c in _BYTE_CHARS.items()})
_FROM_CHARS = str.maketrans({c: chr(b) for b, c in _BYTE_CHARS.items()})


def to_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_CHARS)


def from_chars(text: str) -> bytes:
    return text.translate(_FROM_CHARS).encode("latin-1")


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialize_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece ModelProto of a rank vocabulary.

    Piece i + 1 is the token of the i-th lowest rank; piece 0 is the unknown
    piece, which no text can reach, since every byte is a token.
    """
    import struct

    single = [b for b in range(256) if bytes([b]) not in ranks]
    if single:
        raise ValueError(f"a byte-level vocabulary holds every byte; {len(single)} are missing")
    score = lambda x: _varint(2 << 3 | 5) + struct.pack("<f", x)
    out = bytearray(_message(1, _message(1, b"<unk>") + score(0.0) + _number(3, 2)))
    for token, rank in sorted(ranks.items(), key=lambda kv: kv[1]):
        out += _message(1, _message(1, to_chars(token).encode()) + score(-float(rank)) + _number(3, 1))
    # TrainerSpec: type BPE, vocabulary size, unk 0, no bos, eos or pad.
    out += _message(2, _number(3, 2) + _number(4, len(ranks) + 1) + _number(40, 0) + _number(41, -1) + _number(42, -1) + _number(43, -1))
    # NormalizerSpec: identity; no dummy prefix, no space removal, no escaping.
    out += _message(3, _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class ByteBPE:
    """Encoder and decoder of one rank vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialize_model(ranks))
        self._rank = [-1, *sorted(ranks.values())]
        self._bytes = {str(rank): token for token, rank in ranks.items()}
        self._packed = {str(rank): rank.to_bytes(4, "little") for rank in ranks.values()}
        self._pretokens = regex.compile(pattern).findall
        self._known = {token: str(rank) for token, rank in ranks.items()}

        class Encoded(dict):
            def __missing__(kept, pretoken: str) -> str:  # noqa: N805
                ids = self._encode(pretoken)
                if len(pretoken) <= CACHED_LENGTH:
                    if len(kept) >= CACHE:
                        kept.clear()
                    kept[pretoken] = ids
                return ids

        self._encoded = Encoded()

    def _encode(self, pretoken: str) -> str:
        rank = self._rank
        return " ".join([str(rank[i]) for i in self._model.encode(to_chars(pretoken.encode()))])

    def encode_text(self, text: str | None) -> str:
        """The decimal ids of a whole text, joined by one space."""
        return " ".join(map(self._encoded.__getitem__, self._pretokens(text))) if text else ""

    def pack(self, ids: str) -> np.ndarray:
        """The ids of an encoded text as numbers."""
        return np.frombuffer(b"".join(map(self._packed.__getitem__, ids.split())), "<i4")

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.encode_text(text).split()]

    def count(self, text: str | None) -> int:
        """The number of ids of a whole text."""
        ids = self.encode_text(text)
        return ids.count(" ") + 1 if ids else 0

    def decode_text(self, ids: str) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids.split()))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self._bytes[str(i)] for i in ids])


@lru_cache(maxsize=2)
def worker_coder(path: str, pattern: str) -> ByteBPE:
    """The coder of this process, kept with its cache for the worker's next tasks."""
    return ByteBPE(read_ranks(path), pattern)


def _over(docs: DataFrame, ranks_path: str | None, pattern: str | None, row: Callable[[ByteBPE, str | None], tuple], kinds: list[pa.DataType], schema: str) -> DataFrame:
    path, cut = ranks_path or default_rank_path(), pattern or default_pattern()
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(path, cut)
        for batch in batches:
            made = [row(coder, text) for text in batch.column(1).to_pylist()]
            columns = list(zip(*made, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    return documents(docs).mapInArrow(run, schema)


def bpe_encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and its ids."""
    return _over(docs, ranks_path, pattern, lambda c, t: (c.encode(t),), [pa.list_(pa.int32())], "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id and the decoded bytes; ``encoded`` has doc_id and ids."""
    path = ranks_path or default_rank_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {rank: token for token, rank in read_ranks(path).items()}
        for batch in batches:
            out = [b"".join([of[i] for i in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def bpe_encode_rows(docs: DataFrame, keep: list[str], ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns ``keep`` of docs, then n_tokens, ids, ids_sha256 and decoded_sha256.

    Raises where the decoded bytes are not the text's.
    """
    path, cut = ranks_path or default_rank_path(), pattern or default_pattern()
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(path, cut)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                packed, ids_digest, text_digest = [], [], []
                for text in part.column(len(keep)).to_pylist():
                    ids = coder.encode_text(text)
                    decoded = coder.decode_text(ids)
                    if decoded != (text or "").encode():
                        raise ValueError("a text did not survive encoding and decoding")
                    packed.append(coder.pack(ids))
                    ids_digest.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_digest.append(hashlib.sha256(decoded).hexdigest())
                sizes = [len(p) for p in packed]
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                ids_column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(packed)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array(sizes, pa.int64()), ids_column, pa.array(ids_digest), pa.array(text_digest)], names=[*keep, "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
                )

    kept = StructType([*rows.select(*keep).schema.fields, *StructType.fromDDL("n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string").fields])
    return rows.mapInArrow(run, kept)


def bpe_token_counts(docs: DataFrame, keep: list[str] | None = None, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns ``keep`` of docs, by default doc_id, and n_tokens."""
    path, cut, names = ranks_path or default_rank_path(), pattern or default_pattern(), keep or ["doc_id"]
    rows = docs.select(*names, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(path, cut)
        for batch in batches:
            counts = [coder.count(t) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(counts, pa.int64())], names=[*names, "n_tokens"])

    return rows.mapInArrow(run, StructType([*rows.select(*names).schema.fields, *StructType.fromDDL("n_tokens long").fields]))


def bpe_round_trip(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The rows of the contract: each whole text encoded, and its ids decoded, as digests."""

    def row(coder: ByteBPE, text: str | None) -> tuple:
        ids = coder.encode_text(text)
        decoded = coder.decode_text(ids)
        return ((ids.count(" ") + 1) if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest())

    return _over(docs, ranks_path, pattern, row, [pa.int64(), pa.string(), pa.string()], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
