import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe, token_counts, token_files
from tessera.llm.common import scratch


@pytest.fixture(scope="module")
def own():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBPE(bpe.read_ranks(bpe.default_rank_path()), bpe.default_pattern())


def test_encoding_equals_the_public_library(spark, sf, own):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.bpe_round_trip(docs).collect():
        ids = own.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


_CODERS = []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_round_trips(text):
    if not _CODERS:
        ranks = bpe.read_ranks(bpe.default_rank_path())
        _CODERS[:] = [bpe.ByteBPE(ranks, bpe.default_pattern()), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), token_files.WordTokenizer(token_files.default_tokenizer_path()), Tokenizer.from_file(P.path("word_bpe_49k.json"))]
    coder, own, words, whole = _CODERS
    assert coder.encode(text) == own.encode_ordinary(text)
    assert coder.decode(coder.encode(text)) == text.encode()
    assert np.frombuffer(words.encode_batch([text])[0], words.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_a_vocabulary_must_hold_every_byte():
    with pytest.raises(ValueError):
        bpe.serialize_model({b"a": 0})


def test_odd_rows(odd, none, own):
    got = [(r.doc_id, r.n_tokens) for r in bpe.bpe_token_counts(odd).collect()]
    want = [(r.doc_id, len(own.encode_ordinary(r.text or ""))) for r in odd.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.bpe_round_trip(none).count() == 0
    back = bpe.bpe_decode(bpe.bpe_encode(odd)).collect()
    assert sorted((bytes(r.decoded) for r in back)) == sorted((r.text or "").encode() for r in odd.collect())


def _expected(rows):
    t, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        yield doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_files_read_back(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = sorted(tuple(r) for r in token_files.token_file_digest(docs).collect())
    assert got == list(_expected(rows))


def test_files_of_odd_rows(odd, none):
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted((tuple(r) for r in token_files.token_file_digest(odd).collect()), key=lambda r: r[1])
    assert got == list(_expected(rows))
    assert token_files.token_file_digest(none).count() == 0


def test_shards_roll_and_read_back_alike(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    manifest = token_files.write_token_files(docs, str(tmp_path), shard_bytes=4096).cache()
    got = sorted(tuple(r) for r in token_files.read_token_files(manifest, str(tmp_path)).collect())
    assert got == sorted(tuple(r) for r in token_files.token_file_digest(docs).collect())
    sizes = [p.stat().st_size for p in tmp_path.iterdir() if p.suffix == ".bin16"]
    assert len(sizes) > docs.rdd.getNumPartitions() and not list(tmp_path.glob("*.attempt"))


def test_wide_vocabularies_use_32_bits():
    assert token_files.WordTokenizer(token_files.default_tokenizer_path(), 1 << 17).dtype == np.dtype("<u4")


def test_rollup_equals_a_new_count_and_batches_are_idempotent(spark):
    store = token_counts.TokenCountStore(spark, scratch(spark, "test-counts"))
    schema = "doc_id long, tokenizer string, source string, lang string, n_tokens long, deleted boolean"
    first = spark.createDataFrame([(1, "t", "a", "en", 10, False), (2, "t", "a", None, 5, False), (3, "t", "b", "en", None, False), (None, "t", "b", "en", 9, False), (4, "t", "a", "en", 1, None)], schema)
    second = spark.createDataFrame([(1, "t", "b", "en", 7, False), (2, "t", "a", None, 0, True), (9, "t", "a", "en", 3, True)], schema)
    assert store.rollup().count() == 0
    assert store.commit(1, first)
    before = sorted(map(tuple, store.rollup().collect()), key=str)
    assert not store.commit(1, first)
    assert sorted(map(tuple, store.rollup().collect()), key=str) == before
    assert store.commit(2, second)
    assert not store.commit(2, second)
    facts = {}
    for r in store.facts().collect():
        n, t = facts.get((r.source, r.lang, r.tokenizer), (0, 0))
        facts[(r.source, r.lang, r.tokenizer)] = (n + 1, t + r.n_tokens)
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.rollup().collect()} == facts == {("a", "en", "t"): (1, 1), ("b", "en", "t"): (2, 7)}
    with pytest.raises(ValueError):
        store.commit(0, second)


def test_rollup_of_the_query_equals_brute_force(spark, sf, own):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    count = lambda t: len(own.encode_ordinary(t or ""))
    marks, before, after, tokens_before, tokens = {}, Counter(), Counter(), Counter(), Counter()
    for r in labels.collect():
        q, t = marks.get(r.doc_id, (1, 0))
        marks[r.doc_id] = (min(q, r.quality), max(t, r.toxic))
    for r in docs.collect():
        group = (r.source, r.lang)
        before[group] += 1
        tokens_before[group] += count(r.text)
        quality, toxic = marks.get(r.doc_id, (1, 0))
        if quality == 0:
            continue
        after[group] += 1
        tokens[group] += count(re.sub("[0-9]", "", r.text or "")) if toxic else count(r.text)
    got = {(r.source, r.lang): (r.n_docs_before, r.n_tokens_before, r.n_docs, r.n_tokens) for r in token_counts.token_count_rollup(docs, labels).collect()}
    assert got == {g: (before[g], tokens_before[g], after[g], tokens[g]) for g in before} and any(before[g] != after[g] for g in before)


def test_rollup_of_odd_rows(spark, odd, none):
    rows = odd.selectExpr("doc_id", "text", "score AS lang", "'s' AS source", "n_words AS n_tokens", "score AS deleted", "score AS drop")
    labels = spark.createDataFrame([(1, 0, 0), (2, None, 1), (3, 1, None), (None, 0, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.lang: (r.n_docs_before, r.n_docs) for r in token_counts.token_count_rollup(rows, labels).collect()}
    assert got == {"a": (1, 0), "b": (1, 1), None: (1, 1), "c": (1, 1), "e": (1, 1), "f": (1, 1), "g": (1, 1)}
    assert token_counts.token_count_rollup(rows.filter("false"), labels).count() == 0
