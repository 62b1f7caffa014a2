import base64
import hashlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tests.llm.test_rules_and_scans import brute_pii, brute_quality
from tests.llm.test_search_and_dedup import brute_components, brute_contamination


def brute(rows, items):
    rows = [(i, t) for i, t in rows if not brute_quality(t)[5] and 10 * brute_quality(t)[2] <= brute_quality(t)[0]]
    kept = {i for i, _, _, k in brute_components(rows) if k}
    rows = [(i, t) for i, t in rows if i in kept]
    hit = {r[0] for r in brute_contamination(rows, items) if r[5]}
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, text in rows:
        if i in hit:
            continue
        out, at = [], 0
        for kind, a, b in sorted(brute_pii(text), key=lambda s: s[1]):
            out += [text[at:a], f"<{kind.upper()}>"]
            at = b
        clean = "".join([*out, text[at:]])
        yield i, hashlib.sha256(" ".join(map(str, own.encode_ordinary(clean))).encode()).hexdigest()


def test_the_run_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in got) == sorted(brute(docs, items))
    assert all(len(r.ids) == r.n_tokens for r in got)


def test_stages_take_odd_rows(spark, sf, odd):
    rows = odd.selectExpr("doc_id", "text", "score AS lang", "'s' AS source", "cast(length(text) AS bigint) AS n_chars", "n_words", "score AS failed", "score AS document_key", "score AS key", "n_words AS hit_key", "score AS row", "score AS kept")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, sf)
        if name != "byte_bpe":
            assert out.columns == rows.columns
        assert stage(spark, rows.filter("false"), sf).count() == 0
        assert out.filter("doc_id IS NULL").count() == (0 if name == "quality_rules" else 1)


def test_one_row_stays_of_rows_that_share_an_id(spark, sf):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = spark.createDataFrame([(1, b, "x"), (1, a, "y"), (1, a, "x"), (2, b, "z"), (3, None, "n"), (3, None, "n"), (None, a, "q")], "doc_id long, text string, lang string")
    got = corpus_pipeline.near_duplicate_removal(spark, rows, sf).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, a, "x"), (3, None, "n"), (None, a, "q")], key=str)
