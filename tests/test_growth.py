"""Steps whose work has to grow with their rows, on one large group each."""

import os
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import chunking as C
from tessera.operators import hierarchy as H
from tessera.operators import ops as O
from tessera.operators import retrieval as R
from tessera.operators import trees as T


def equal_calls(spark, n):
    """n cached calls and n calls of one tool that all have the same argument."""
    args = F.create_map(F.lit("brand"), F.lit("b"), F.lit("size"), F.lit(""))
    rows = spark.range(n).select("id", F.format_string("%08d", "id").alias("key"), F.lit("GetAlerts").alias("tool"), args.alias("args"), F.concat(F.lit("out"), "id").alias("output"))
    return rows.select(F.col("id").alias("call_id"), "tool", "args"), rows.select("key", "tool", "args", "output")


def test_equal_arguments_are_answered_once(spark):
    calls, cached = equal_calls(spark, 40_000)
    start = time.perf_counter()
    got = O.best_arguments(calls, cached.select("key", "tool", "args")).groupBy("key", "extra").count().collect()
    assert [tuple(r) for r in got] == [("00000000", 0, 40_000)]
    assert time.perf_counter() - start < 60  # 1.6 billion pairs otherwise


def test_equal_calls_are_replayed_once(spark):
    calls, cached = equal_calls(spark, 40_000)
    start = time.perf_counter()
    got = O.replayed(calls, cached).groupBy("matched_key", "result").count().collect()
    assert [tuple(r) for r in got] == [("00000000", "out0", 40_000)]
    assert time.perf_counter() - start < 60


def test_siblings_are_read_once(spark):
    rows = [(f"c{i}", "p", "primary" if i % 3 else "support", i // 2) for i in range(9)]
    chunks = spark.createDataFrame(rows, "chunk_id string, parent_id string, tier string, pos long")
    out = H.sibling_context(chunks)
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r.chunk_id: (r.prev_primary, r.next_primary) for r in out.collect()}
    ids = [r[0] for r in rows]
    first = [i for i, r in enumerate(rows) if r[2] == "primary"]
    want = {c: (next((ids[j] for j in reversed(first) if j < i), None), next((ids[j] for j in first if j > i), None)) for i, c in enumerate(ids)}
    assert got == want


def shared_words(spark, n):
    docs = spark.range(n).select("id", F.lit("pump valve filter").alias("text"))
    return docs, spark.createDataFrame([(i, "pump valve") for i in range(100)], "query_id long, text string")


def widest_shuffle(df):
    """The most rows that an exchange of a finished plan has written."""
    df.collect()
    seen, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() in ("AdaptiveSparkPlan", "ShuffleQueryStage", "ResultQueryStage", "BroadcastQueryStage", "TableCacheQueryStage"):
            todo.append(node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan())
            continue
        if node.nodeName() == "Exchange":
            seen.append(node.metrics().apply("shuffleRecordsWritten").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return max(seen)


def test_bm25_makes_no_row_for_a_pair(spark):
    docs, asked = shared_words(spark, 3_000)
    hits = R.bm25_hits(docs.filter("id >= 0"), asked, "id", "text", "query_id", "text", 2, statistics=spark.createDataFrame([("pump", 9, 1.0, 3.0), ("valve", 9, 1.0, 3.0)], "term string, df long, idf double, avgdl double"))
    assert widest_shuffle(hits) <= 100 * 2 * 4
    assert {(r.chunk_id, r["rank"], r.score) for r in hits.collect()} == {(0, 1, 2.0), (1, 2, 2.0)}


def test_a_scan_of_tokens_makes_no_row_for_a_pair(spark):
    docs, asked = shared_words(spark, 3_000)
    hits = R.token_scan_hits(docs, asked, "id", "text", "query_id", "text", 2)
    assert widest_shuffle(hits) <= 100 * 2 * 4
    assert {(r.chunk_id, r["rank"], r.score) for r in hits.collect()} == {(0, 1, 9.0), (1, 2, 9.0)}


def test_statistics_of_one_pass_are_those_of_postings(spark):
    docs = spark.createDataFrame([(1, "Pumps pump the, valve valves"), (2, None), (3, "pump"), (4, "the of")], "id long, text string")
    rows = lambda df: sorted((r.term, r.df, round(r.idf, 9), round(r.avgdl, 9)) for r in df.collect())
    assert rows(R.collection_statistics(docs, "text")) == rows(R.term_statistics(R.postings(docs, "id", "text")))
    assert R.collection_statistics(docs.filter("false"), "text").count() == 0


def test_chunkers_take_few_documents_at_a_time():
    texts = pa.array(["x" * 400_000] * 5 + [None, ""] * 200, pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(texts))]), texts], names=["doc_id", "text"])
    got = list(C.slices([batch, batch.slice(0, 0)]))
    assert [i for ids, _ in got for i in ids] == batch.column(0).to_pylist() and [t for _, ts in got for t in ts] == texts.to_pylist()
    assert max(len(ids) for ids, _ in got) <= C.SLICE_ROWS and max(sum(len(t or "") for t in ts) for _, ts in got) <= C.SLICE_BYTES


def test_a_merged_tree_leaves_one_copy_of_its_texts(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))
    rng = random.Random(7)
    docs = spark.createDataFrame([(d, "\n".join("%032x" % rng.getrandbits(128) for _ in range(400))) for d in range(40)], "doc_id long, text string")
    before = size()
    assert T.merged_tree(T.window_forest(docs)).count() > 0
    assert size() - before < 5 * 40 * 400 * 33  # three levels of texts, once, with what the rounds write of ids
