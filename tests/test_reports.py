import pytest
from pyspark.sql import functions as F

from tessera.operators import reports as P


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_ordered_distinct_and_sets(spark):
    data = spark.createDataFrame([(1, 3, "a"), (1, 1, "b"), (1, 2, "a"), (1, 4, " "), (1, 5, None)], "g int, pos int, v string")
    assert rows(P.ordered_distinct(data, ["g"], "v", ["pos"], "vs"), "vs") == [(["b", "a"],)]
    assert tuple(P.set_report(data, data.filter("v = 'a'").unionAll(spark.createDataFrame([(1, 1, "z")], data.schema)), "v").first()) == (1, 2, 1)


def test_integration_reports(spark):
    schema = "doc string, parent_id string, tier string, text string, pic_ids array<string>"
    before = spark.createDataFrame([("d", None, "support", "x", ["p1"]), ("d", "s", "primary", "y", ["p2"])], schema)
    after = spark.createDataFrame([("d", "s", "primary", "z" * 900, ["p1"])], schema)
    report = P.integration_report(before, after)
    assert rows(report, "before", "after", "above_800", "primary", "single_child_parents", "lost_pics") == [(2, 1, 1, 1, 1, 1)]
    total = P.report_rollup(report).first()
    assert (total.ratio, total.with_lost_pics) == (0.5, ["d"])


def test_merge_groups(spark):
    data = spark.createDataFrame([("g", 2, 5, 9, "warning", ["b", "a"], "n2"), ("g", 1, 3, 4, "issue", ["a"], "n1"), ("g", 3, 7, 7, None, None, None)], "g string, pos int, first_line int, last_line int, quality string, flags array<string>, note string")
    assert rows(P.merged_metadata(data, "g"), "first_line", "last_line", "quality", "flags", "note") == [(3, 9, "issue", ["a", "b"], "n1; n2")]


def test_pictures(spark):
    pics = spark.createDataFrame([("p1", "own"), ("p2", " "), ("p3", None)], "pic_id string, description string")
    given = spark.createDataFrame([("p1", "x"), ("p2", "y")], "pic_id string, description string")
    assert rows(P.described_pictures(pics, given), "pic_id", "description", "source") == [("p1", "own", "existing"), ("p2", "y", "provided"), ("p3", None, "missing")]
    paths = spark.createDataFrame([("p1", "a", 1), ("p1", "b", 2), ("p2", "c", 1)], "pic_id string, path string, pos int")
    chunks = spark.createDataFrame([("c", ["p2", "p9", "p1"])], "chunk_id string, pic_ids array<string>")
    assert rows(P.picture_paths(chunks, paths), "paths") == [(["c", "b"],)]
    pair = spark.createDataFrame([(["x_1", "q"], ["i/z.png", "i/x_1.png"])], "a array<string>, b array<string>")
    assert [tuple(p) for p in pair.select(P.paired_images(F.col("a"), F.col("b")).alias("o")).first().o] == [("x_1", "i/x_1.png"), ("q", "i/x_1.png")]


def test_judged_pairs(spark):
    refs = spark.createDataFrame([("1", "a"), ("2", "b")], "question_id string, answer string")
    assert rows(P.judged_pairs(spark.createDataFrame([("1", "h")], "question_id string, hypothesis string"), refs), "question_id", "answer") == [("1", "a")]
    for bad in ([("1", "h"), ("1", "i")], [("9", "h")]):
        with pytest.raises(Exception, match="bad question id"):
            P.judged_pairs(spark.createDataFrame(bad, "question_id string, hypothesis string"), refs).collect()


def test_distractors_and_stale_results(spark):
    data = spark.createDataFrame([("c", i, i in (3, 8)) for i in range(10)], "case_id string, idx int, is_evidence boolean")
    assert rows(P.nearest_distractors(data), "idx") == [(2,), (4,)]
    m = spark.createDataFrame([(1, 1, "call", ["a"]), (1, 2, "retrieval", ["a"]), (1, 3, "call", ["b", "c"]), (1, 4, "retrieval", ["b"]), (1, 5, "call", ["d"]), (1, 6, "retrieval", ["d"]), (1, 7, "text", [])], "session int, seq int, kind string, call_ids array<string>")
    assert rows(P.latest_retrieval_only(m), "seq") == [(3,), (5,), (6,), (7,)]


def test_support_nodes_are_completed(spark):
    data = spark.createDataFrame([("d", ["a", "b", "c"], 5, 9), ("d", ["a", "x"], 2, 3)], "doc string, path array<string>, first_line int, last_line int")
    out = {"/".join(r.path): (r.tier, r.synthetic, r.first_line, r.last_line) for r in P.completed_support(data).collect()}
    assert out == {"a": ("support", True, 2, 9), "a/b": ("support", True, 5, 9), "a/b/c": ("primary", False, 5, 9), "a/x": ("primary", False, 2, 3)}


def test_traces(spark):
    t = spark.createDataFrame([("1", "general", ["a"], None)], "trace_id string, intent string, bm25 array<string>, images array<string>")
    assert rows(P.trace_summary(t, ["bm25", "images"]), "n_bm25", "n_images") == [(1, 0)]
    post = spark.createDataFrame([("1", "c", 1)], "trace_id string, chunk_id string, rank int")
    seen = spark.createDataFrame([("1", "c", "d2", 2), ("1", "c", "d1", 1)], "trace_id string, chunk_id string, doc string, pos int")
    assert rows(P.trace_documents(post, seen), "doc") == [("d1",)]
