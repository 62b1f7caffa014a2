import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking as C
from tessera.operators import evaluate as E
from tessera.operators import hierarchy as H
from tessera.operators import memory as M
from tessera.operators import ops as O
from tessera.operators import retrieval as R
from tessera.operators import understand as U
from tessera.plans import hooks
from tessera.plans import retrieve as P


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_normalisation_of_a_channel(spark):
    hits = spark.createDataFrame([(1, c, s, r, ch) for ch in ("bm25", "scan") for c, s, r in (("a", 5.0, 1), ("b", 5.0, 2), ("c", 5.0, 3))], "query_id long, chunk_id string, score double, rank long, channel string")
    out = {(r.channel, r.chunk_id): round(r.norm, 4) for r in R.normalized(hits).collect()}
    assert [out[("bm25", c)] for c in "abc"] == [1.0, 0.6667, 0.3333] == [out[("scan", c)] for c in "abc"]
    one = spark.createDataFrame([(1, "a", 0.0, 1, "vector")], hits.schema)
    assert R.normalized(one).first().norm == 1.0


def test_fused_order_descends_in_score_channels_and_id(spark):
    hits = spark.createDataFrame([(1, "a", "bm25", 0.5), (1, "b", "bm25", 0.5), (1, "c", "scan", 1.0), (1, "d", "vector", 1.0), (1, "d", "vector", 0.2)], "query_id long, chunk_id string, channel string, norm double")
    out = R.fused(hits).orderBy("rank")
    assert rows(out, "chunk_id", "merged_score") == [("d", 0.6), ("c", 0.2), ("b", 0.2), ("a", 0.2)]


def test_noisy_or_is_exact(spark):
    data = spark.createDataFrame([(1, "x", "p", 0, 0.5), (1, "x", "q", 1, 0.7), (1, "y", "p", 0, 0.6), (1, "y", "p", 0, 0.5), (1, "z", "p", 0, 1.0)], "query_id long, label string, source string, pos int, score double")
    out = {r.label: (r.score, r.sources, r.strong) for r in R.merged_candidates(data).collect()}
    assert out == {"x": (0.85, "p+q", True), "y": (0.8, "p", True), "z": (1.0, "p", True)}


def test_cosine_and_filters(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0], "en"), (2, [0.0, 1.0], "en"), (3, [1.0, 1.0], None), (4, [0.0, 0.0], "en")], "chunk_id long, v array<double>, language string")
    queries = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, qv array<double>")
    assert rows(R.cosine_hits(queries, corpus, 2).orderBy("rank"), "chunk_id", "score") == [(1, 1.0), (3, 0.707107)]
    assert rows(R.cosine_hits(queries, corpus, 9, R.metadata_filter({"language": [" en "], "tier": []})).orderBy("rank"), "chunk_id") == [(1,), (2,)]


def test_completion_and_budgets(spark):
    full = spark.createDataFrame([(1, c, i) for i, c in enumerate("abcd", 1)], "query_id long, chunk_id string, rank long")
    first = spark.createDataFrame([(1, "c", 1)], full.schema)
    assert rows(R.completed(first, full).orderBy("rank"), "chunk_id") == [("c",), ("a",), ("b",), ("d",)]
    dealt = full.withColumn("route", (F.col("rank") % 2).cast("int")).withColumn("rank", F.lit(3))
    assert R.split_budget(dealt, 5, 2).count() == 2


def _chunks(spark):
    data = [("r", None, "big_support", 0), ("s1", "r", "support", 1), ("s2", "r", "support", 2), ("p1", "s1", "primary", 3), ("p2", "s1", "primary", 4), ("p3", "s2", "primary", 5), ("x", "gone", "primary", 6)]
    return spark.createDataFrame(data, "chunk_id string, parent_id string, tier string, pos int")


def test_parents_descendants_and_faults(spark):
    chunks = _chunks(spark)
    hits = spark.createDataFrame([(1, "p3", "s2", "primary", 1), (1, "p1", "s1", "primary", 2), (1, "p2", "s1", "primary", 3), (1, "s2", "r", "support", 4)], "query_id long, chunk_id string, parent_id string, tier string, rank long")
    parents = H.parent_rows(hits, chunks)
    assert rows(parents.orderBy("rank"), "parent_id") == [("s2",), ("s1",)]
    assert rows(H.support_context(parents, hits), "parent_id") == [("s1",)]
    below = H.descendants(chunks, chunks.filter("chunk_id = 'r'"))
    assert sorted(rows(below, "chunk_id", "depth")) == [("p1", 2), ("p2", 2), ("p3", 2), ("s1", 1), ("s2", 1)]
    assert dict(rows(H.violations(chunks), "fault", "n")) == {"dangling_parent": 1, "primary_with_children": 0, "childless_support": 0, "self_parent": 0}


def test_cycles_end(spark):
    loop = spark.createDataFrame([("a", "b", "support"), ("b", "a", "support")], "chunk_id string, parent_id string, tier string")
    assert rows(H.descendants(loop, loop.filter("chunk_id = 'a'")), "chunk_id") == [("b",)]


def test_big_support_ends_before_its_first_child(spark):
    data = [("s", None, "support", 10, 90, 9000), ("a", "s", "primary", 20, 30, 50), ("b", "s", "primary", 5, 8, 50), ("t", None, "support", 1, 2, 10)]
    out = H.big_support(spark.createDataFrame(data, "chunk_id string, parent_id string, tier string, first_line int, last_line int, n_chars int"))
    assert {r.chunk_id: (r.tier, r.last_line) for r in out.collect()} == {"s": ("big_support", 19), "a": ("primary", 30), "b": ("primary", 8), "t": ("support", 2)}


def _messages(spark, roles):
    return spark.createDataFrame([(1, i, r, f"m{i}") for i, r in enumerate(roles, 1)], "session long, seq long, role string, text string")


def test_boundary_keeps_three_rounds(spark):
    m = _messages(spark, ["user", "assistant"] * 4)
    b = M.boundary(m)
    assert rows(b, "through_seq", "n_prefix") == [(2, 2)]
    assert rows(M.tail(m, b).orderBy("seq"), "seq") == [(i,) for i in range(3, 9)]
    assert M.tail(m, b.withColumn("through_seq", F.lit(99).cast("long"))).count() == 8
    assert M.boundary(_messages(spark, ["user", "assistant"] * 2)).count() == 0


def test_gaps_trimming_and_budget(spark):
    m = _messages(spark, ["user", "assistant"] * 5)
    assert M.gap_free(m).count() == 10 and M.gap_free(m.filter("seq <> 4")).count() == 0
    assert rows(M.sequence_gaps(m.filter("seq NOT IN (4, 5)")), "gaps", "first_missing") == [(1, 4)]
    assert rows(M.trimmed(m).orderBy("seq"), "seq") == [(i,) for i in (1, 5, 6, 7, 8, 9, 10)]
    totals = spark.createDataFrame([(1, 18021), (2, 18022), (3, 22528)], "session long, tokens long")
    assert rows(M.budget(totals).orderBy("session"), "available", "compact", "over") == [(22528, False, False), (22528, True, False), (22528, True, True)]


def test_memory_log_and_admission(spark):
    log = [(1, 1, "create", "a", 10), (1, 2, "update", "b", 20), (1, 3, "deactivate", None, 30), (2, 1, "create", "c", 10), (2, 2, "delete", None, 20), (3, 1, "create", "d", 1), (3, 2, "delete", None, 2), (3, 3, "create", "e", 3)]
    out = M.applied_actions(spark.createDataFrame(log, "memory_id long, seq long, action string, content string, at long"))
    assert sorted(rows(out, "memory_id", "status", "content", "created_at", "updated_at")) == [(1, "inactive", "b", 10, 30), (3, "active", "e", 3, 3)]
    items = spark.createDataFrame([("ok", "said", "active", 0.7), ("the password is x", "said", "active", 0.9), ("ok", " ", "active", 0.9), ("ok", "said", "active", 0.69), ("ok", "said", "inactive", 1.0)], "content string, evidence string, status string, confidence double")
    assert M.admissible(items, ["password"]).count() == 1
    now = F.lit("2024-01-01T00:00:00Z").cast("timestamp")
    times = spark.createDataFrame([("2023-12-31T23:59:59Z",), ("2024-01-01T00:00:00",), ("2024-01-01T01:00:00+02:00",), ("never",), (None,), ("2025-01-01",)], "e string")
    assert [r.x for r in times.select(M.expired(F.col("e"), now).alias("x")).collect()] == [True, True, True, False, False, False]


def test_snapshots_and_state_lists(spark):
    m = _messages(spark, ["user"] * 4)
    snaps = spark.createDataFrame([(1, 3, 2, "fine"), (1, 9, 2, "no message"), (1, 1, 2, "back"), (1, 3, None, " "), (1, 4, None, "x" * 7000)], "session long, through_seq long, saved_seq long, summary string")
    assert sorted(rows(M.snapshot_checks(snaps, m), "summary", "accepted"))[0][1] is False
    assert rows(M.snapshot_checks(snaps, m).filter("accepted"), "summary") == [("fine",)]
    lists = spark.createDataFrame([(["A b", "a  B", " ", "c", "disk full now"], ["disk full"])], "v array<string>, r array<string>")
    got = lists.select(M.clean_list(F.col("v")).alias("v"), M.without_rejected(F.col("v"), F.col("r")).alias("h")).first()
    assert got.v == ["A b", "c", "disk full now"] and "disk full now" not in got.h


def test_metrics_and_diagnosis(spark):
    series = spark.createDataFrame([("a", 1, "1.5"), ("a", 2, "x"), ("a", 3, "0.5"), ("b", 1, None)], "series string, ordinal int, value string")
    assert rows(O.metric_summary(series), "series", "first", "last", "min", "max", "mean", "samples") == [("a", 1.5, 0.5, 0.5, 1.5, 1.0, 2)]
    samples = spark.createDataFrame([("cpu", 80.04), ("cpu", 80.06), ("memory", 70.0), ("disk", 99.0)], "metric string, value double")
    assert [r.alert for r in O.above_thresholds(samples).collect()] == [False, True, False, False]
    results = spark.createDataFrame([("1", True, ["CPU Full"], ["Pod-A"], "it was cpu-full!", "pod a", 2.0), ("2", True, ["net"], ["b"], "disk", "b", 0.0), ("3", False, ["net"], ["b"], "net", "b", None)], "case_id string, completed boolean, causes array<string>, objects array<string>, said_cause string, said_object string, latency double")
    report = O.diagnosis_report(O.diagnosis_scores(results)).first()
    assert tuple(report) == (3, 2, 0.5, 1.0, 0.5, 2.0)
    assert O.diagnosis_report(O.diagnosis_scores(results.filter("NOT completed"))).first().cause_accuracy is None
    with pytest.raises(ValueError):
        O.log_search(series, F.lit(0), F.lit(1), "*", 1001)


def test_cached_calls(spark):
    cached = spark.createDataFrame([("k1", "t", {"a": "1"}), ("k2", "t", {"a": "1", "b": "2"}), ("k0", "t", {"a": "1", "c": "3"}), ("k3", "u", {"a": "1"}), ("k4", "t", {"resource_type": "pods"})], "key string, tool string, args map<string,string>")
    calls = spark.createDataFrame([(1, "t", {"a": "1", "x": ""}), (2, "t", {"b": "2"}), (3, "t", {"z": "9"}), (4, "t", {"resource_type": "pod"})], "call_id long, tool string, args map<string,string>")
    assert sorted(rows(O.best_arguments(calls, cached), "call_id", "key", "extra")) == [(1, "k1", 0), (2, "k2", 1), (4, "k4", 0)]


def test_recall(spark):
    hits = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 4, True)], "query_id long, rank long, relevant boolean")
    queries = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "query_id long, grp string")
    assert sorted(rows(E.recall_at(hits, queries, 3), "grp", "n", "hits", "recall"), key=str) == [("a", 2, 1, 50.0), ("b", 1, 0, 0.0), (None, 3, 1, 33.3)]
    assert tuple(E.hit_rates(hits, queries).first()) == (3, 0, 1, 2)


def test_sections_skip_fences_and_empty_bodies():
    text = "intro\n# A\n\n## B\nbody\n```\n# not a heading\n```\n# C\n"
    found = list(C.sections(text))
    assert [s[0] for s in found] == [[], ["A", "B"]]
    assert "# not a heading" in found[1][3]
    made = list(C.runbook_rows("doc", "# T\n" + "word " * 1000))
    assert all(len(r[6]) <= C.RUNBOOK_CHARS and r[6].startswith("文档：T\n章节：T\n\n") for r in made) and made[0][1].endswith("_0001")


def test_splitting_loses_no_word():
    text = "\n\n".join(f"para {i} " + "w " * (i * 7) for i in range(30))
    pieces = C.split_recursively(text, 200, 0)
    assert all(len(p) <= 200 for p in pieces) and " ".join(pieces).split() == text.split()
    assert C.split_recursively("x" * 450, 200, 0) == ["x" * 200, "x" * 200, "x" * 50]
    windows = C.line_windows("\n".join(f"line {i}" for i in range(300)), 800, 100)
    assert all(b[0] <= a[1] + 1 for a, b in zip(windows, windows[1:], strict=False)) and windows[-1][1] == 300
    assert C.merge_small(["a" * 400, "b", "c" * 500], 300, 1600) == ["a" * 400 + "\n\nb", "c" * 500]


def test_merging_and_collapsing(spark):
    mk = lambda i, p, t, n: {"chunk_id": i, "parent_id": p, "tier": t, "text": i * n, "ids": [i]}
    out = C.merged_siblings([mk("a", "s", "primary", 100), mk("b", "s", "primary", 900), mk("c", "s", "primary", 500)], 200, 400, 800)
    assert [c["ids"] for c in out] == [["a", "b"], ["c"]]
    assert [c["ids"] for c in C.merged_siblings([mk("a", "s", "primary", 100), mk("b", "s", "primary", 900)], 200, 400, 800, False)] == [["a"], ["b"]]
    lone = C.collapsed_parents([mk("r", None, "support", 1), mk("s", "r", "support", 2), mk("p", "s", "primary", 3)])
    assert [(c["chunk_id"], c["parent_id"], c["text"]) for c in lone] == [("p", None, "r\nss\nppp")]
    data = spark.createDataFrame([("d", 2, "d2", "d1", "primary", "x" * 50), ("d", 1, "d1", None, "support", "s"), ("d", 3, "d3", "d1", "primary", "y" * 50), ("d", 4, "d4", "d1", "auxiliary", "z")], "doc string, pos int, chunk_id string, parent_id string, tier string, text string")
    assert sorted(rows(C.integrated(data), "chunk_id", "parent_id", "n_merged")) == [("d_0001", None, 1), ("d_0002", "d_0001", 2), ("d_0003", "d_0001", 1)]


def test_understanding(spark):
    q = spark.createDataFrame([("How to clean the filter?",), ("Is there a warranty",), ("show picture A_1_2",), ("hello",), (None,)], "t string")
    assert [r.i for r in q.select(U.intent(F.col("t")).alias("i")).collect()] == ["procedure", "legal", "image_trace", "general", "general"]
    assert [r.i for r in q.select(U.routed(F.col("t")).alias("i")).collect()] == [True, False, False, False, False]
    tiers = spark.createDataFrame([("primary",), ("support",), ("big_support",), (None,)], "t string")
    assert [r.o for r in tiers.select(U.recallable(F.col("t")).alias("o")).collect()] == [True, True, False, False]
    routes = U.routes(spark.createDataFrame([(1, "safety", "d"), (2, "image_trace", None)], "query_id long, intent string, doc string"))
    assert sorted(rows(routes, "query_id", "doc"), key=str) == [(1, "d"), (1, None), (2, None)]
    hits = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "query_id long, doc string")
    assert sorted(rows(U.active_documents(hits, hits.filter("doc = 'a'")), "query_id", "doc")) == [(1, "a"), (2, "z")]


def test_retrieval_plan_with_and_without_a_reranker(spark):
    chunks = spark.createDataFrame([("c1", "s", "primary", "replace the water filter"), ("c2", "s", "primary", "clean the filter housing with water"), ("c3", None, "auxiliary", "filter filter filter"), ("c4", None, None, "water filter"), ("s", None, "support", "chapter"), *((f"n{i}", None, "primary", f"other topic {i}") for i in range(20))], "chunk_id string, parent_id string, tier string, text string")
    queries = spark.createDataFrame([(1, "water filter housing")], "query_id long, text string")
    out = P.retrieve(chunks, queries, top_k=2)
    assert sorted(rows(out, "chunk_id", "role", "rank")) == [("c1", "primary", 2), ("c2", "primary", 1), ("s", "support", 1)]
    turned = P.retrieve(chunks, queries, reranker=lambda df: df.select("query_id", "chunk_id", F.when(F.col("chunk_id") == "c1", 1.0).alias("score")), top_k=1)
    assert rows(turned.filter("role = 'primary'"), "chunk_id") == [("c1",)]
    text = P.rendered(out, chunks).first()
    assert text.context.startswith("[1] (primary) clean") and text.answer.count("；") == 2
    lost = P.lost_at(spark.createDataFrame([(1, "c1"), (1, "c3")], "query_id long, chunk_id string"), [("recall", P.recalled(chunks, queries)), ("evidence", out)])
    assert sorted(rows(lost, "chunk_id", "verdict")) == [("c1", "found"), ("c3", "lost_in_recall")]


def test_hooks(spark):
    with pytest.raises(ValueError):
        hooks.rerankers.add("lexical", print)
    assert hooks.rerankers.get("none") is None
    with pytest.raises(KeyError):
        hooks.embedders.get("absent")
    docs = spark.createDataFrame([("1", "Ab  cD"), ("2", None)], "id string, text string")
    assert rows(hooks.tokenized(docs, lambda t: t.split(" ")), "id", "tokens") == [("1", ["ab", "cd"]), ("2", [])]

    def model(texts):
        if any(len(t) > 9 for t in texts):
            raise ValueError("too long")
        return [[float(len(t))] for t in texts]

    long = spark.createDataFrame([("1", "abc"), ("2", "x" * 20), ("3", "  y")], "id string, text string").coalesce(1)
    assert rows(hooks.embedded(long, model, chars=9), "id", "vector", "error") == [("1", [3.0], None), ("2", [9.0], None), ("3", [3.0], None)]
    assert rows(hooks.embedded(long, model, chars=12), "error")[1] == ("too long",)
    assert isinstance(pd.Series([1]), pd.Series)


def column(spark, make, *values):
    """What a column function makes of each text."""
    rows_ = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.o for r in rows_.select("i", make(F.col("t")).alias("o")).orderBy("i").collect()]


def test_router_asks_its_rules_in_order(spark):
    asked = ["订单什么时候配送", "我购买的风扇怎么清洁", "风扇怎么清洁", "Manual7_3 shows what", "the XR20B blinks", "customer service, how to install it", "in the manual, is there a refund", "tell me a story", " ", "can I return the Jet Ski", "jetskis are fast"]
    assert column(spark, U.routed, *asked) == [False, False, True, True, True, False, True, False, False, False, False]
    named = lambda t: U.routed(t, products=["jet ski", "风扇"])
    assert column(spark, named, *asked)[-2:] == [True, False] and column(spark, named, "我购买的风扇") == [True]
    assert column(spark, lambda t: U.routed(t, has_images=F.lit(True)), "story", "") == [True, False]


def test_intents_by_both_cascades(spark):
    asked = ["故障排查", "如何更换滤芯", "指示灯是红色的什么意思", "危险 标签", "保修政策", "AB_1_2", "目录里有哪些内容", "电源接口在哪", "raw text", "where is the port", "nothing"]
    assert column(spark, U.intent, *asked) == ["troubleshooting", "procedure", "general", "general", "legal", "general", "overview", "general", "ocr_audit", "component", "general"]
    assert column(spark, U.older_intent, *asked) == ["troubleshooting", "procedure", "component", "safety", "legal", "image_trace", "overview", "safety", "general", "general", "general"]


def test_variants_synonyms_and_types(spark):
    zh = lambda t: U.variants(t, F.lit("procedure"), F.array(F.lit("滤网"), F.lit("清洗")))
    assert column(spark, zh, " 请问如何清洗滤网是什么 ") == [["请问如何清洗滤网是什么", "清洗滤网", "滤网 清洗", "滤网 清洗 步骤 安装 设置 使用"]]
    trace = lambda t: U.variants(t, F.lit("image_trace"), F.array(F.lit("图")))
    assert column(spark, trace, "AB_1 图", "什么图") == [["AB_1 图", "图", "AB_1", "AB_1 图片 对应"], ["什么图", "图", "图 图片 配图"]]
    assert column(spark, lambda t: U.variants(t, F.lit("legal"), F.array(F.lit("b"), F.lit("a"), F.lit("b"))), "b a b", "x") == [["b a b", "b a"], ["x", "b a"]]
    said = lambda t: U.synonyms(F.split(t, " "))
    assert column(spark, said, "加油 x", "滤清器", " ") == [["加油", "加注", "油箱", "加油操作", "x"], ["滤清器", "清洁", "维护"], []]
    assert column(spark, U.classified_type, "A Warning on the WARRANTY", "press the key", "introduction", "x", None) == ["legal_statement", "operation_guide", "product_overview", "general_info", "general_info"]
    assert column(spark, lambda t: U.classified_type(t, chinese=True), "保修与安全", "规格", "目录 位置", "结构") == ["safety_warning", "specification_table", "product_overview", "component_description"]
    assert column(spark, lambda t: U.classified_type(t, F.array(F.lit("aux_navigation"))), "warranty") == ["aux_navigation"]
    assert column(spark, lambda t: U.classified_type(t, F.array(F.lit("table"), F.lit(""))), "x") == ["specification_table"]
    assert column(spark, lambda t: U.families(t, title=F.lit("更换")), "safety_warning", "odd", "", None) == [["procedure", "safety"], ["procedure"], ["procedure"], ["procedure"]]
    assert column(spark, U.families, "fault_prevention", "odd", "") == [["procedure", "troubleshooting"], ["subsection"], []]


def test_post_filters(spark):
    rows_ = spark.createDataFrame([(1, "OCR page", None, "primary", "x"), (2, "t", ["header_missing"], "primary", "x"), (3, "t", ["header_missing"], "support", "x"), (4, "t", None, None, "x"), (5, "has term", [], None, "legal_clause"), (6, "保修", [], "auxiliary", "x"), (7, "保修", [], "support", "x")], "i int, title string, flags array<string>, tier string, kind string")
    terms = F.array(F.lit("Term"), F.lit("责任"))
    ocr = U.ocr_candidate(terms, F.col("title"), F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("string"), F.col("flags"), F.col("tier"))
    legal = U.legal_candidate(terms, F.col("title"), F.lit("条款"), F.col("kind"), F.col("tier"))
    assert sorted(r.i for r in rows_.filter(ocr).collect()) == [1, 2, 5]
    assert sorted(r.i for r in rows_.filter(legal).collect()) == [5, 7]
    assert [r.n for r in spark.createDataFrame([("ocr_audit",), ("legal",), ("general",)], "t string").select(U.trim_limit(F.col("t")).alias("n")).collect()] == [1, 3, None]


def test_runbook_sections(spark):
    text = "# Disk\n\n## Commands\n\n~~~\n# no heading\n~~~\n### Deep\n\n## Last\nbody"
    out = list(C.runbook_rows("a/b/disk full.md", text))
    assert [(r[3], r[2]) for r in out] == [(["Disk", "Commands"], "Commands"), (["Disk", "Last"], "Last")]
    assert (out[0][4], out[0][5]) == (3, 7) and out[0][6].startswith("文档：Disk\n章节：Disk > Commands\n\n## Commands") and "# no heading" in out[0][6]
    assert [r[6] for r in C.runbook_rows("x/plain.md", "only text")] == ["文档：plain\n章节：plain\n\nonly text"]
    long = list(C.runbook_rows("m.md", "# M\n\n## R\n\n" + "ab " * 900, chars=240))
    assert len(long) > 1 and all(len(r[6]) <= 240 for r in long) and "".join(r[6].partition("\n\n")[2] for r in long).replace(" ", "").endswith("ab")
    assert C.packed_paragraphs("a\n\nbb\n \ncccccc\n\nd", 5) == ["a\n\nbb", "ccccc", "c", "d"]


def test_staged_and_older_support(spark):
    chunks = spark.createDataFrame([("a", "s1", "primary", "part one", "component_description"), ("b", "s2", "primary", "one two", "safety_warning"), ("s1", None, "support", "one head", "product_overview"), ("s2", None, "support", "other", "product_overview")], "chunk_id string, parent_id string, tier string, text string, kind string")
    asked = spark.createDataFrame([(1, "one"), (2, "ocr one")], "query_id long, text string")
    hits = spark.createDataFrame([(1, "a", 1.0), (1, "s1", 0.0), (2, "b", 1.0)], "query_id long, chunk_id string, score double")
    got = {(r.query_id, r.chunk_id): (r.stage, r.rank) for r in P.staged(hits, chunks, asked).collect()}
    assert got == {(1, "s1"): (2, 1), (1, "a"): (2, 2)}
    found = spark.createDataFrame([(1, "a", "s1", "primary", 1), (1, "b", "s2", "primary", 2), (2, "a", "s1", "primary", 1)], "query_id long, chunk_id string, parent_id string, tier string, rank long")
    state = P.analyzed(asked).withColumn("intent", U.older_intent(F.col("text")))
    assert sorted(rows(P.older_support(found, chunks, state), "query_id", "chunk_id", "rank")) == [(1, "s1", 1), (1, "s2", 2)]
