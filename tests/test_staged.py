"""Gated rounds: which stage answers, what a search may see, and that strong questions stop."""

import random

from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.operators import scan
from tessera.operators import understand as U
from tessera.plans import retrieve as P
from tessera.plans import staged as S

WORDS = "hydraulic pressure calibration valve"


def chunks(spark):
    rows = [
        (1, "primary", "hydraulic pressure calibration valve manual", "Hydraulic pressure calibration valve"), (2, "support", "overview of hydraulic pressure calibration valve", "Overview"),
        (3, "auxiliary", "zebra stripes", "Zebra"), (4, "primary", "nothing here at all", "Other"), (5, "support", "giraffe necks are long giraffe", "Giraffe neck"),
    ]
    return spark.createDataFrame(rows, "chunk_id long, tier string, text string, title string")


def run(spark, asked, search=S.bm25_search, top_k=4):
    queries = spark.createDataFrame(asked, "query_id string, text string")
    return {(r.query_id, r.chunk_id): (r.stage, r["rank"]) for r in S.staged_search(chunks(spark), queries, search, top_k).collect()}


def test_strong_questions_stop_and_weak_ones_go_on(spark):
    seen = []

    def search(rows, questions, keep, fetch):
        seen.append({q.split('"')[3] for q in (r.query_id for r in questions.collect())})
        return S.bm25_search(rows, questions, keep, fetch)

    got = run(spark, [("strong", WORDS), ("support", "giraffe"), ("aside", "zebra")], search)
    assert got[("strong", 1)] == (1, 1) and ("strong", 2) not in got
    assert got[("support", 5)][0] == 2 and got[("aside", 3)] == (0, 1)
    assert seen[0] == {"strong", "support", "aside"} and "strong" not in seen[1]


def test_no_rows_and_no_questions(spark):
    assert run(spark, [("q", "qqqqq")]) == {}
    assert run(spark, []) == {}
    assert run(spark, [("q", None), ("e", "")]) == {}


def test_a_filter_acts_before_the_best_are_taken(spark):
    docs = chunks(spark)
    asked = spark.createDataFrame([("q", WORDS)], "query_id string, text string")
    own = docs.filter("tier = 'support'").select("chunk_id")
    kept = R.bm25_hits(docs, asked, "chunk_id", "text", "query_id", "text", 1, keep=lambda pairs: pairs.join(own, "chunk_id", "left_semi")).collect()
    assert [(r.chunk_id, r["rank"]) for r in kept] == [(2, 1)]


def nothing_found(rows, questions, keep, fetch):
    return rows.limit(0).select(F.lit("").alias("query_id"), "chunk_id", F.lit(0.0).alias("score"))


def test_the_scan_scores_every_chunk_by_its_relevance(spark):
    """Chunk 99 has the best X17 by its title, and by X18 the fewest points of all."""
    rows = [(i, "primary", "hydraulic calibration of a gasket", "Other") for i in range(40)] + [(99, "primary", "see the hydraulic table", "Hydraulic calibration gasket"), (98, "primary", "no words", "Gasket calibration hydraulic")]
    docs = spark.createDataFrame(rows, "chunk_id long, tier string, text string, title string")
    asked = spark.createDataFrame([("q", "hydraulic calibration gasket")], "query_id string, text string")
    got = {r.chunk_id: r["rank"] for r in S.staged_search(docs, asked, nothing_found).collect()}
    assert got == {99: 1, 98: 2, 0: 3, 1: 4}


def test_the_scan_leaves_what_the_search_found_its_own_score(spark):
    """All that two variants find, 24 rows, stays found: the scan finds the last twelve again and would give them 10 points."""
    docs = spark.createDataFrame([(i, "primary", "the giraffe") for i in range(30)], "chunk_id long, tier string, text string")
    asked = spark.createDataFrame([("q", "the giraffe")], "query_id string, text string")

    def search(rows, questions, keep, fetch):
        part = F.get_json_object("query_id", "$.variant").cast("int")
        pairs = questions.crossJoin(rows.filter("chunk_id < 24").select("chunk_id"))
        return pairs.filter((F.col("chunk_id") < 12).cast("int") == part).select("query_id", "chunk_id", (98.0 + part).alias("score"))

    got = {(r.chunk_id, r.stage, r.lexical, r["rank"]) for r in S.staged_search(docs, asked, search).collect()}
    assert got == {(c, 2, 8.10101, c - 11) for c in range(12, 16)}


def with_terms(queries):
    asked = P.analyzed(queries).withColumn("intent", U.older_intent(F.col("text")))
    return asked.withColumns({"variants": U.variants(F.col("text"), F.col("intent"), F.col("terms")), "critical": F.size(U.critical_groups(F.col("text"))) > 0})


QUESTIONS = [
    "how does the ocr scanner read blue paper", "ocr 缺失 paper", "warranty 保修 blue", "保修 gone paper", "警告 blue light", "故障 red light", "怎么 安装 filter", "red 按钮", "目录 filter", "fig_2_a 图片 blue", "abc_7", "pump blue paper red",
    "冷机 加油 pump", "燃油 混合", "标签 pump", "安全", "防护装备", "what is the", "?!", "", "  ", None, "Blue BLUE blue-paper", "qqqqq zzzzz", "状态 指示灯 red", "is the pump red 注意",
]
WORDS_OF = ["blue", "Red", "paper", "pump", "filter", "light", "ocr", "保修", "安全", "故障", "安装", "按钮", "目录", "加注", "油箱", "1:50", "标签", "冷机", "fig_2_a", "识别", "部件", "the", "\u00a0", "\n"]


def odd_chunks(spark, n, seed):
    made = random.Random(seed)
    some = lambda k, empty: None if made.random() < empty else " ".join(made.choices(WORDS_OF, k=made.randint(0, k)))
    kinds = [None, "", "legal_clause", "metadata_image_path", "safety_warning", "assembly_steps", "product_overview", "parts_list", "odd"]
    rows = []
    for i in range(n):
        pics, flags = (made.choice([None, [], [v], [v, None]]) for v in (made.choice(["fig_2_a", "ABC_7"]), made.choice(["ocr_corruption", "other"])))
        rows.append((i, made.choice(["primary", "support", "auxiliary", None]), some(12, 0.1), some(3, 0.3), some(2, 0.5), some(3, 0.5), made.choice(kinds), pics, flags, some(1, 0.7)))
    return spark.createDataFrame(rows, "chunk_id long, tier string, text string, title string, section string, index_text string, kind string, pic_ids array<string>, flags array<string>, note string")


def brute_scan(docs, asked, prefer, k):
    """Every pair scored by X17 and filtered by F5."""
    pairs = asked.crossJoin(docs.select("chunk_id")).select("query_id", "chunk_id", F.lit(0.0).alias("score"))
    scored = S._post_filter(P.lexical_scores(pairs, docs, asked, F.lit(prefer)), docs, asked)
    joined = scored.join(docs, "chunk_id").join(asked.select("query_id", F.col("text").alias("q"), "terms"), "query_id").collect()
    norm = lambda t: "".join((t or "").split()).lower()
    best = {}
    for r in joined:
        fields = [norm(t) for t in (r.title, r.section, r.index_text, r.text, " ".join(p for p in r.pic_ids or [] if p), r.note)]
        met = not r.terms or any(norm(t) in f for t in r.terms for f in fields)
        if norm(r.q) and (met or r.lexical > 0):
            best.setdefault(r.query_id, []).append((-r.lexical, r.chunk_id))
    return {(q, c, -v, n) for q, found in best.items() for n, (v, c) in enumerate(sorted(found)[:k], 1)}


def test_the_scan_is_the_rule_over_all_pairs(spark):
    docs = odd_chunks(spark, 160, 7).repartition(3)
    asked = with_terms(spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id long, text string"))
    assert {r.intent for r in asked.collect()} == {"general", *U.OLDER_WORDS}
    for prefer, k in ((False, 5), (True, 12), (False, 1000)):
        got = [(r.query_id, r.chunk_id, r.score, r["rank"]) for r in scan.relevant_hits(docs, asked, prefer, k).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_scan(docs, asked, prefer, k)
    assert scan.relevant_hits(docs.limit(0), asked, False, 5).count() == scan.relevant_hits(docs, asked.limit(0), False, 5).count() == 0


def test_the_scan_takes_questions_by_blocks(spark, monkeypatch):
    docs = odd_chunks(spark, 40, 8)
    asked = with_terms(spark.createDataFrame(list(enumerate(QUESTIONS[::4])), "query_id long, text string"))
    ask = lambda: sorted(map(tuple, scan.relevant_hits(docs, asked, True, 6).collect()))
    whole = ask()
    monkeypatch.setattr(R.blockwise, "__defaults__", (3,))
    monkeypatch.setattr(R, "SCORE_ROWS", 7)
    assert ask() == whole
