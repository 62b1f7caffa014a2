"""The registered queries over the driver's tables, one for each operator.

Each is whole-table: no ids are picked out and no rows are capped, but for the
k of a top-k, which is the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import chunking as C
from tessera.operators import evaluate as E
from tessera.operators import hierarchy as H
from tessera.operators import ingest as I
from tessera.operators import memory as M
from tessera.operators import ops as O
from tessera.operators import retrieval as R
from tessera.operators import support as S
from tessera.operators import trees as T
from tessera.operators import understand as U
from tessera.operators import vectors as V
from tessera.plans import retrieve as P
from tessera.plans.staged import staged_search
from tessera.sources.files import changed_states, quarantine_split
from tessera.sources.store import stored

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- text -------------------------------------------------------------------


@query
def x01_normalize(spark, sf):
    n = X.normalize_text(F.coalesce("text", F.lit("")))
    return _t(spark, sf, "documents").select("doc_id", F.length(n).cast("long").alias("n"), F.md5(n.cast("binary")).alias("digest"))


@query
def x02_language(spark, sf):
    docs = _t(spark, sf, "documents")
    return docs.groupBy(X.detect_language(F.col("text")).alias("detected"), F.coalesce(X.normalize_language(F.col("lang")), F.lit("none")).alias("normalized")).agg(F.count("*").alias("n"))


@query
def x04_tokens(spark, sf):
    t = X.english_tokens(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ").cast("binary")).alias("digest"))


@query
def x05_index_tokens(spark, sf):
    t = X.index_tokens(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ").cast("binary")).alias("digest"))


@query
def x07_query_terms(spark, sf):
    return _t(spark, sf, "benchmark").select("item_id", F.array_join(X.query_terms(F.col("text")), " ").alias("terms"))


@query
def x20_markdown_text(spark, sf):
    plain = X.markdown_to_index_text(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", F.length(plain).cast("long").alias("n"), F.md5(plain.cast("binary")).alias("digest"))


@query
def x23_dedupe_lines(spark, sf):
    lines = X.dedupe_lines(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", F.length(lines).cast("long").alias("n"), F.md5(lines.cast("binary")).alias("digest"))


@query
def x24_sentences(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n"), X.head_sentences(F.col("text")).alias("head"), X.tail_sentences(F.col("text")).alias("tail"))


@query
def x26_alnum(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.md5(X.alnum(F.coalesce("text", F.lit(""))).cast("binary")).alias("digest"))


@query
def x28_clip(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", X.clip(F.col("text"), 180).alias("clipped"))


@query
def x30_chunk_keys(spark, sf):
    return _t(spark, sf, "pages").select("page_id", X.chunk_key(F.concat("url", F.lit("#"), F.repeat(F.lit("x"), F.pmod("page_id", F.lit(120)).cast("int")))).alias("key"), F.sha2("url", 256).alias("user_dir"))


@query
def p07_utf8_truncate(spark, sf):
    cut = X.utf8_truncate(F.coalesce("text", F.lit("")), 200)
    return _t(spark, sf, "documents").select("doc_id", F.octet_length(cut).cast("long").alias("n_bytes"), cut.alias("cut"))


# --- retrieval --------------------------------------------------------------


def _bm25(spark, sf, k=10):
    """Written once, a few rows a question: some queries read it several times."""
    return stored(R.bm25_hits(_t(spark, sf, "documents"), _t(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text", k), "bm25")


def _scan(spark, sf, k=10):
    """Whole tokens only, as the SQL of the queries has it; r04_whole_scan has containment."""
    return stored(R.token_scan_hits(_t(spark, sf, "documents"), _t(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text", k), "scan")


@query
def t01_bm25(spark, sf):
    return _bm25(spark, sf)


@query
def a06_term_statistics(spark, sf):
    docs = _t(spark, sf, "documents")
    stats = R.collection_statistics(docs, "text")
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def r01_cosine(spark, sf):
    """The query set is every vector whose id 100 divides; the corpus is every vector."""
    v = _t(spark, sf, "embeddings")
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return R.cosine_hits(asked, v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")))


@query
def f01_filtered_cosine(spark, sf):
    v = _t(spark, sf, "embeddings")
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    corpus = v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"), "label")
    return R.cosine_hits(asked, corpus, 3, R.metadata_filter({"label": [0, 1, 2]}))


def _indexed(spark, sf, k, metadata=None):
    v = _t(spark, sf, "embeddings")
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return V.search(V.build_index(v, "vec_id", "embedding", ["label"]), asked, k, metadata)


@query
def r01_indexed_cosine(spark, sf):
    """The questions and rows of r01_cosine by cells; a few in a hundred of its rows may be missed."""
    return _indexed(spark, sf, 5)


@query
def f01_indexed_cosine(spark, sf):
    """The filter is applied inside the search: every question gets three rows if there are three."""
    return _indexed(spark, sf, 3, R.metadata_filter({"label": [0, 1, 2]}))


@query
def r04_scan(spark, sf):
    return _scan(spark, sf)


@query
def r04_whole_scan(spark, sf):
    return R.scan_hits(_t(spark, sf, "documents"), _t(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text")


def _channels(spark, sf, bm25=None):
    return (bm25 or _bm25(spark, sf)).withColumn("channel", F.lit("bm25")).unionByName(_scan(spark, sf).withColumn("channel", F.lit("scan")))


@query
def w01_normalized(spark, sf):
    return R.normalized(_channels(spark, sf)).select("query_id", "chunk_id", "channel", "rank", F.round("norm", 6).alias("norm"))


@query
def j01_fused(spark, sf):
    out = R.fused(R.normalized(_channels(spark, sf)))
    return out.select("query_id", "chunk_id", "merged_score", F.array_join("channels", "+").alias("channels"), "rank")


@query
def j11_rank_changes(spark, sf):
    hits = _bm25(spark, sf)
    return R.rank_changes(hits, R.fused(R.normalized(_channels(spark, sf, hits))))


@query
def j12_completed(spark, sf):
    return R.completed(_scan(spark, sf, 3), _bm25(spark, sf))


def _doc_chunks(spark, sf):
    """Documents as primary chunks, titled by their source."""
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit("primary").alias("tier"), "text", F.col("source").alias("title"))


def _questions(spark, sf):
    return _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query
def r05_scan_needed(spark, sf):
    return P.weak_queries(_bm25(spark, sf).withColumn("channel", F.lit("bm25")), _doc_chunks(spark, sf), P.analyzed(_questions(spark, sf)))


@query
def t03_lexical_order(spark, sf):
    asked = P.analyzed(_questions(spark, sf)).withColumn("intent", U.older_intent(F.col("text")))
    return P.lexical_order(_bm25(spark, sf), _doc_chunks(spark, sf), asked)


@query
def f16_filtered_rank(spark, sf):
    hits = _bm25(spark, sf)
    return R.filtered_rank(hits, _t(spark, sf, "documents").withColumnRenamed("doc_id", "chunk_id"), hits, R.metadata_filter({"lang": ["en", "es"]}))


@query
def t06_fetch_limits(spark, sf):
    return _t(spark, sf, "benchmark").select("item_id", R.fetch_limit(F.col("item_id")).cast("long").alias("fetch"))


@query
def p10_api_metadata(spark, sf):
    """Metadata of documents with trace keys at three depths, as columns and as JSON text."""
    deep = F.struct(F.lit("s").alias("session_id"), F.coalesce("n_chars", F.lit(0)).alias("score"))
    hit = F.struct(F.col("doc_id").alias("chunk_id"), F.lit("t").alias("trace"), deep.alias("deep"))
    fields = [F.coalesce("lang", F.lit("none")).alias("intent"), F.array(hit).alias("top_hits"), F.array(F.lit("w")).alias("warnings"), F.lit("gone").alias("evidence")]
    rows = _t(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), *fields)
    typed = I.api_metadata(rows)
    as_json = rows.select(F.col("query_id").alias("doc_id"), I.api_metadata_json(F.to_json(F.struct(*rows.columns))).alias("untyped"))
    return as_json.join(typed.select(F.col("query_id").alias("doc_id"), F.to_json(F.struct(*typed.columns[1:])).alias("typed")), "doc_id")


def _evidence(spark, sf):
    ranking = _bm25(spark, sf, 3).withColumn("role", F.lit("primary"))
    pics = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.array(F.concat(F.lit("p"), "doc_id")))
    return I.evidence_hits(ranking, _t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), "text", pics.alias("pic_ids")))


@query
def p08_evidence(spark, sf):
    return _evidence(spark, sf).select("query_id", "rank", "role", "chunk_id", "doc_id", "score", "text")


@query
def p09_hit_summaries(spark, sf):
    return I.hit_summaries(_evidence(spark, sf)).select("query_id", F.array_join(F.transform("hits", lambda h: h["chunk_id"].cast("string")), ",").alias("chunks"), "with_images")


@query
def a11_evidence(spark, sf):
    pics = F.array(F.concat(F.lit("p"), F.pmod("chunk_id", F.lit(10))))
    hits = _bm25(spark, sf).withColumn("role", F.lit("primary")).withColumn("pic_ids", pics)
    wanted = F.when(F.pmod("query_id", F.lit(2)) == 1, F.array(F.concat(F.lit("p"), F.pmod("query_id", F.lit(10)))))
    cases = _questions(spark, sf).select("query_id", U.intent(F.col("text")).alias("intent"), U.older_intent(F.col("text")).alias("said_intent"), F.array(7 * F.col("query_id")).alias("expected"), wanted.alias("expected_pics"))
    return E.evidence_evaluation(cases, hits)


@query
def j15_summary_scores(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("source").alias("doc"), F.col("source").alias("name"), F.col("lang").alias("kind"), "text")
    return E.summary_scores(_questions(spark, sf), E.profile_summaries(E.document_profiles(docs))).withColumn("matched", F.array_join("matched", " "))


@query
def s14_collection_scan(spark, sf):
    return I.collection_scan(_t(spark, sf, "documents"), {"lang": ["en", "fr"]}).select(F.col("doc_id").alias("chunk_id"), "lang", "score")


@query
def s15_bounded_scan(spark, sf):
    return I.bounded_scan(_t(spark, sf, "documents"), {"lang": ["de"]}, 100, "doc_id").select(F.col("doc_id").alias("chunk_id"), "lang", "score")


@query
def p04_doc_names(spark, sf):
    n = lambda m: F.pmod("page_id", F.lit(m))
    named, known = F.when(n(5) == 0, " named "), F.when(n(3) == 0, F.concat(F.lit("id"), "page_id"))
    folder = F.when(n(2) == 0, F.concat(F.lit("m01__suffix"), n(7))).otherwise("m01")
    path = F.concat(F.lit("data/"), folder, F.lit("/"), F.regexp_extract("url", "([^/]*)/?$", 1))
    return _t(spark, sf, "pages").select("page_id", I.doc_name(named, known, path).alias("name"))


@query
def p05_paths(spark, sf):
    page, n = F.col("page_id").cast("string"), F.pmod("page_id", F.lit(3))
    raw = F.when(n == 0, F.concat(F.lit(" C:\\x\\data\\\\"), page, F.lit("//a.md "))).when(n == 1, F.concat(F.lit("/srv//docs/x"), page)).otherwise(F.concat(F.lit("//plain/"), page))
    return _t(spark, sf, "pages").select("page_id", I.portable_path(raw).alias("path"))


@query
def p06_budgeted(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id", "lang", F.col("text").alias("index_text"), "text", F.split("text", " ").alias("words"))
    cut = I.budgeted(rows, ["lang", "index_text", "text", "words"], 6_000, 500)
    return cut.select("doc_id", F.octet_length("index_text").cast("long").alias("index_bytes"), F.octet_length("text").cast("long").alias("text_bytes"))


@query
def p11_rerank_text(spark, sf):
    n = F.pmod("doc_id", F.lit(3))
    index, content = F.when(n == 0, F.concat(F.lit(" "), "lang")).when(n == 1, F.lit("  ")), F.when(n == 1, F.col("source"))
    return _t(spark, sf, "documents").select("doc_id", I.rerank_text(index, content, F.concat_ws("-", "lang", "source")).alias("said"))


@query
def p12_index_text(spark, sf):
    one = lambda c: F.array(F.col(c))
    text = I.index_text([one("text"), one("text"), one("lang"), F.array("source", "lang"), F.array(F.lit(None).cast("string"), F.concat(F.lit("k"), "doc_id"))])
    return _t(spark, sf, "documents").select("doc_id", F.md5(text.cast("binary")).alias("digest"))


@query
def s19_regions(spark, sf):
    name = F.when(F.col("r_regionkey") == 0, "北京").when(F.col("r_regionkey") == 1, "中国香港").otherwise(F.col("r_name"))
    return O.region_lookup(_t(spark, sf, "region").select("r_regionkey", name.alias("region_name"))).select("r_regionkey", "region_code", "available")


@query
def a13_judge(spark, sf):
    rows = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id")
    asked = rows.select(F.col("doc_id").alias("question_id"), F.col("lang").alias("question_type"))
    said = F.when(F.col("quality") != 1, "maybe").when(F.col("toxic") == 1, " Yes.").when(F.col("toxic") == 0, "no")
    return E.judge_accuracy(asked, rows.select(F.col("doc_id").alias("question_id"), said.alias("label")))


@query
def f15_cases(spark, sf):
    even = _t(spark, sf, "benchmark").filter("item_id % 2 = 0")
    return E.case_subset(even, None, 3, 10, "item_id").select("item_id")


@query
def e07_replay(spark, sf):
    part = _t(spark, sf, "part")
    tool, args = F.when(F.col("p_size") % 2 == 0, "GetAlerts").otherwise("GetResources"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("name"), F.lit(""))
    cached = part.select(F.format_string("%08d", "p_partkey").alias("key"), tool.alias("tool"), args.alias("args"), F.col("p_name").alias("output"))
    return O.replayed(part.select(F.col("p_partkey").alias("call_id"), tool.alias("tool"), args.alias("args")), cached).select("call_id", "tool", "matched_key")


@query
def k13_states(spark, sf):
    events = _t(spark, sf, "events")
    first = events.groupBy(F.col("user_id").alias("session_id")).agg(F.min("event_type").alias("goal"), F.count("*").alias("n"))
    new = first.select("session_id", F.when(F.col("n") > 1, "busy").otherwise(F.col("goal")).alias("goal"), F.lit(2).cast("long").alias("updated_at"))
    return changed_states(first.select("session_id", "goal", F.lit(1).cast("long").alias("updated_at")), new)


@query
def r12_staged(spark, sf):
    chunks = _t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.when(F.pmod("doc_id", F.lit(4)) == 0, "support").otherwise("primary").alias("tier"), "text", F.col("source").alias("title"), U.classified_type(F.col("text")).alias("kind"))
    return staged_search(chunks, _questions(spark, sf))


@query
def r03_route_order(spark, sf):
    routes = _scan(spark, sf, 5).withColumn("route", F.lit(0)).unionByName(_bm25(spark, sf, 5).withColumn("route", F.lit(1)))
    return R.route_order_cut(routes, 8).select("query_id", "chunk_id", "route", "place")


@query
def a03_noisy_or(spark, sf):
    """Channels as sources of evidence: each query's candidates, scores as probabilities."""
    rows = R.normalized(_channels(spark, sf)).select("query_id", F.col("chunk_id").alias("label"), F.col("channel").alias("source"), F.round(F.col("norm") * 0.9, 4).alias("score"), "rank")
    out = R.merged_candidates(rows.withColumn("pos", F.when(F.col("source") == "bm25", 0).otherwise(1)))
    return out.select("query_id", "label", "score", "sources", "rank", "strong")


@query
def a04_deduped_terms(spark, sf):
    terms = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(F.split("text", " ")).alias("pos", "term"))
    weighted = terms.withColumn("weight", F.length("term").cast("double"))
    return R.deduped_terms(weighted).select("query_id", "key", "term", "weight", "rank")


@query
def a05_profiles(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("source").alias("doc"), F.col("source").alias("name"), F.col("lang").alias("kind"), "text")
    out = E.document_profiles(docs)
    return out.select("doc", "name", "chunks", F.array_join("kinds", ",").alias("kinds"), F.array_join("terms", " ").alias("terms"))


@query
def j14_profile_scores(spark, sf):
    """Shared whole terms only, as the SQL of this query has it; j14_whole_profile_scores is the whole rule."""
    docs = _t(spark, sf, "documents").select(F.col("source").alias("doc"), F.col("source").alias("name"), F.col("lang").alias("kind"), "text")
    asked = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return E.shared_term_scores(asked, E.document_profiles(docs))


@query
def j14_whole_profile_scores(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("source").alias("doc"), F.col("source").alias("name"), F.col("lang").alias("kind"), "text")
    asked = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return E.profile_scores(asked, E.document_profiles(docs))


@query
def x13_intents(spark, sf):
    docs = _t(spark, sf, "documents")
    return docs.groupBy(U.intent(F.col("text")).alias("intent"), U.older_intent(F.col("text")).alias("older")).agg(F.count("*").alias("n"))


@query
def f12_routed(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", U.routed(F.col("text")).alias("routed"))


@query
def x10_variants(spark, sf):
    terms = X.query_terms(F.col("text"))
    return _t(spark, sf, "benchmark").select("item_id", F.array_join(U.variants(F.col("text"), U.older_intent(F.col("text")), terms), "|").alias("variants"))


@query
def x25_types(spark, sf):
    return _t(spark, sf, "documents").groupBy("lang", U.classified_type(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query
def x15_families(spark, sf):
    kinds = _t(spark, sf, "documents").select("text", U.classified_type(F.col("text")).alias("kind"))
    return kinds.groupBy(F.array_join(U.families(F.col("kind"), text=F.col("text")), ",").alias("families")).agg(F.count("*").alias("n"))


@query
def x21_answer_text(spark, sf):
    plain = X.markdown_to_answer(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", F.length(plain).cast("long").alias("n"), F.md5(plain.cast("binary")).alias("digest"))


@query
def x31_settings(spark, sf):
    kind, n = F.col("event_type"), F.pmod("event_id", F.lit(2))
    flag = F.when(kind == "click", " Yes ").when(kind == "view", "off").otherwise(F.when(n == 0, "1").otherwise("0"))
    amount = F.when(F.pmod("event_id", F.lit(3)) == 0, "none").otherwise(F.col("value").cast("string"))
    return _t(spark, sf, "events").select("event_id", X.to_bool(flag, True).alias("flag"), X.to_int(F.get_json_object("props", "$.k"), -1).alias("number"), X.to_float(amount, 0.5).alias("amount"))


@query
def x32_index_text(spark, sf):
    made = X.placed_index_text(F.array("source", "lang"), F.col("source"), F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", F.md5(made.cast("binary")).alias("digest"))


@query
def r14_retrieve(spark, sf):
    """Chunks are documents under one support chunk a source, questions are benchmark items; a vector's id is that of a document, or of a question.

    Three channels, the lexical order, and the evidence with its support chunks.
    """
    docs = _t(spark, sf, "documents")
    chunks = docs.select(F.concat(F.lit("d"), "doc_id").alias("chunk_id"), F.concat(F.lit("s-"), "source").alias("parent_id"), F.lit("primary").alias("tier"), "text")
    heads = docs.groupBy("source").agg(F.count("*").alias("n")).select(F.concat(F.lit("s-"), "source").alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("support").alias("tier"), F.concat(F.lit("documents of "), "source").alias("text"))
    v = _t(spark, sf, "embeddings")
    asked = v.join(_t(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    vectors = R.cosine_hits(asked, v.select(F.concat(F.lit("d"), "vec_id").alias("chunk_id"), F.col("embedding").alias("v")), R.fetch_limit())
    return P.retrieve(chunks.unionByName(heads), _questions(spark, sf), vectors, "lexical")


# --- chunking ---------------------------------------------------------------


def _text_rows(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", "text")


@query
def h01_runbook_chunks(spark, sf):
    return C.chunked(_text_rows(spark, sf), C.runbook_rows)


@query
def h02_header_chunks(spark, sf):
    return C.chunked(_text_rows(spark, sf), C.header_rows)


@query
def h04_window_chunks(spark, sf):
    return C.chunked(_text_rows(spark, sf), C.window_rows)


@query
def h07_integrated(spark, sf):
    chunks = C.chunked(_text_rows(spark, sf), C.window_rows)
    rows = chunks.select(F.col("doc_id").alias("doc"), F.col("chunk_index").alias("pos"), "chunk_id", F.lit(None).cast("string").alias("parent_id"), F.lit("primary").alias("tier"), "text")
    return C.integrated(rows)


@query
def h08_merged_tree(spark, sf):
    """Documents over windows of lines over smaller windows."""
    return T.merged_tree(T.window_forest(_text_rows(spark, sf)))


@query
def h09_completed_sections(spark, sf):
    """Two lines of a document are a piece, three pieces a part that no chunk stands for."""
    docs = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc"), "text", F.split(F.coalesce("text", F.lit("")), "\r\n|\n|\r").alias("lines"))
    pieces = docs.select("doc", "lines", F.explode(F.sequence(F.lit(0), F.expr("cast((size(lines) - 1) div 2 AS int)"))).alias("i"))
    first, last = 2 * F.col("i") + 1, F.least(2 * F.col("i") + 2, F.size("lines"))
    path = F.array(F.format_string("part %d", F.expr("i div 3")), F.format_string("piece %d", "i"))
    chunks = pieces.select("doc", F.col("i").alias("pos"), F.format_string("%s:%d", "doc", "i").alias("chunk_id"), F.lit("primary").alias("tier"), path.alias("path"), first.alias("first_line"), last.alias("last_line"), S.line_slice(F.col("lines"), first, last).alias("text"), F.array().cast("array<string>").alias("pic_ids"))
    out = S.completed_sections(chunks, docs.select("doc", "text"))
    return out.select("doc", "chunk_id", "parent_id", "tier", "first_line", "last_line", "synthetic", F.md5(F.col("text").cast("binary")).alias("digest"))


# --- hierarchy: region, nation, customer and supplier as a forest -----------


def _tree(spark, sf):
    """region (big_support) over nation (support) over customer and supplier (primary)."""
    region = _t(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("big_support").alias("tier"), F.col("r_regionkey").cast("long").alias("pos"))
    nation = _t(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("chunk_id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent_id"), F.lit("support").alias("tier"), F.col("n_nationkey").cast("long").alias("pos"))
    customer = _t(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("chunk_id"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent_id"), F.lit("primary").alias("tier"), F.col("c_custkey").cast("long").alias("pos"))
    supplier = _t(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("chunk_id"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("parent_id"), F.lit("primary").alias("tier"), F.col("s_suppkey").cast("long").alias("pos"))
    return region.unionAll(nation).unionAll(customer).unionAll(supplier)


def _customer_hits(spark, sf):
    """Orders as queries by year: customers ranked by what they spent."""
    orders = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    spent = orders.groupBy(F.year("o_orderdate").cast("long").alias("query_id"), "c_custkey", "c_nationkey").agg(F.round(F.sum("o_totalprice"), 2).alias("score"))
    rows = spent.select("query_id", F.concat(F.lit("c"), "c_custkey").alias("chunk_id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.lit("primary").alias("tier"), "score")
    return R.ranked(rows, [F.desc("score"), F.asc("chunk_id")]).filter("rank <= 20")


@query
def j02_parents(spark, sf):
    return H.parent_rows(_customer_hits(spark, sf), _tree(spark, sf))


@query
def j03_support_context(spark, sf):
    hits = _customer_hits(spark, sf)
    return H.support_context(H.parent_rows(hits, _tree(spark, sf)), hits).select("query_id", "parent_id", "rank")


@query
def j04_children(spark, sf):
    parents = _tree(spark, sf).filter("tier = 'big_support'").select(F.col("chunk_id").alias("parent_id"))
    return H.children(_tree(spark, sf), parents).select("parent_id", "chunk_id", "tier")


@query
def j05_descendants(spark, sf):
    tree = _tree(spark, sf)
    return H.descendants(tree, tree.filter("parent_id IS NULL"))


@query
def j06_best_per_parent(spark, sf):
    rows = _t(spark, sf, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.concat(F.lit("c"), "c_custkey").alias("chunk_id"), F.col("c_acctbal").alias("score"))
    return H.best_per_parent(rows)


@query
def w09_siblings(spark, sf):
    return H.sibling_context(_tree(spark, sf).filter("tier <> 'big_support'"))


@query
def w10_renumbered(spark, sf):
    rows = _tree(spark, sf).withColumn("doc", F.substring("chunk_id", 1, 1))
    return H.renumbered(rows).select("chunk_id", "new_id", "new_parent")


@query
def h11_violations(spark, sf):
    return H.violations(_tree(spark, sf))


def _paths(spark, sf):
    return _t(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("doc"), F.filter(F.split(F.regexp_replace("url", "^[a-z]+://[^/]+/?", ""), "/"), lambda p: p != "").alias("path")).filter("size(path) > 0")


@query
def u06_missing_prefixes(spark, sf):
    return H.missing_prefixes(_paths(spark, sf)).select("doc", F.array_join("path", "/").alias("path"))


@query
def j20_nearest_ancestor(spark, sf):
    return H.nearest_ancestor(_paths(spark, sf)).select("doc", F.array_join("path", "/").alias("path"), F.coalesce(F.array_join("ancestor", "/"), F.lit("")).alias("ancestor"))


@query
def a16_tier_depth(spark, sf):
    rows = _tree(spark, sf).withColumn("path", F.when(F.col("tier") == "big_support", F.array("chunk_id")).when(F.col("tier") == "support", F.array("parent_id", "chunk_id")).otherwise(F.array(F.lit("r"), "parent_id", "chunk_id")))
    return H.tier_depth_profile(rows).select("tier", F.col("depth").cast("long").alias("depth"), "n", "with_parent")


# --- logs and metrics -------------------------------------------------------


def _series(spark, sf):
    return _t(spark, sf, "events").select(F.col("event_type").alias("series"), F.col("event_id").alias("ordinal"), "value")


@query
def a08_metric_summary(spark, sf):
    return O.metric_summary(_series(spark, sf))


@query
def s20_thresholds(spark, sf):
    metric = F.when(F.col("event_type") == "view", "cpu").when(F.col("event_type") == "click", "memory").otherwise("none")
    return O.above_thresholds(_t(spark, sf, "events").select("event_id", metric.alias("metric"), "value")).select("event_id", "value", "alert")


@query
def s17_log_search(spark, sf):
    logs = _t(spark, sf, "events").select("event_id", "ts", F.concat_ws(" ", "event_type", "props").alias("message"))
    edges = logs.agg(F.min("ts"), F.max("ts")).first()
    return O.log_search(logs, F.lit(edges[0]), F.lit(edges[1]), "error", 50)


@query
def p13_log_rows(spark, sf):
    props = F.from_json("props", "map<string,string>")
    return _t(spark, sf, "events").select("event_id", F.coalesce(props["message"], props["k"], F.lit("")).alias("message"), F.upper("event_type").alias("level"))


@query
def s18_topics(spark, sf):
    topics = _t(spark, sf, "nation").select("n_name")
    asked = _t(spark, sf, "region").select("r_regionkey", F.when(F.col("r_regionkey") == 0, "a").otherwise(F.col("r_name")).alias("asked"))
    return O.fuzzy_lookup(topics, asked, "n_name", "asked").select("r_regionkey", "n_name")


@query
def j16_arguments(spark, sf):
    part = _t(spark, sf, "part")
    cached = part.select(F.concat(F.col("p_type"), F.lit(":"), F.format_string("%08d", F.col("p_partkey"))).alias("key"), F.col("p_type").alias("tool"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")).alias("args"))
    calls = part.select(F.col("p_partkey").alias("call_id"), F.col("p_type").alias("tool"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.lit("")).alias("args"))
    return O.best_arguments(calls, cached)


@query
def a12_diagnosis(spark, sf):
    rows = _t(spark, sf, "events").select(
        F.col("event_id").alias("case_id"), (F.col("event_type") != "error").alias("completed"), F.array(F.col("event_type"), F.lit("View Page")).alias("causes"), F.array(F.concat(F.lit("User "), "user_id")).alias("objects"),
        F.concat(F.lit("cause: VIEW-page, "), "event_type").alias("said_cause"), F.concat(F.lit("user"), F.col("event_id") % 100).alias("said_object"), "value",
    )
    return O.diagnosis_report(O.diagnosis_scores(rows.withColumnRenamed("value", "latency")))


@query
def a14_batch_stats(spark, sf):
    return O.batch_stats(_t(spark, sf, "events").select(F.when(F.col("event_type") == "error", "fail").otherwise("success").alias("status"), F.col("value").alias("elapsed")))


# --- conversation memory ----------------------------------------------------


def _messages(spark, sf):
    return _unique(_t(spark, sf, "conversations"))


def _unique(rows: DataFrame) -> DataFrame:
    """User and assistant messages; of repeated (conversation, turn) rows the least text stands."""
    kept = rows.filter(F.col("role").isin("user", "assistant"))
    return kept.groupBy(F.col("conv_id").alias("session"), F.col("turn").alias("seq")).agg(F.min(F.struct("role", F.coalesce("text", F.lit("")).alias("text"))).alias("m")).select("session", "seq", "m.role", "m.text")


@query
def w04_boundary(spark, sf):
    return M.boundary(_messages(spark, sf))


@query
def w05_tail(spark, sf):
    m = _messages(spark, sf)
    return M.tail(m, M.boundary(m)).select("session", "seq", "role")


@query
def w06_gaps(spark, sf):
    return M.sequence_gaps(_messages(spark, sf))


@query
def s16_gap_free(spark, sf):
    return M.gap_free(_messages(spark, sf), 0).select("session", "seq", "role")


@query
def a22_token_budget(spark, sf):
    return M.budget(M.token_totals(_messages(spark, sf)), 400, 100, 0.8)


@query
def x35_dialogue(spark, sf):
    return M.rendered(_messages(spark, sf)).select("session", F.md5(F.col("dialogue").cast("binary")).alias("digest"))


@query
def w12_trimmed(spark, sf):
    return M.trimmed(_messages(spark, sf)).select("session", "seq")


@query
def f11_latest(spark, sf):
    return M.latest_dialogue(_messages(spark, sf), 4).select("session", "seq", "back")


@query
def k11_sequence(spark, sf):
    return M.sequenced(_messages(spark, sf)).select("session", "seq", "message_seq")


@query
def f10_admitted(spark, sf):
    """Turns as memories, their role as evidence; a third is not sure enough, a fifth no longer active."""
    status = F.when(F.pmod("turn", F.lit(5)) == 4, "inactive").otherwise("active")
    items = _t(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("content"), F.col("role").alias("evidence"), status.alias("status"), (F.lit(0.5) + F.pmod("conv_id", F.lit(3)) * 0.25).alias("confidence"))
    return M.admissible(items).select("conv_id", "turn")


@query
def t09_memories(spark, sf):
    items = _t(spark, sf, "events").select(F.col("event_id").alias("memory_id"), "user_id", F.col("event_type").alias("content"), F.when(F.col("event_type") == "error", "inactive").otherwise("active").alias("status"), (F.pmod("event_id", F.lit(10)) / 10).alias("confidence"), (F.pmod("event_id", F.lit(7)) / 7).alias("score"))
    return M.runtime_memories(items).select("user_id", "memory_id", "rank")


@query
def k14_memory_state(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "purchase", "update").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "deactivate").otherwise("update")
    actions = _t(spark, sf, "events").select(F.col("user_id").alias("memory_id"), F.col("event_id").alias("seq"), kind.alias("action"), F.when(kind.isin("create", "update"), F.concat(F.lit("v"), "event_id")).alias("content"), F.col("event_id").alias("at"))
    return M.applied_actions(actions)


# --- evaluation and ingest --------------------------------------------------


def _relevant(spark, sf):
    """BM25 hits; a document counts as relevant if it holds the first 30 letters of the item."""
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.lower("text").alias("text"))
    items = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.lower(F.substring("text", 1, 30)).alias("needle"))
    hits = _bm25(spark, sf).join(docs, "chunk_id").join(items, "query_id")
    return hits.select("query_id", "chunk_id", "rank", F.col("text").contains(F.col("needle")).alias("relevant"))


@query
def a09_recall(spark, sf):
    items = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("g"), F.pmod("item_id", F.lit(4))).alias("grp"))
    return E.recall_at(_relevant(spark, sf), items, 5).select(F.coalesce("grp", F.lit("all")).alias("grp"), "n", "hits", "recall")


@query
def a10_hit_rates(spark, sf):
    return E.hit_rates(_relevant(spark, sf), _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")))


@query
def a15_length_stats(spark, sf):
    """A document with an @ stands for a chunk with pictures."""
    return E.length_statistics(_t(spark, sf, "documents"), F.length("text").cast("long"), ["lang"], F.col("text").contains("@"))


@query
def a15_length_buckets(spark, sf):
    return _t(spark, sf, "documents").groupBy(E.length_bucket(F.length("text")).alias("bucket")).agg(F.count("*").alias("n"))


@query
def t10_tfidf(spark, sf):
    asked = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return E.tfidf_hits(_t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), asked)


@query
def k02_quarantine(spark, sf):
    good, bad = quarantine_split(_t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text"), 8000)
    both = good.select(F.lit("valid").alias("state"), F.lit("").alias("reason")).unionAll(bad.select(F.lit("quarantined").alias("state"), "reason"))
    return both.groupBy("state", "reason").agg(F.count("*").alias("n"))
