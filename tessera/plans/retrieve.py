"""The composed retrieval of many questions: understand, recall, fuse, rescan, rerank, expand.

Stages are DataFrames; what several later stages read is written once to the
shared folder.  A stage that has a documented fallback takes it as data: weak queries get the scan channel by a semi-join, and a
reranker that is absent leaves the fused order, or the lexical one if asked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import hierarchy as H
from tessera.operators import retrieval as R
from tessera.operators import understand as U
from tessera.sources.store import stored

#: A reranker: (query_id, chunk_id, query, text, rank) to (query_id, chunk_id, score); null scores go last.
Reranker = Callable[[DataFrame], DataFrame]


def analyzed(queries: DataFrame) -> DataFrame:
    """query_id, text, language, intent, its score and terms."""
    rows = queries.select("query_id", "text", X.detect_language(F.col("text")).alias("language"), U.intent(F.col("text")).alias("intent"), X.query_terms(F.col("text")).alias("terms"))
    return rows.withColumn("intent_score", U.intent_score(F.col("intent"), X.picture_id(F.col("text")) != ""))


#: Optional columns of a chunk that X17 reads.
CHUNK_FIELDS = {"title": "string", "section": "string", "index_text": "string", "kind": "string", "pic_ids": "array<string>", "flags": "array<string>", "note": "string"}


def lexical_scores(candidates: DataFrame, chunks: DataFrame, asked: DataFrame, prefer_support: Column | None = None) -> DataFrame:
    """X17 for (query_id, chunk_id, score) rows: the same with ``lexical``.

    ``chunks`` has chunk_id, tier, text and any of CHUNK_FIELDS; ``asked`` has
    query_id, text, terms and intent.  Each candidate row meets its own chunk
    and question only.
    """
    fields = [F.col(c).cast(t).alias(c) if c in chunks.columns else F.lit(None).cast(t).alias(c) for c, t in CHUNK_FIELDS.items()]
    rows = candidates.join(chunks.select("chunk_id", "tier", F.col("text").alias("body"), *fields), "chunk_id")
    rows = rows.join(asked.select("query_id", F.col("text").alias("query"), "terms", "intent"), "query_id")
    points = U.relevance(
        F.col("terms"), F.col("title"), F.col("section"), F.col("index_text"), F.col("body"), F.col("score"), F.col("intent"), F.col("kind"), F.col("tier"), F.lit(False) if prefer_support is None else prefer_support,
        query=F.col("query"), pic_ids=F.col("pic_ids"), flags=F.col("flags"), note=F.col("note"),
    )
    return rows.select(*candidates.columns, points.alias("lexical"))


def lexical_order(candidates: DataFrame, chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, chunk_id, lexical and rank by the score, equal ones as they stood (``rank``)."""
    scored = lexical_scores(candidates, chunks, asked).withColumnRenamed("rank", "was")
    return R.ranked(scored, [F.desc("lexical"), F.asc("was"), F.asc("chunk_id")]).select("query_id", "chunk_id", "lexical", "rank")


def weak_queries(hits: DataFrame, chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, n_hits, lexical (of the best fused candidate) and scan, for every question."""
    best = R.fused(R.normalized(hits)).filter("rank = 1").select("query_id", "chunk_id", "merged_score")
    raw = hits.groupBy("query_id", "chunk_id").agg(F.max_by("score", F.when(F.col("channel") == "vector", 1).otherwise(0)).alias("score"))
    top = lexical_scores(best.join(raw, ["query_id", "chunk_id"]), chunks, asked).select("query_id", "merged_score", "lexical")
    counts = hits.groupBy("query_id").agg(F.countDistinct("chunk_id").alias("n_hits"))
    state = asked.join(top, "query_id", "left").join(counts, "query_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    scan = R.scan_needed(F.col("lexical"), F.col("merged_score"), F.size("terms"), F.col("intent"), F.col("n_hits"), F.size(U.critical_groups(F.col("text"))) > 0)
    return state.select("query_id", "n_hits", "lexical", scan.alias("scan"))


def recalled(chunks: DataFrame, queries: DataFrame, vector_hits: DataFrame | None = None, fetch: int | None = None) -> DataFrame:
    """Fused candidates of the BM25 and vector channels; weak queries are scanned too.

    ``chunks`` has chunk_id, tier and text; only recallable tiers are searched,
    while term statistics are those of all chunks that are recallable.  Hits
    and weak questions, a few rows each, are written between the stages, so the
    documents are searched once and scanned for weak questions only.
    """
    fetch = fetch or R.fetch_limit()
    open_chunks = chunks.filter(U.recallable(F.col("tier")))
    hits = R.bm25_hits(open_chunks, queries, "chunk_id", "text", "query_id", "text", fetch).withColumn("channel", F.lit("bm25"))
    if vector_hits is not None:
        known = vector_hits.join(open_chunks.select("chunk_id"), "chunk_id", "left_semi")
        hits = hits.unionByName(known.select("query_id", "chunk_id", "score", "rank", F.lit("vector").alias("channel")))
    hits = stored(hits, "hits")
    weak = stored(weak_queries(hits, open_chunks, analyzed(queries)).filter("scan").select("query_id"), "weak")
    asked = queries.join(weak, "query_id", "left_semi")
    scanned = R.scan_hits(open_chunks, asked, "chunk_id", "text", "query_id", "text", fetch).withColumn("channel", F.lit("scan"))
    return stored(R.fused(R.normalized(hits.unionByName(scanned))), "candidates")


def reranked(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, reranker: Reranker | str | None = None) -> DataFrame:
    """The reranker's order, unscored last, then what it left out.

    Without one, or with "none", the fused order stays; "lexical" is the
    fallback of T3.
    """
    if reranker is None or reranker == "none":
        return candidates.select("query_id", "chunk_id", "rank")
    if reranker == "lexical":
        asked = analyzed(queries).withColumn("intent", U.older_intent(F.col("text")))
        return lexical_order(candidates.select("query_id", "chunk_id", "rank", F.col("merged_score").alias("score")), chunks, asked).select("query_id", "chunk_id", "rank")
    given = candidates.join(chunks.select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    scored = reranker(given.select("query_id", "chunk_id", "query", "text", "rank")).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    order = scored.join(candidates.select("query_id", "chunk_id", F.col("rank").alias("was")), ["query_id", "chunk_id"])
    first = R.ranked(order, [F.desc_nulls_last("score"), F.asc("was")])
    return R.completed(first, candidates)


def evidence(ranking: DataFrame, chunks: DataFrame, top_k: int = 3) -> DataFrame:
    """The first chunks of each query and, in their order, the support chunks above them."""
    first = ranking.filter(F.col("rank") <= max(top_k, 0)).join(chunks.select("chunk_id", "parent_id", "tier"), "chunk_id")
    hits = first.select("query_id", "chunk_id", "rank", F.lit("primary").alias("role"))
    support = H.support_context(H.parent_rows(first, chunks), first)
    return hits.unionByName(support.select("query_id", F.col("parent_id").alias("chunk_id"), "rank", F.lit("support").alias("role")))


def rendered(found: DataFrame, chunks: DataFrame, chars: int = 180) -> DataFrame:
    """Each query's evidence as numbered blocks, and as one extract."""
    rows = found.join(chunks.select("chunk_id", "text"), "chunk_id")
    block = F.format_string("[%d] (%s) %s", F.col("rank"), F.col("role"), F.coalesce("text", F.lit("")))
    item = F.struct((F.col("role") != "primary").alias("late"), "rank", "chunk_id", block.alias("block"), X.clip(F.col("text"), chars).alias("extract"))
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return listed.select("query_id", F.array_join(F.transform("items", lambda i: i["block"]), "\n\n").alias("context"), F.array_join(F.slice(F.transform("items", lambda i: i["extract"]), 1, 9), "；").alias("answer"))


def retrieve(chunks: DataFrame, queries: DataFrame, vector_hits: DataFrame | None = None, reranker: Reranker | str | None = None, top_k: int = 3, fetch: int | None = None) -> DataFrame:
    """query_id, chunk_id, rank and role of the evidence of every query."""
    candidates = recalled(chunks, queries, vector_hits, fetch)
    return evidence(reranked(candidates, chunks, queries, reranker), chunks, top_k)


def lost_at(expected: DataFrame, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """For each expected (query_id, chunk_id) the first stage that does not have it, or found."""
    out = expected.select("query_id", "chunk_id").distinct()
    verdict = F.lit("found")
    for i, (name, rows) in reversed(list(enumerate(stages))):
        out = out.join(rows.select("query_id", "chunk_id", F.lit(True).alias(f"in_{i}")).distinct(), ["query_id", "chunk_id"], "left")
        verdict = F.when(F.col(f"in_{i}").isNull(), F.lit(f"lost_in_{name}")).otherwise(verdict)
    return out.select("query_id", "chunk_id", verdict.alias("verdict"))


# The stages of the older retrieval: tiers and families of each, none allowing all.
STAGES = {
    "component": [(["primary"], ["component"]), (["support"], ["overview"]), (["primary", "support"], ["component", "overview", "procedure"])],
    "procedure": [(["primary"], ["procedure"]), (["support"], ["overview"]), (["primary", "support"], ["procedure", "component", "overview"])],
    "legal": [(["primary"], ["legal"]), (["support"], ["overview"]), (["primary", "support"], ["legal", "overview", "general"])],
    "safety": [(["primary"], ["safety"]), (["support"], ["overview"]), (["primary", "support"], ["safety", "overview", "general"])],
    "troubleshooting": [(["primary"], ["troubleshooting"]), (["support"], ["overview"]), (["primary", "support"], ["troubleshooting", "overview", "general"])],
    "image_trace": [(["auxiliary"], ["auxiliary"]), (["primary"], ["image", "component"]), (["primary", "support", "auxiliary"], ["auxiliary", "image", "component", "overview"])],
    "ocr_audit": [(["auxiliary"], ["auxiliary"]), (["primary", "support"], ["ocr", "overview"]), (["primary", "support", "auxiliary"], None)],
    "overview": [(["primary", "support"], ["overview"]), (["primary", "support"], ["overview", "component", "procedure"])],
    "general": [(["primary"], None), (["primary", "support"], None)],
}
# The lexical score from which a stage's best hit ends the search.
STRONG = {"image_trace": 40, "ocr_audit": 40, "safety": 28, "troubleshooting": 28}


def staged(hits: DataFrame, chunks: DataFrame, queries: DataFrame, top_k: int = 4) -> DataFrame:
    """The older retrieval by stages: query_id, chunk_id, stage, lexical and rank.

    ``hits`` (query_id, chunk_id, score) is what search and scan found.  A
    stage keeps hits of its tiers and chunk types, in lexical order, with the
    post-filters of F5.  The first stage with a strong best hit counts, else the
    last one that found anything, else all hits without a stage (stage 0).
    """
    asked = analyzed(queries).withColumn("intent", U.older_intent(F.col("text")))
    lexical = lexical_scores(hits.select("query_id", "chunk_id", "score").distinct(), chunks, asked)
    fields = {c: (F.col(c) if c in chunks.columns else F.lit(None)).cast(t).alias(c) for c, t in CHUNK_FIELDS.items()}
    rows = lexical.join(chunks.select("chunk_id", "tier", *fields.values()), "chunk_id").join(asked.select("query_id", "intent", "terms"), "query_id")
    ocr = U.ocr_candidate(F.col("terms"), F.col("title"), F.col("section"), F.col("index_text"), F.col("note"), F.col("flags"), F.col("tier"))
    legal = U.legal_candidate(F.col("terms"), F.col("title"), F.col("section"), F.col("kind"), F.col("tier"))
    rows = rows.filter(F.when(F.col("intent") == "ocr_audit", ocr).when(F.col("intent") == "legal", legal).otherwise(True))
    stages = []
    for name, steps in STAGES.items():
        for n, (tiers, families) in enumerate(steps, 1):
            types = [t for f in families or [] for t in U.FAMILY_TYPES.get(f, [])]
            fits = (F.col("intent") == name) & F.col("tier").isin(tiers) & (F.col("kind").isin(types) if types else F.lit(True))
            stages.append(F.when(F.coalesce(fits, F.lit(False)), F.lit(n)))
    placed = rows.withColumn("stage", F.explode(F.array_compact(F.array(*stages, F.lit(99)))))
    tops = placed.groupBy("query_id", "intent", "stage").agg(F.max("lexical").alias("best"))
    least = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in STRONG.items() for v in kv)), F.col("intent")), F.lit(22))
    strong = F.min(F.when((F.col("stage") < 99) & (F.col("best") >= least), F.col("stage")))
    weak = F.max(F.when(F.col("stage") < 99, F.col("stage")))
    chosen = tops.groupBy("query_id").agg(F.coalesce(strong, weak, F.lit(99)).alias("stage"))
    found = R.ranked(placed.join(chosen, ["query_id", "stage"]), [F.desc("lexical"), F.asc("chunk_id")])
    limit = F.least(F.lit(top_k), F.coalesce(U.trim_limit(F.col("intent")), F.lit(top_k)))
    return found.filter(F.col("rank") <= limit).select("query_id", "chunk_id", F.when(F.col("stage") == 99, 0).otherwise(F.col("stage")).alias("stage"), "lexical", "rank")


def older_support(hits: DataFrame, chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """Support parents of primary hits in lexical order; none for a question about scan errors, three for a legal one.

    ``hits`` has query_id, chunk_id, parent_id, tier and rank, ``asked``
    query_id, text, terms and intent.
    """
    open_ = asked.filter("intent <> 'ocr_audit'")
    parents = H.parent_rows(hits.join(open_.select("query_id"), "query_id", "left_semi"), chunks).filter("parent_tier = 'support'")
    rows = parents.select("query_id", F.col("parent_id").alias("chunk_id"), "rank", F.lit(0.0).alias("score"))
    as_one = open_.select("query_id", F.array_join("terms", " ").alias("text"), "terms", F.when(F.col("intent").isin("legal", "overview"), F.col("intent")).otherwise("general").alias("intent"))
    placed = lexical_order(rows, chunks, as_one).join(open_.select("query_id", "intent"), "query_id")
    return placed.filter((F.col("intent") != "legal") | (F.col("rank") <= 3)).select("query_id", "chunk_id", "rank")
