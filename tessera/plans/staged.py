"""The older retrieval in gated rounds (R12): each stage searches and scans for the questions that are still open.

A stage has tiers and families by intent; its search and its scan meet only
chunks of these.  Questions whose best row is strong leave after their stage;
the others go on, and what a later stage finds replaces what an earlier one did.
Questions that no stage answers are scanned for in all tiers at last (stage 0).

There are three rounds and a last one, whatever the data; a round's rows (a few
a question) are written to the shared folder, so a later round starts from them,
and rounds without open questions do not run.  Intents, nine at most, are all
that the driver reads.  The scan scores every chunk of its stage by X17
(``operators/scan.py``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.operators import understand as U
from tessera.operators.scan import relevant_hits
from tessera.plans import retrieve as P
from tessera.sources.store import stored

#: A search: (chunks, questions with query_id and text, keep, fetch) to query_id, chunk_id, score; ``keep`` filters pairs before the best are taken.
Search = Callable[[DataFrame, DataFrame, Callable[[DataFrame], DataFrame], int], DataFrame]

# Variants that a stage asks with, and rows of the last scan.
VARIANTS, LAST_ROWS = 3, 6
ALL_TIERS = ["primary", "support", "auxiliary"]


class Kept:
    """A filter of pairs by their chunks: those of a stage; ``statistics`` gives those of all chunks, counted once."""

    def __init__(self, own: DataFrame, statistics: Callable[[], DataFrame]) -> None:
        self.own, self.statistics = own, statistics

    def __call__(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.own.select("chunk_id"), "chunk_id", "left_semi")


def bm25_search(chunks: DataFrame, questions: DataFrame, keep: Callable[[DataFrame], DataFrame], fetch: int) -> DataFrame:
    """A lexical search with the statistics of all chunks; vectors come in by another function of this form.

    The chunks of a stage are the only ones that are scored, so no pair is made to be filtered out.
    """
    if isinstance(keep, Kept):
        return R.bm25_hits(chunks, questions, "chunk_id", "text", "query_id", "text", fetch, among=keep.own, statistics=keep.statistics()).select("query_id", "chunk_id", "score")
    return R.bm25_hits(chunks, questions, "chunk_id", "text", "query_id", "text", fetch, keep=keep).select("query_id", "chunk_id", "score")


def _allowed(chunks: DataFrame, tiers: list[str], families: list[str] | None) -> DataFrame:
    types = [t for f in families or [] for t in U.FAMILY_TYPES.get(f, [])]
    kind = F.col("kind") if "kind" in chunks.columns else F.lit(None).cast("string")
    return chunks.filter(F.col("tier").isin(tiers) & (kind.isin(types) if types else F.lit(True)))


def _fields(chunks: DataFrame) -> dict[str, Column]:
    return {c: (F.col(c) if c in chunks.columns else F.lit(None)).cast(t) for c, t in P.CHUNK_FIELDS.items()}


def _post_filter(rows: DataFrame, chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """what an intent about scan errors or law leaves of its rows."""
    fields = [v.alias(f"c_{c}") for c, v in _fields(chunks).items()]
    full = rows.join(chunks.select("chunk_id", F.col("tier").alias("c_tier"), *fields), "chunk_id").join(asked.select("query_id", "intent", "terms"), "query_id")
    c = lambda name: F.col(f"c_{name}")
    ocr = U.ocr_candidate(F.col("terms"), c("title"), c("section"), c("index_text"), c("note"), c("flags"), c("tier"))
    legal = U.legal_candidate(F.col("terms"), c("title"), c("section"), c("kind"), c("tier"))
    return full.filter(F.when(F.col("intent") == "ocr_audit", ocr).when(F.col("intent") == "legal", legal).otherwise(True)).select(*rows.columns)


def _scanned(chunks: DataFrame, asked: DataFrame, prefer_support: bool, rows: int) -> DataFrame:
    """query_id, chunk_id and score, which a scan does not have, of the best ``rows`` by X17 of all chunks."""
    own = chunks.select("chunk_id", "tier", "text", *(v.alias(c) for c, v in _fields(chunks).items()))
    return relevant_hits(own, asked, prefer_support, rows).select("query_id", "chunk_id", F.lit(0.0).alias("score"))


def _placed(rows: DataFrame, chunks: DataFrame, asked: DataFrame, prefer_support: bool) -> DataFrame:
    """(query_id, chunk_id, score) rows in X17's order, filtered; ``plain`` is X17 without the preference, of the terms alone.

    The chunks of the rows are written once, so what ``chunks`` works out (a type, say) is worked out for them only.
    """
    chunks = stored(chunks.join(R.bounded_broadcast(rows.select("chunk_id").distinct()), "chunk_id", "left_semi"), "near")
    terms_only = asked.withColumn("text", F.array_join("terms", " "))
    scored = P.lexical_scores(rows, chunks, asked, F.lit(prefer_support))
    plain = P.lexical_scores(rows, chunks, terms_only).withColumnRenamed("lexical", "plain").select("query_id", "chunk_id", "plain")
    kept = _post_filter(scored.join(plain, ["query_id", "chunk_id"]), chunks, asked)
    return R.ranked(kept, [F.desc("lexical"), F.desc("score"), F.asc("chunk_id")])


def _best(rows: DataFrame) -> DataFrame:
    return rows.filter("rank = 1").select("query_id", "plain")


def _needs_scan(intent: Column, plain: Column, critical: Column) -> Column:
    least = F.when(intent.isin("safety", "troubleshooting", "general"), 24).otherwise(20)
    return plain.isNull() | intent.isin("image_trace", "ocr_audit") | critical | (plain < least)


def _stage(chunks: DataFrame, asked: DataFrame, search: Search, tiers: list[str], families: list[str] | None, top_k: int, statistics: Callable[[], DataFrame]) -> DataFrame:
    """One stage of one intent: query_id, chunk_id, score, lexical, plain and rank of at most ``top_k`` rows a question."""
    fetch, own = max(3 * top_k, 8), _allowed(chunks, tiers, families)
    texts = asked.select("query_id", F.posexplode(F.slice("variants", 1, VARIANTS)).alias("variant", "text"))
    key = F.to_json(F.struct("query_id", "variant"))
    keyed = stored(texts.withColumn("key", key), "variants")
    found = search(chunks, keyed.select(F.col("key").alias("query_id"), "text"), Kept(own, statistics), fetch).withColumnRenamed("query_id", "key").join(keyed.select("key", "query_id", "variant"), "key")
    once = stored(found.groupBy("query_id", "chunk_id").agg(F.min_by("score", "variant").alias("score")), "found")
    prefer = "support" in tiers
    first = stored(_placed(once, own, asked, prefer), "stage")  # all that was found: what the scan finds again keeps its own score
    gate = asked.join(_best(first), "query_id", "left")
    weak = stored(gate.filter(_needs_scan(F.col("intent"), F.col("plain"), F.col("critical"))).select("query_id"), "weak")
    if weak.isEmpty():
        return first.filter(F.col("rank") <= top_k)
    scanned = stored(_scanned(own, asked.join(weak, "query_id", "left_semi"), prefer, fetch), "scanned")
    both = stored(first.select("query_id", "chunk_id", "score").unionAll(scanned.join(first, ["query_id", "chunk_id"], "left_anti")), "both")
    return stored(_placed(both, own, asked, prefer).filter(F.col("rank") <= top_k), "stage")


def staged_search(chunks: DataFrame, queries: DataFrame, search: Search = bm25_search, top_k: int = 4) -> DataFrame:
    """query_id, chunk_id, stage, lexical and rank.

    ``chunks`` has chunk_id, tier and text and any of CHUNK_FIELDS; ``queries``
    query_id and text.  A question without rows anywhere is not in the result.
    """
    asked = P.analyzed(queries).withColumn("intent", U.older_intent(F.col("text")))
    asked = asked.withColumns({"variants": U.variants(F.col("text"), F.col("intent"), F.col("terms")), "critical": F.size(U.critical_groups(F.col("text"))) > 0})
    asked = stored(asked, "asked")
    counted: list[DataFrame] = []

    def statistics() -> DataFrame:
        if not counted:
            counted.append(R.collection_statistics(chunks, "text"))
        return counted[0]

    open_, answers = asked, []
    for n in range(3):
        made: list[DataFrame] = []
        for row in open_.select("intent").distinct().collect():  # nine at most
            steps = P.STAGES.get(row["intent"], P.STAGES["general"])
            if n < len(steps):
                own = open_.filter(F.col("intent") == row["intent"])
                made.append(_stage(chunks, own, search, *steps[n], top_k, statistics).withColumn("intent", F.lit(row["intent"])))
        if not made:
            break
        rows = made[0]
        for more in made[1:]:
            rows = rows.unionByName(more)
        rows = stored(rows.withColumn("stage", F.lit(n + 1)), "round")
        answers.append(rows)
        least = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in P.STRONG.items() for v in kv)), F.col("intent")), F.lit(22))
        strong = rows.filter((F.col("rank") == 1) & (F.col("plain") >= least)).select("query_id")
        open_ = stored(open_.join(strong, "query_id", "left_anti"), "open")
        if open_.isEmpty():
            break
    out = answers[0] if answers else None
    for more in answers[1:]:
        out = out.unionByName(more)
    if out is None:
        return asked.select("query_id", F.lit("").alias("chunk_id"), F.lit(0).alias("stage"), F.lit(0.0).alias("lexical"), F.lit(1).cast("long").alias("rank")).filter("false")
    last = out.groupBy("query_id").agg(F.max("stage").alias("stage"))
    chosen = out.join(last, ["query_id", "stage"])
    rest = stored(asked.join(last, "query_id", "left_anti"), "rest")
    if not rest.isEmpty():
        own, rows = _allowed(chunks, ALL_TIERS, None), max(top_k, LAST_ROWS)
        scanned = stored(_scanned(own, rest, True, rows), "scanned")
        found = _placed(scanned, own, rest, True).join(rest.select("query_id", "intent"), "query_id")
        return _trimmed(chosen).unionByName(found.withColumn("stage", F.lit(0)).select("query_id", "chunk_id", "stage", "lexical", "rank"))
    return _trimmed(chosen)


def _trimmed(rows: DataFrame) -> DataFrame:
    limit = U.trim_limit(F.col("intent"))
    return rows.filter(limit.isNull() | (F.col("rank") <= limit)).select("query_id", "chunk_id", "stage", "lexical", "rank")
