"""Reports and reductions over chunks, traces and evaluation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Qualities from best to worst. Fixed values.
QUALITIES = ("normal", "warning", "needs_review", "issue")


def ordered_distinct(rows: DataFrame, by: list[str], value: str, order: list[str], name: str) -> DataFrame:
    """The distinct values of each group in first-seen order; null and blank ones dropped."""
    kept = rows.filter(F.col(value).isNotNull() & (F.trim(F.col(value).cast("string")) != ""))
    first = kept.groupBy(*by, value).agg(F.min(F.struct(*order)).alias("seen"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", value))), lambda s: s[value]).alias(name))


def set_report(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Counts of distinct keys in both sides, only expected, and only actual."""
    e, a = expected.select(key).filter(F.col(key).isNotNull()).distinct(), actual.select(key).filter(F.col(key).isNotNull()).distinct()
    both = e.withColumn("e", F.lit(1)).join(a.withColumn("a", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("shared"), F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("extra"))


def integration_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per document, chunks before and after, bands of length, lost pictures and parents of a single child."""
    size = F.length(F.coalesce("text", F.lit("")))
    was = before.groupBy("doc").agg(F.count("*").alias("before"), F.array_distinct(F.flatten(F.collect_list("pic_ids"))).alias("pics_before"))
    now = after.groupBy("doc").agg(
        F.count("*").alias("after"), F.count_if(size < 200).alias("below_200"), F.count_if(size.between(200, 800)).alias("to_800"), F.count_if(size > 800).alias("above_800"),
        F.count_if(F.col("tier") == "primary").alias("primary"), F.array_distinct(F.flatten(F.collect_list("pic_ids"))).alias("pics_after"),
    )
    lone = after.filter("parent_id IS NOT NULL").groupBy("doc", "parent_id").agg(F.count("*").alias("n")).filter("n = 1").groupBy("doc").agg(F.count("*").alias("single_child_parents"))
    joined = was.join(now, "doc", "full").join(lone, "doc", "left")
    none = F.expr("cast(array() AS array<string>)")
    lost = F.size(F.array_except(F.coalesce("pics_before", none), F.coalesce("pics_after", none))).alias("lost_pics")
    counts = ["before", "after", "below_200", "to_800", "above_800", "primary", "single_child_parents"]
    return joined.select("doc", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), lost)


def report_rollup(reports: DataFrame) -> DataFrame:
    """Sums over documents, the share of chunks that remain, and the documents that lost pictures."""
    return reports.agg(
        F.count("*").alias("docs"), F.sum("before").alias("before"), F.sum("after").alias("after"), F.round(F.sum("after") / F.nullif(F.sum("before"), F.lit(0)), 4).alias("ratio"),
        F.array_sort(F.collect_list(F.when(F.col("lost_pics") > 0, F.col("doc")))).alias("with_lost_pics"),
    )


def merged_metadata(rows: DataFrame, by: str) -> DataFrame:
    """Least first and greatest last line, worst quality, ordered distinct flags and joined notes of a merge group."""
    rank = F.array_position(F.array(*(F.lit(q) for q in QUALITIES)), F.coalesce("quality", F.lit(QUALITIES[0])))
    item = F.struct("pos", "flags", "note")
    listed = rows.groupBy(by).agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.max(rank).alias("worst"), F.array_sort(F.collect_list(item)).alias("items"))
    flags = F.array_distinct(F.flatten(F.filter(F.transform("items", lambda i: i["flags"]), lambda f: f.isNotNull())))
    notes = F.array_distinct(F.filter(F.transform("items", lambda i: F.trim(i["note"])), lambda n: n.isNotNull() & (n != "")))
    quality = F.element_at(F.array(*(F.lit(q) for q in QUALITIES)), F.greatest(F.col("worst"), F.lit(1)).cast("int"))
    return listed.select(by, "first_line", "last_line", quality.alias("quality"), flags.alias("flags"), F.array_join(notes, "; ").alias("note"))


def trace_summary(traces: DataFrame, lists: list[str]) -> DataFrame:
    """Per trace the sizes of its lists; over all traces the counts of intents come from a groupBy."""
    sizes = [F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0).cast("long").alias(f"n_{c}") for c in lists]
    return traces.select("trace_id", "intent", *sizes)


def described_pictures(pictures: DataFrame, given: DataFrame) -> DataFrame:
    """Pictures with their description, an existing one before a given one, and where it came from."""
    once = given.groupBy("pic_id").agg(F.min("description").alias("given"))
    own = F.nullif(F.trim("description"), F.lit(""))
    out = pictures.join(once, "pic_id", "left")
    source = F.when(own.isNotNull(), "existing").when(F.col("given").isNotNull(), "provided").otherwise("missing")
    return out.select("pic_id", F.coalesce(own, F.col("given")).alias("description"), source.alias("source"))


def picture_paths(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """The paths of each chunk's pictures in their order; the last path of a picture wins, unknown ones are left out."""
    last = paths.groupBy("pic_id").agg(F.max_by("path", "pos").alias("path"))
    each = chunks.select("chunk_id", F.posexplode("pic_ids").alias("at", "pic_id")).join(last, "pic_id")
    return each.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "path"))), lambda p: p["path"]).alias("paths"))


def judged_pairs(hypotheses: DataFrame, references: DataFrame) -> DataFrame:
    """Answers with their references; a repeated or unknown question id fails the query when it runs."""
    n = F.count("*").over(W.partitionBy("question_id"))
    checked = hypotheses.withColumn("n", n).join(references, "question_id", "left")
    ok = F.assert_true((F.col("n") == 1) & F.col("answer").isNotNull(), F.concat(F.lit("bad question id: "), F.col("question_id")))
    return checked.withColumn("checked", ok).filter("checked IS NULL").drop("n", "checked")


def trace_documents(post_rank: DataFrame, recall: DataFrame) -> DataFrame:
    """Ranked rows of a trace with the document that recall saw for their chunk first."""
    doc = recall.groupBy("trace_id", "chunk_id").agg(F.min_by("doc", "pos").alias("doc"))
    return post_rank.join(doc, ["trace_id", "chunk_id"], "left")


def nearest_distractors(sessions: DataFrame, keep: int = 2) -> DataFrame:
    """Per case, the sessions without evidence that are nearest to one with it, earlier ones first on ties, in order.

    Rows are (case_id, idx, is_evidence); distances come from the evidence
    before and after each row, so no pairs are made.
    """
    each = W.partitionBy("case_id").orderBy("idx")
    mark = F.when(F.col("is_evidence"), F.col("idx"))
    before, after = F.last(mark, True).over(each.rowsBetween(W.unboundedPreceding, 0)), F.first(mark, True).over(each.rowsBetween(0, W.unboundedFollowing))
    rows = sessions.withColumn("distance", F.least(F.col("idx") - before, after - F.col("idx"))).filter("NOT is_evidence AND distance IS NOT NULL")
    return rows.withColumn("r", F.row_number().over(W.partitionBy("case_id").orderBy("distance", "idx"))).filter(F.col("r") <= keep).select("case_id", "idx", "distance")


def paired_images(pic_ids: Column, paths: Column) -> Column:
    """(pic_id, path) pairs: the path whose stem equals or holds the id, else the one at the same place."""
    stem = lambda p: F.regexp_extract(p, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)

    def pair(pic: Column, i: Column) -> Column:
        same = F.get(F.filter(paths, lambda p: stem(p) == pic), F.lit(0))
        part = F.get(F.filter(paths, lambda p: F.contains(stem(p), pic) | F.contains(pic, stem(p))), F.lit(0))
        return F.struct(pic.alias("pic_id"), F.coalesce(same, part, F.get(paths, i)).alias("path"))

    return F.transform(pic_ids, pair)


def latest_retrieval_only(messages: DataFrame) -> DataFrame:
    """Messages without older retrieval results and the calls that asked for nothing else.

    Rows are (session, seq, kind, call_ids) of kind 'retrieval' (with the one
    call it answers), 'call' or another.
    """
    newest = F.max(F.when(F.col("kind") == "retrieval", F.col("seq"))).over(W.partitionBy("session"))
    rows = messages.withColumn("newest", newest)
    old = rows.filter("kind = 'retrieval' AND seq < newest").select("session", F.explode("call_ids").alias("call_id")).distinct()
    calls = rows.filter("kind = 'call'").select("session", "seq", F.size("call_ids").alias("n"), F.explode("call_ids").alias("call_id")).join(old, ["session", "call_id"])
    stale = calls.groupBy("session", "seq", "n").agg(F.count_distinct("call_id").alias("k")).filter("k = n").select("session", "seq")
    return rows.filter("kind <> 'retrieval' OR seq = newest").join(stale, ["session", "seq"], "left_anti").drop("newest")


def completed_support(chunks: DataFrame) -> DataFrame:
    """H9: chunks with a support node for every path prefix that has none, reparented and with tiers by children.

    ``chunks`` has doc, path, first_line and last_line; a synthetic node spans
    the lines of what lies below it.
    """
    up = chunks.select("doc", F.explode(F.expr("transform(sequence(1, size(path)), n -> slice(path, 1, n))")).alias("node"), F.col("path").alias("below"), "first_line", "last_line")
    spans = up.groupBy("doc", F.col("node").alias("path")).agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.max((F.size("below") > F.size("node")).cast("int")).alias("inner"), F.max((F.col("below") == F.col("node")).cast("int")).alias("real"))
    parent = F.when(F.size("path") > 1, F.expr("slice(path, 1, size(path) - 1)"))
    return spans.select("doc", "path", parent.alias("parent_path"), F.when(F.col("inner") == 1, "support").otherwise("primary").alias("tier"), (F.col("real") == 0).alias("synthetic"), "first_line", "last_line")
