"""Conversation memory: gaps, boundaries, budgets, admission and the upsert of items.

Messages are rows (session, seq, role, text).  Windows are over one session,
whose length is bounded by its conversation, never by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as X

# Budgets in tokens, rounds kept verbatim, admission thresholds.
WINDOW_TOKENS, OUTPUT_TOKENS, RETRIEVAL_TOKENS, MARGIN_TOKENS, RATIO = 32768, 4096, 4096, 2048, 0.8
RECENT_ROUNDS, SUMMARY_TOKENS = 3, 2048
MIN_CONFIDENCE, MIN_RELEVANCE, CONTENT_CHARS, EVIDENCE_CHARS = 0.7, 0.2, 2000, 400


# Words that a memory must not hold.
SENSITIVE = ("身份证", "手机号", "手机号码", "住址", "家庭住址", "银行卡", "密码", "密钥", "api key", "apikey", "token", "病历", "诊断")


def dialogue(messages: DataFrame) -> DataFrame:
    """User and assistant rows with their ordinal."""
    each = W.partitionBy("session").orderBy("seq")
    return messages.filter(F.col("role").isin("user", "assistant")).withColumn("ordinal", F.row_number().over(each))


def sequenced(messages: DataFrame) -> DataFrame:
    """message_seq, gap-free from 1 in each session by ``seq``."""
    return messages.withColumn("message_seq", F.row_number().over(W.partitionBy("session").orderBy("seq")).cast("long"))


def gap_free(messages: DataFrame, first: int = 1) -> DataFrame:
    """The rows of sessions whose sequence has no gap; any gap drops the session."""
    each = W.partitionBy("session")
    ordered = messages.withColumn("at", F.row_number().over(each.orderBy("seq")))
    return ordered.withColumn("ok", F.min((F.col("seq") - first + 1 == F.col("at")).cast("int")).over(each)).filter("ok = 1").drop("at", "ok")


def sequence_gaps(messages: DataFrame) -> DataFrame:
    """Per session the messages, the gaps and the first number missing."""
    each = W.partitionBy("session").orderBy("seq")
    steps = messages.withColumn("missing", F.col("seq") - F.coalesce(F.lag("seq").over(each), F.col("seq") - 1) - 1)
    first = F.min(F.when(F.col("missing") > 0, F.col("seq") - F.col("missing")))
    return steps.groupBy("session").agg(F.count("*").alias("n"), F.count_if(F.col("missing") > 0).alias("gaps"), first.alias("first_missing"))


def boundary(messages: DataFrame, rounds: int = RECENT_ROUNDS) -> DataFrame:
    """The last message before the ``rounds``-th latest user message; no row with fewer rounds."""
    later = W.partitionBy("session").orderBy(F.desc("seq"))
    turns = messages.withColumn("users", F.sum((F.col("role") == "user").cast("int")).over(later))
    start = turns.filter((F.col("role") == "user") & (F.col("users") == rounds)).select("session", F.col("seq").alias("start"))
    before = messages.join(start, "session").filter("seq < start")
    return before.groupBy("session").agg(F.max("seq").alias("through_seq"), F.count("*").alias("n_prefix"))


def tail(messages: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Messages after a session's boundary; all where it has none or one that is no message."""
    valid = boundaries.join(messages.select("session", F.col("seq").alias("through_seq")), ["session", "through_seq"], "left_semi").select("session", "through_seq")
    return messages.join(valid, "session", "left").filter("through_seq IS NULL OR seq > through_seq").drop("through_seq")


def token_totals(messages: DataFrame) -> DataFrame:
    """Estimated tokens a session."""
    return messages.groupBy("session").agg(F.count("*").alias("n"), F.sum(X.token_estimate(F.col("text"))).alias("tokens"))


def budget(totals: DataFrame, window: int = WINDOW_TOKENS, reserves: int = OUTPUT_TOKENS + RETRIEVAL_TOKENS + MARGIN_TOKENS, ratio: float = RATIO) -> DataFrame:
    """Whether a context triggers compaction, and whether it is over the budget."""
    available = window - reserves
    return totals.withColumns({"available": F.lit(available), "compact": F.col("tokens") >= int(available * ratio), "over": F.col("tokens") >= available})


def rendered(messages: DataFrame) -> DataFrame:
    """A session as text, one labelled message a line, in order."""
    label = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    line = F.concat(label, F.lit(": "), F.coalesce("text", F.lit("")))
    return messages.select("session", "seq", line.alias("line")).groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda m: m["line"]), "\n").alias("dialogue"))


def trimmed(messages: DataFrame, limit: int = 7) -> DataFrame:
    """Sessions of more than 7 messages keep the first and the last 6 or 7, by parity."""
    each = W.partitionBy("session")
    rows = messages.withColumns({"n": F.count("*").over(each), "at": F.row_number().over(each.orderBy("seq"))})
    last = F.when(F.col("n") % 2 == 0, 6).otherwise(7)
    return rows.filter((F.col("n") <= limit) | (F.col("at") == 1) | (F.col("at") > F.col("n") - last)).drop("n", "at")


def latest_dialogue(messages: DataFrame, n: int) -> DataFrame:
    """the last n messages that are not blank."""
    rows = messages.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    return rows.withColumn("back", F.row_number().over(W.partitionBy("session").orderBy(F.desc("seq"))).cast("long")).filter(F.col("back") <= n)


def expired(expires_at: Column, now: Column) -> Column:
    """F8: an instant at or before now; what cannot be read has not expired."""
    return F.coalesce(F.try_to_timestamp(expires_at) <= now, F.lit(False))


def admissible(items: DataFrame, sensitive: Sequence[str] = SENSITIVE) -> DataFrame:
    """active items with content and evidence, confident enough, without sensitive words."""
    text = F.lower(F.concat_ws(" ", "content", "evidence"))
    clean = F.lit(True)
    for word in sensitive:
        clean = clean & ~text.contains(word)
    full = (F.trim(F.coalesce("content", F.lit(""))) != "") & (F.trim(F.coalesce("evidence", F.lit(""))) != "")
    return items.filter(full & (F.col("status") == "active") & (F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)) >= MIN_CONFIDENCE) & clean)


def runtime_memories(items: DataFrame, k: int = 5) -> DataFrame:
    """Each user's active, confident and relevant items, by score times confidence."""
    kept = items.filter((F.col("status") == "active") & (F.col("confidence") >= MIN_CONFIDENCE) & (F.col("score") >= MIN_RELEVANCE) & (F.trim(F.coalesce("content", F.lit(""))) != ""))
    order = W.partitionBy("user_id").orderBy(F.desc(F.col("score") * F.col("confidence")), F.asc("memory_id"))
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def applied_actions(actions: DataFrame) -> DataFrame:
    """The state after a log of create, update, deactivate and delete actions.

    Actions are rows (memory_id, seq, action, content, at).  The last action
    decides; content is the last one given; a deactivated item keeps its
    content; created_at stays that of the first action since the last delete.
    """
    each = W.partitionBy("memory_id").orderBy("seq")
    cut = actions.withColumn("life", F.sum((F.col("action") == "delete").cast("int")).over(each.rowsBetween(W.unboundedPreceding, -1)))
    cut = cut.withColumn("life", F.coalesce("life", F.lit(0)))
    lives = cut.groupBy("memory_id", "life").agg(
        F.max_by("action", "seq").alias("last"), F.max_by(F.col("content"), F.when(F.col("content").isNotNull(), F.col("seq"))).alias("content"), F.min("at").alias("created_at"), F.max("at").alias("updated_at")
    )
    last = lives.withColumn("r", F.row_number().over(W.partitionBy("memory_id").orderBy(F.desc("life")))).filter("r = 1 AND last <> 'delete'")
    return last.select("memory_id", F.when(F.col("last") == "deactivate", "inactive").otherwise("active").alias("status"), "content", "created_at", "updated_at")


def snapshot_checks(snapshots: DataFrame, messages: DataFrame) -> DataFrame:
    """Which summaries may be saved: the boundary is a message, goes forward, text fits."""
    known = messages.select("session", F.col("seq").alias("through_seq"), F.lit(True).alias("is_message")).distinct()
    rows = snapshots.join(known, ["session", "through_seq"], "left")
    text = F.trim(F.coalesce("summary", F.lit("")))
    tokens = F.ceil(F.octet_length(text) / 3)
    forward = F.col("saved_seq").isNull() | (F.col("through_seq") >= F.col("saved_seq"))
    return rows.withColumn("accepted", F.coalesce("is_message", F.lit(False)) & forward & (text != "") & (tokens <= SUMMARY_TOKENS)).drop("is_message")


def clean_list(values: Column, limit: int = 8, chars: int = 180) -> Column:
    """Items clipped, blank ones dropped, distinct without regard to case, the first 8."""
    items = F.filter(F.transform(values, lambda v: X.clip(v, chars)), lambda v: v != "")
    low = F.transform(items, lambda v: F.lower(v))
    first = F.filter(items, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)
    return F.slice(first, 1, limit)


def without_rejected(hypotheses: Column, rejected: Column) -> Column:
    """Hypotheses that neither contain nor lie in a rejected one."""
    return F.filter(hypotheses, lambda h: ~F.exists(rejected, lambda r: F.lower(h).contains(F.lower(r)) | F.lower(r).contains(F.lower(h))))
