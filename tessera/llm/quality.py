"""Quality rules as a ledger of bits (operator 6), in DataFrame functions only.

``ledger`` measures a document once and evaluates every rule once: measurements
and one integer whose bit ``i`` says that rule ``i`` failed.  A policy is a
version with the mask of the rules that reject; ``apply_policy`` is one bitwise
AND, so a new policy needs no text, and ``ablations`` counts from the ledger
what each rule of a policy rejects, alone or with others.

Repeated windows are found without leaving the row: three-word windows are
64-bit hashes; a text whose hashes are all distinct is done at once, one with a
few repeated values looks them up, and one with many sorts (hash, place).

Defined results: a null or empty text has no words and fails the word count; a
null doc_id is returned as null; repeated rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, documents

#: Fixed by the contract: the separators of words, the symbol characters, the base rules' bounds.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
NOT_SYMBOL = r"[^#*$%&|<>]+"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Up to so many distinct repeated windows are looked up one by one.
FEW = 24


@dataclass(frozen=True)
class Rule:
    """A rule fails where its condition, over the measurements, is true."""

    name: str
    fails: str


#: The order is the order of the bits and never changes; new rules go to the end.
RULES = (
    Rule("few_words", f"n_words < {MIN_WORDS}"),
    Rule("repeated_windows", f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "10 * word_chars < 20 * n_words"),
    Rule("long_words", "10 * word_chars > 200 * n_words"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}

#: Versions of policies; a published version never changes.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "clean-1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words"),
}
DEFAULT_POLICY = "clean-1"


def policy_mask(version: str) -> int:
    return sum(BIT[name] for name in POLICIES[version])


def _repeat_words(windows: str, repeated: str) -> Column:
    """Words inside windows of three whose hash occurs at least twice."""
    at = F.transform(F.col(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    looked_up = F.filter(at, lambda s: F.array_contains(F.col(repeated), s["h"]))
    starts = F.when(F.size(repeated) <= FEW, F.transform(looked_up, lambda s: s["i"])).otherwise(
        F.expr(
            f"transform(flatten(transform(array(array_sort(transform({windows}, (h, i) -> struct(h AS h, i AS i)))), "
            "o -> filter(o, (s, k) -> s.h <=> get(o, k - 1).h OR s.h <=> get(o, k + 1).h))), s -> s.i)"
        )
    )
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))


def measurements(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id and every measurement that the rules use; with ``carry`` also the row as ``row``."""
    cut = documents(docs, carry=carry)
    more = carried(cut)
    cut = cut.select("doc_id", *more, F.coalesce("text", F.lit("")).alias("text"))
    cut = cut.select("doc_id", *more, "text", F.array_remove(F.split("text", SPACE), "").alias("words"), F.filter(F.split("text", "\n"), lambda line: line.rlike(NOT_SPACE)).alias("lines"))
    long = lambda c, name: c.cast("long").alias(name)
    counted = cut.select(
        "doc_id",
        *more,
        long(F.size("words"), "n_words"),
        long(F.length(F.array_join("words", "")), "word_chars"),
        long(F.length(F.regexp_replace("text", NOT_SYMBOL, "")), "n_symbols"),
        long(F.size("lines"), "n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    windowed = counted.withColumn(
        "windows",
        F.when(F.col("n_words") >= 3, F.expr("zip_with(slice(hashes, 1, int(n_words) - 2), zip_with(slice(hashes, 2, int(n_words) - 2), slice(hashes, 3, int(n_words) - 2), (b, c) -> xxhash64(b, c)), (a, bc) -> xxhash64(a, bc))")),
    ).drop("hashes")
    windowed = windowed.withColumn("distinct", F.size(F.array_distinct("windows")))
    ordered = windowed.withColumn("ordered", F.when(F.col("distinct") < F.size("windows"), F.sort_array("windows")))
    found = ordered.withColumn("repeated", F.expr("array_distinct(filter(ordered, (h, k) -> h = get(ordered, k + 1)))")).drop("ordered", "distinct")
    n = F.when(F.size("repeated") > 0, _repeat_words("windows", "repeated")).otherwise(F.lit(0))
    # A later filter on a measurement must not be pushed below this projection:
    # it would be rewritten in terms of the text, with every step many times over.
    n = n + F.monotonically_increasing_id() * 0
    return found.select("doc_id", *more, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", long(n, "n_repeat_words"))


def ledger(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, the measurements and ``failed``, a bit for each rule; with ``carry`` also the row."""
    bits = [F.when(F.expr(rule.fails), F.lit(BIT[rule.name])).otherwise(F.lit(0)).cast("long") for rule in RULES]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measurements(docs, carry).withColumn("failed", failed)


def apply_policy(entries: DataFrame, version: str = DEFAULT_POLICY) -> DataFrame:
    """The ledger with ``kept`` under a policy."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy_mask(version))) == 0)


def ablations(entries: DataFrame, version: str = DEFAULT_POLICY) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and kept without it.

    Ledgers are first counted by their bits: at most 2**rules rows go on.
    """
    counts = entries.select(F.col("failed").bitwiseAND(F.lit(policy_mask(version))).alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in POLICIES[version]])).alias("r")
    each = counts.select("f", "n", rules).select("f", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("f").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("f") == F.col("bit"), F.col("n")).otherwise(0)).alias("rejected_alone"),
        F.sum(F.when(F.col("f").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def quality_digest(docs: DataFrame) -> DataFrame:
    """The rows of the contract, with the ledger's bits."""
    base = F.col("failed").bitwiseAND(F.lit(policy_mask("base-1"))) != 0
    return apply_policy(ledger(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")
