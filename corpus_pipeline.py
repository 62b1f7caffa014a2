"""The corpus pipeline: quality, near duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and
read again before the next one.  A row whose doc_id is null keeps its place:
where a stage must match rows to its findings it goes by the text instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from tessera.llm.bpe import bpe_encode_rows
from tessera.llm.common import materialize, scratch, table
from tessera.llm.decontam import decontaminate
from tessera.llm.neardup import near_duplicates
from tessera.llm.pii import pii_spans, redact
from tessera.llm.quality import apply_policy, ledger


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy keeps, as they are; a null or empty text has too few words.  No rows give none."""
    return apply_policy(ledger(docs, carry=True)).filter("kept").select("row.*")


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least doc_id, once.

    Of rows that share a kept doc_id the least stays, by its columns in order,
    text first.  Null and empty texts are no duplicates; rows whose doc_id is
    null stay; no rows give none.
    """
    found = near_duplicates(docs)
    marks = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    marks = materialize(marks.filter("NOT kept OR n > 1").select("doc_id", "kept"), f"{scratch(spark, 'rejected')}/ids")
    single = docs.join(marks, "doc_id", "left_anti").select(*docs.columns)
    order = [F.col("text"), *(F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != "text" and not isinstance(f.dataType, MapType | VariantType))]
    repeated = docs.join(marks.filter("kept").select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct(*order)).alias("row"))
    return single.unionAll(repeated.select("row.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark; a null or empty text has none, no rows give none."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    slim = docs.select(key.alias("doc_id"), "text")
    hit = decontaminate(slim, table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id").distinct()
    hit = materialize(hit.select(F.col("doc_id").alias("hit_key")), f"{scratch(spark, 'contaminated')}/ids")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))
    return row.join(hit, F.col("key") == F.col("hit_key"), "left_anti").select("row.*")


def personal_data_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data in its text replaced by the kind; n_chars follows.

    A null text stays null; no rows give none.
    """
    clean = redact(pii_spans(docs, carry=True))
    text = F.when(F.col("row.text").isNotNull(), F.col("text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return clean.select(*(new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with the text's ids, their count and both digests.

    A null or empty text has no ids; no rows give none.
    """
    return bpe_encode_rows(docs, ["doc_id", "lang", "source"])


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_removal),
    ("decontamination", benchmark_decontamination),
    ("personal_data", personal_data_removal),
    ("byte_bpe", byte_bpe),
]

#: SQL cannot express near duplicates by component or the byte-pair merges; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each is written and read again."""
    folder = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"{folder}/{i}-{name}")
    return docs
