"""Token count rollups maintained by deltas (operator 2).

A store has two tables, both partitioned by batch.  ``facts`` holds what a batch
says of a document under a tokenizer version: its group and count, or that it
was deleted.  ``deltas`` holds the signed change of each group's totals: new
values count up, the values that they replace count down.  Totals are sums of
deltas, so a batch costs its own rows and one look at the facts that it
replaces, never a new count of the corpus.

A batch is committed once: its facts are written, then its deltas, and the
success mark of the deltas is the commit.  A batch that was committed before is
left as it is when it comes again, and one that broke off is written anew, so a
batch can be sent as often as needed.  Batches are numbered upwards.

Defined results: a null text counts 0 tokens; a null source or language is a
group of its own; a change whose doc_id is null is ignored, for nothing could
revise it later; of several changes to a document in one batch the one of the
highest ``seq`` holds, deletions after counts at equal ``seq``, then the larger
count; deleting what is not there changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_token_counts
from .common import materialize, scratch

GROUP = ["source", "lang", "tokenizer"]
FACTS = "doc_id long, tokenizer string, source string, lang string, n_tokens long, deleted boolean, batch_id long"
DELTAS = "source string, lang string, tokenizer string, d_docs long, d_tokens long, batch_id long"
#: The tokenizer version of the query.
VERSION = "byte_bpe_50k/1"


class TokenCountStore:
    """Rollups by source, language and tokenizer version in a folder of the shared store."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def committed(self) -> list[int]:
        """The numbers of committed batches, ascending."""
        path = self._path("deltas")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [str(s.getPath().getName()) for s in fs.listStatus(path)]
        return sorted(int(n.partition("=")[2]) for n in found if n.startswith("batch=") and fs.exists(self._path(f"deltas/{n}/_SUCCESS")))

    def _read(self, name: str, schema: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{name}/batch={b}" for b in batches))

    def facts(self, batches: list[int] | None = None) -> DataFrame:
        """The present count of every document and tokenizer version."""
        rows = self._read("facts", FACTS, self.committed() if batches is None else batches)
        last = rows.groupBy("doc_id", "tokenizer").agg(F.max(F.struct("batch_id", "source", "lang", "n_tokens", "deleted")).alias("f"))
        return last.filter("NOT f.deleted").select("doc_id", "tokenizer", "f.source", "f.lang", "f.n_tokens")

    def commit(self, batch_id: int, changes: DataFrame) -> bool:
        """Apply a batch; False if it was committed before.

        ``changes`` has doc_id, tokenizer, source, lang, n_tokens, deleted and,
        optionally, seq.
        """
        done = self.committed()
        if batch_id in done:
            return False
        if done and batch_id < done[-1]:
            raise ValueError(f"batch {batch_id} comes after batch {done[-1]}")
        seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
        rows = changes.filter("doc_id IS NOT NULL").select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("tokenizer").cast("string").alias("tokenizer"), seq.alias("seq"), F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), "source", "lang"
        )
        last = rows.groupBy("doc_id", "tokenizer").agg(F.max(F.struct("seq", "deleted", "n_tokens", "source", "lang")).alias("c"))
        new = last.select("doc_id", "tokenizer", "c.source", "c.lang", "c.n_tokens", "c.deleted", F.lit(batch_id).cast("long").alias("batch_id"))
        new.write.mode("overwrite").parquet(f"{self.folder}/facts/batch={batch_id}")
        new = self._read("facts", FACTS, [batch_id])
        up = new.filter("NOT deleted").select(*GROUP, F.lit(1).alias("d"), "n_tokens")
        if done:
            old = self.facts(done).join(new.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_semi")
            up = up.unionByName(old.select(*GROUP, F.lit(-1).alias("d"), (-F.col("n_tokens")).alias("n_tokens")))
        deltas = up.groupBy(*GROUP).agg(F.sum("d").alias("d_docs"), F.sum("n_tokens").alias("d_tokens"))
        deltas.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={batch_id}")
        return True

    def rollup(self, batches: list[int] | None = None) -> DataFrame:
        """source, lang, tokenizer, n_docs and n_tokens of every group that has documents, after all batches or some."""
        totals = self._read("deltas", DELTAS, self.committed() if batches is None else batches).groupBy(*GROUP).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return totals.filter("n_docs <> 0 OR n_tokens <> 0")


def bpe_changes(docs: DataFrame, version: str = VERSION) -> DataFrame:
    """The changes that insert documents, or revise them, with their byte-level BPE counts."""
    return bpe_token_counts(docs, ["doc_id", "source", "lang"]).select("doc_id", F.lit(version).alias("tokenizer"), "source", "lang", "n_tokens", F.lit(False).alias("deleted"))


def token_count_rollup(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Totals by source, language and tokenizer version, as inserted (``n_docs_before``, ``n_tokens_before``) and after a second batch.

    The first batch inserts every document.  The second one, sent twice and
    applied once, deletes those labelled of low quality and revises the toxic
    ones: their texts lose all digits and are encoded again.  A row without
    doc_id is no document of the store; a document without labels stays; a group
    that loses its last document has 0 after.
    """
    spark = docs.sparkSession
    store = TokenCountStore(spark, scratch(spark, "counts"))
    store.commit(1, bpe_changes(docs))
    before = store.rollup([1])
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).filter("quality = 0 OR toxic = 1")
    marks = marks.select("doc_id", (F.coalesce("quality", F.lit(1)) == 0).alias("drop"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("text").cast("string").alias("text"))
    slim = slim.join(marks.filter("NOT drop").hint("merge"), "doc_id")  # labels grow with the documents: never broadcast
    revised = bpe_changes(slim.withColumn("text", F.regexp_replace("text", "[0-9]", "")))
    dropped = store.facts().join(marks.filter("drop"), "doc_id").select("doc_id", "tokenizer", "source", "lang", "n_tokens", F.lit(True).alias("deleted"))
    changes = materialize(revised.unionByName(dropped), f"{store.folder}/changes")
    for _ in range(2):
        store.commit(2, changes)
    after = store.rollup().select(*(F.col(c).alias(f"{c}_") for c in GROUP), "n_docs", "n_tokens")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in GROUP]
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return before.withColumnsRenamed({"n_docs": "n_docs_before", "n_tokens": "n_tokens_before"}).join(after, same, "left").select(*GROUP, "n_docs_before", "n_tokens_before", zero("n_docs"), zero("n_tokens"))
