"""What the corpus operators share: reading tables, shared scratch space, columns.

Scratch space is a folder under ``spark.checkpoint.dir``.  On a cluster that
setting names a store which the driver and all executors see; where it is unset
a folder of this machine is used, on a local master only.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, set to a local one only where unset."""
    found = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not jvm_dir.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_CHECKPOINT_KEY} must name a folder that all executors share")
        found = jvm_dir.get() if jvm_dir.isDefined() else tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set(_CHECKPOINT_KEY, found)
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder for one run of one operator."""
    return f"{shared_dir(spark)}/tessera-{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a table and read it back: its lineage ends there."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table between stages that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished plans: Spark removes them once its objects are collected."""
    gc.collect()
    spark._jvm.System.gc()


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Only the id and the text, under fixed names; with ``carry`` the whole row as one struct too.

    Operators start from this projection, so that columns which happen to be
    named like one of an operator's own columns cannot clash with them.
    """
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *row)


def carried(df: DataFrame) -> list[str]:
    """The carried row, if there is one: to name in a projection."""
    return ["row"] if "row" in df.columns else []


def held_out(id_column: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves remainder 0; a null id is held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % F.lit(folds) == 0, F.lit(True))
