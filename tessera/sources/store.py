"""Tables between the stages of a plan, in the shared folder of the session.

``spark.checkpoint.dir`` names a folder that the driver and all executors see.
Where it is unset a folder of this machine is used, on a local master only: on
a cluster the tables would be lost between machines, so that is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder; set to a local one where it is unset and the master is local."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not found:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            found = set_before.get()
        elif spark.sparkContext.master.startswith("local"):
            found = tempfile.mkdtemp(prefix="tessera-shared-")
        else:
            raise RuntimeError(f"{_KEY} must name a folder that all executors share")
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written and read back: it is worked out once, however many stages read it."""
    path = f"{shared_folder(df.sparkSession)}/tessera-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(table: DataFrame) -> None:
    """The folder of a table that ``stored`` has made is removed; nothing may read it any more."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("tessera-"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
