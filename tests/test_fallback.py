"""R14 with hooks that raise and hang: the documented fallback and a warning."""

import time

import pytest
from pyspark.sql import functions as F

from tessera.plans import fallback, hooks
from tessera.plans import retrieve as P


@pytest.fixture(scope="module")
def tables(spark):
    rows = [("s", None, "support", "pump guide"), ("a", "s", "primary", "replace the pump filter"), ("b", "s", "primary", "clean the pump"), ("c", None, "primary", "saw blades")]
    chunks = spark.createDataFrame(rows, "chunk_id string, parent_id string, tier string, text string")
    return chunks, spark.createDataFrame([(1, "replace pump filter"), (2, "saw"), (3, None)], "query_id long, text string")


def told(df):
    return sorted(map(tuple, df.select("query_id", "chunk_id", "rank", "role").collect()))


def raising(*_):
    raise RuntimeError("model is away")


def hanging(rows):
    def wait(batches):
        time.sleep(600)
        yield from batches

    return rows.select("query_id", "chunk_id", F.lit(1.0).alias("score")).mapInArrow(wait, "query_id long, chunk_id string, score double")


def test_without_failures_it_is_the_plain_retrieval(tables):
    found, warnings = fallback.retrieve(*tables)
    assert warnings == [] and told(found) == told(P.retrieve(*tables)) != []


def test_a_raising_reranker_and_channel(tables):
    found, warnings = fallback.retrieve(*tables, channel=raising, reranker=raising)
    assert warnings == ["recall channel failed: model is away", "reranker failed: model is away"]
    assert told(found) == told(P.retrieve(*tables))


def test_a_hanging_reranker_is_cancelled(tables, spark):
    candidates, begun = P.recalled(*tables), time.time()
    rows, warning = fallback.attempted(spark, lambda: P.reranked(candidates, *tables, hanging), "reranker", 12)
    assert rows is None and warning == "reranker failed: no answer within 12 s" and time.time() - begun < 30
    for _ in range(40):
        if not spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        time.sleep(0.5)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_registered_names(tables, monkeypatch):
    chunks, queries = tables
    monkeypatch.setattr(hooks.providers, "_held", {})
    hooks.providers.add("mine", lambda chunks, queries, fetch: queries.filter("query_id = 3").select("query_id", F.lit("c").alias("chunk_id"), F.lit(0.9).alias("score"), F.lit(1).cast("long").alias("rank")))
    found, warnings = fallback.retrieve(chunks, queries, channel="mine")
    assert warnings == [] and (3, "c", 1, "primary") in told(found)
    with pytest.raises(KeyError, match="no recall provider is called other"):
        fallback.retrieve(chunks, queries, channel="other")


def test_a_failing_recall_leaves_no_rows(tables):
    chunks, queries = tables
    found, warnings = fallback.retrieve(chunks.withColumn("text", F.raise_error(F.lit("broken table")).cast("string")), queries)
    assert told(found) == [] and len(warnings) == 1 and warnings[0].startswith("recall failed: ")
