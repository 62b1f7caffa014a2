"""Retrieval that goes on when a part of it fails or is late (R14), with channels and rerankers by name.

A stage runs in a thread of its own under a job tag.  If it raises, or has not
written its rows within the limit, its jobs are cancelled, a warning is kept
and the documented fallback takes its place.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from tessera.operators import retrieval as R
from tessera.plans import retrieve as P
from tessera.plans.hooks import providers, rerankers
from tessera.sources.store import shared_folder, stored

#: A recall channel: (chunks, queries, fetch) to (query_id, chunk_id, score, rank).
Channel = Callable[[DataFrame, DataFrame, int], DataFrame]
EVIDENCE = "query_id {}, chunk_id {}, rank long, role string"


def attempted(spark: SparkSession, make: Callable[[], DataFrame], what: str, seconds: float | None = None) -> tuple[DataFrame | None, str | None]:
    """The rows of ``make`` written to the shared folder, or None and a warning.

    What has started no job, a hook that waits on the driver, cannot be ended:
    its thread is left behind and its rows are not read.
    """
    shared_folder(spark)
    sc, tag, out = spark.sparkContext, f"tessera-{what}-{uuid.uuid4().hex}".replace(" ", "-"), {}

    def run() -> None:
        sc.addJobTag(tag)
        try:
            out["rows"] = stored(make(), what.replace(" ", "-"))
        except Exception as e:  # noqa: BLE001  a stage's failure is data here
            out["error"] = (str(e).strip() or type(e).__name__).splitlines()[0]

    thread = threading.Thread(target=inheritable_thread_target(spark)(run), daemon=True)
    thread.start()
    thread.join(seconds)
    if "rows" in out:
        return out["rows"], None
    if "error" in out:
        return None, f"{what} failed: {out['error']}"
    sc.cancelJobsWithTag(tag)
    return None, f"{what} failed: no answer within {seconds:g} s"


def retrieve(
    chunks: DataFrame, queries: DataFrame, channel: Channel | str | None = None, reranker: P.Reranker | str | None = None, top_k: int = 3, fetch: int | None = None, seconds: float | None = None
) -> tuple[DataFrame, list[str]]:
    """The evidence of every query (query_id, chunk_id, rank, role) and the warnings.

    ``channel`` and ``reranker`` are hooks or names of registered ones; an
    unknown name is the caller's error.  A channel that fails leaves the BM25
    and scan channels, a reranker that fails leaves the fused order, a recall
    or evidence stage that fails leaves no rows.  ``seconds`` limits each stage.
    """
    spark, warnings = chunks.sparkSession, []
    channel = providers.get(channel) if isinstance(channel, str) else channel
    if isinstance(reranker, str) and reranker not in ("none", "lexical"):
        reranker = rerankers.get(reranker)

    def stage(make: Callable[[], DataFrame], what: str) -> DataFrame | None:
        rows, warning = attempted(spark, make, what, seconds)
        warnings.extend([warning] if warning else [])
        return rows

    hits = stage(lambda: channel(chunks, queries, fetch or R.fetch_limit()), "recall channel") if channel else None
    candidates = stage(lambda: P.recalled(chunks, queries, hits, fetch), "recall")
    types = [f.dataType.simpleString() for f in (queries.schema["query_id"], chunks.schema["chunk_id"])]
    nothing = spark.createDataFrame([], EVIDENCE.format(*types))
    if candidates is None:
        return nothing, warnings
    fused = P.reranked(candidates, chunks, queries)
    order = fused if reranker in (None, "none") else stage(lambda: P.reranked(candidates, chunks, queries, reranker), "reranker")
    found = stage(lambda: P.evidence(fused if order is None else order, chunks, top_k), "evidence")
    return (nothing if found is None else found), warnings
