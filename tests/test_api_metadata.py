"""What metadata may leave the service."""

import json

from pyspark.sql import functions as F

from tessera.operators.ingest import api_metadata, api_metadata_json


def test_trace_keys_go_at_any_depth(spark):
    given = [
        {"intent": "a", "query": "secret", "top_hits": [{"chunk_id": 1, "trace": {"x": 1}, "more": [[{"recall": 1, "ok": None}], "text"]}], "other": 1},
        {"doc_id": None, "timeout": False, "degraded": {"request_id": 1}}, {"query": 1}, {}, [1], "text", 5, None,
    ]
    texts = [json.dumps(g) for g in given] + ["{broken", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.o and json.loads(r.o) for r in df.orderBy("i").select(api_metadata_json(F.col("t")).alias("o")).collect()]
    assert got == [{"intent": "a", "top_hits": [{"chunk_id": 1, "more": [[{"ok": None}], "text"]}]}, {"doc_id": None, "timeout": False, "degraded": {}}] + [None] * 9


def test_typed_columns(spark):
    kind = "query_id int, intent string, secret string, top_hits array<struct<chunk_id:int,trace:string,inner:struct<session_id:string>>>, warnings map<string,struct<recall:int,text:string>>, degraded struct<request_id:int>"
    rows = [(1, "a", "s", [(7, "t", ("x",)), None], {"trace": (1, "no"), "w": (2, "yes"), "n": None}, (5,)), (2, None, None, None, None, None)]
    got = api_metadata(spark.createDataFrame(rows, kind))
    assert got.columns == ["query_id", "intent", "top_hits", "warnings"]
    first, second = got.orderBy("query_id").collect()
    assert [h and h.asDict() for h in first.top_hits] == [{"chunk_id": 7}, None] and {k: v and v.text for k, v in first.warnings.items()} == {"w": "yes", "n": None}
    assert (second.intent, second.top_hits, second.warnings) == (None, None, None)
