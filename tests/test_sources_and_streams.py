import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import files as S
from tessera.streaming import twins as T


def test_json_lines_modes(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"chunk_id": "1", "text": "x"}\n\n{broken\n{"chunk_id": "2", "text": "y"}\n')
    schema = "chunk_id string, text string"
    with pytest.raises(Exception, match="(?i)malformed|parse|failfast"):
        S.read_jsonl(spark, str(path), schema).collect()
    assert S.read_jsonl(spark, str(path), schema, "drop").filter("chunk_id IS NOT NULL").count() == 2
    bad = [r for r in S.read_jsonl(spark, str(path), schema, "tolerant").collect() if r.parse_error]
    assert len(bad) == 1 and bad[0].parse_error == "{broken"
    assert [r.line for r in S.last_lines(spark, str(path), 1).collect()] == ['{"chunk_id": "2", "text": "y"}']


def test_a_file_of_many_splits_is_numbered_whole(spark, tmp_path):
    texts = {"a.txt": "".join(f"line {i}{' é' * (i % 7)}" + ("\r\n" if i % 3 else "\n") for i in range(3000)) + "end", "b.txt": "\n\nx\n", "c.txt": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        rows = S.numbered_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 5
        got = sorted((r.path.rsplit("/", 1)[1], r.line_no, r.line) for r in rows.collect())
        lines = {n: [x.removesuffix("\r") for x in t.removesuffix("\n").split("\n")] if t else [] for n, t in texts.items()}
        assert got == [(n, i, x) for n, held in lines.items() for i, x in enumerate(held, 1)]
        assert [(r.line_no, r.line) for r in S.last_lines(spark, str(tmp_path / "a.txt"), 2).collect()] == [(3000, lines["a.txt"][2999]), (3001, "end")]
        bad = tmp_path / "bad.jsonl"
        bad.write_text("".join('{"k": 1}\n' for _ in range(2000)) + "{broken\n")
        with pytest.raises(Exception, match="bad.jsonl:2001: invalid JSON"):
            S.read_jsonl_located(spark, str(bad), "k int").collect()
        assert [r.line_no for r in S.last_records(spark, str(bad), "k int", 2).collect()] == [1999, 2000]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_questions(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_bytes("﻿id,question,images\n3,c,\nx,bad,\n1,a,\n2, ,\n4,d,\n".encode())
    assert [r.id for r in S.read_questions(spark, str(path)).collect()] == [1, 3, 4]
    assert [r.id for r in S.read_questions(spark, str(path), 2, 4).collect()] == [3, 4]
    assert [r.id for r in S.read_questions(spark, str(path), limit=2).collect()] == [1, 3]


def test_manifests_caches_and_metrics(spark, tmp_path):
    for name, rows in (("b", "image_id,path\ni1,b/1.png\ni2,/etc/x\n"), ("a", "image_id,path\ni1,a/1.png\ni3,../x.png\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "images_manifest.csv").write_text(rows)
    assert [tuple(r) for r in S.read_manifests(spark, str(tmp_path)).collect()] == [("i1", "a/1.png")]
    cache = tmp_path / "tool_cache.json"
    cache.write_text(json.dumps({'Get:{"a": "1"}': "out", "List:{}": "all"}))
    assert [(r.tool, r.args, r.output) for r in S.read_tool_cache(spark, str(cache)).orderBy("position").collect()] == [("Get", {"a": "1"}, "out"), ("List", {}, "all")]
    wide = tmp_path / "m.csv"
    wide.write_text("time,svc-cpu,svc-mem\n1,2,x\n2,4,5\n")
    from tessera.operators.ops import chosen_series, metric_summary, unpivoted

    long = unpivoted(S.read_wide_metrics(spark, str(wide)))
    assert [r.series for r in chosen_series(long, "svc", "cpu overload").collect()] == ["svc-cpu"]
    assert {r.series: r.samples for r in metric_summary(long).collect()} == {"svc-cpu": 2, "svc-mem": 1}


def test_slices_projection_and_quarantine(spark):
    text = spark.createDataFrame([("a\nb\r\nc\nd",)], "t string")
    cut = lambda a, b: text.select(S.line_slice(F.col("t"), F.lit(a), F.lit(b)).alias("o")).first().o
    assert (cut(2, 3), cut(0, 1), cut(3, 99), cut(9, 10)) == ("b\nc", "a", "c\nd", "")
    chunks = spark.createDataFrame([("x", ["A", "B"], None, None, ["p"]), (" ", [], "t", "i", None)], "text string, section_path array<string>, title string, index_text string, pic_ids array<string>")
    assert [(r.section_title, r.index_text, r.char_count, r.pic_count) for r in S.projected_chunks(chunks).collect()] == [("B", "x", 1, 1)]
    raw = spark.createDataFrame([('{"chunk_type": null}',), ('{"text": "x"}',), ("no json",)], "j string")
    assert [r.o for r in raw.select(S.is_structured(F.col("j")).alias("o")).collect()] == [True, False, False]
    good, bad = S.quarantine_split(spark.createDataFrame([("1", "x"), ("", "x"), ("2", " "), ("3", "é" * 5)], "chunk_id string, text string"), 9)
    assert [r.chunk_id for r in good.collect()] == ["1"] and sorted(r.reason for r in bad.collect()) == ["no_id", "no_text", "too_long"]


def test_documents_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "table")
    make = lambda rows: spark.createDataFrame(rows, "doc_id string, chunk_id string")
    S.replace_documents(make([("a", "1"), ("a", "2"), ("b", "3")]), path)
    S.replace_documents(make([("a", "9")]), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("doc_id", "chunk_id").collect()) == [("a", "9"), ("b", "3")]


def test_streams_equal_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    source = str(tmp_path / "in")
    messages = events.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"))
    messages.repartitionByRange(3, "seq").write.parquet(source)

    def run(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
        return spark.table(name)

    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = run(T.numbered_messages(stream), "numbered")
    per = {r.session: (r.n, r.top) for r in got.groupBy("session").agg(F.count("*").alias("n"), F.max("message_seq").alias("top")).collect()}
    assert got.count() == events.count() and all(n == top for n, top in per.values())
    samples = events.select(F.lit("cpu").alias("metric"), "value", "event_id")
    samples.write.parquet(str(tmp_path / "s"))
    alerts = run(T.threshold_alerts(spark.readStream.schema(samples.schema).parquet(str(tmp_path / "s"))), "alerts")
    assert alerts.count() == events.filter("round(value, 1) > 80").count()
