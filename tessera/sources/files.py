"""Readers and writers of JSON lines, JSON, CSV, Markdown and text.

Every reader takes an explicit schema where the format has one; nothing is
inferred from the data, so a scan is one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.text import chunk_key
from tessera.operators.retrieval import bounded_broadcast
from tessera.sources.store import stored

CONTENT_BYTES, METADATA_BYTES, EMBED_CHARS = 8000, 60000, 8192

CHUNK_SCHEMA = (
    "chunk_id string, doc_id string, doc_name string, language string, chunk_type string, retrieval_tier string, section_path array<string>, title string, parent_chunk_id string, chunk_index int, "
    "text string, index_text string, pic_ids array<string>, source_file string, source_lines array<int>, source_quality string, source_issue_flags array<string>, source_issue_note string, item_no string, item_kind string"
)
STRUCTURED_KEYS = ("retrieval_tier", "chunk_type", "section_path", "parent_chunk_id", "index_text")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | StructType, mode: str = "strict") -> DataFrame:
    """JSON lines.

    strict: a bad line fails the read; tolerant: it becomes a row with its raw
    line in ``parse_error``; drop: it is left out.  Blank lines are skipped.
    """
    parsed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if mode == "tolerant":
        parsed = StructType([*parsed.fields]).add("parse_error", "string")
        return spark.read.schema(parsed).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "parse_error").json(path)
    return spark.read.schema(parsed).option("mode", {"strict": "FAILFAST", "drop": "DROPMALFORMED"}[mode]).json(path)


def read_json_document(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One JSON object a file."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records, from one file or a folder of them, at any depth."""
    return spark.read.schema(CHUNK_SCHEMA).option("mode", "FAILFAST").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(path)


def read_text_files(spark: SparkSession, path: str, glob: str = "*.{txt,md,jsonl}") -> DataFrame:
    """Whole files as (path, text)."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_questions(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, limit: int | None = None) -> DataFrame:
    """A question CSV; rows without a number or a question are left out; the limit comes before the sort."""
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    named = raw.select(*(F.col(f"`{c}`").alias(c.replace("﻿", "").strip()) for c in raw.columns))
    rows = named.withColumn("id", F.trim("id").try_cast("long")).filter(F.col("id").isNotNull() & (F.trim(F.coalesce("question", F.lit(""))) != ""))
    rows = rows.filter((F.lit(low is None) | (F.col("id") >= F.lit(low))) & (F.lit(high is None) | (F.col("id") <= F.lit(high))))
    return (rows if limit is None else rows.limit(limit)).orderBy("id")


def read_wide_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A wide CSV of metrics, its columns as strings."""
    raw = spark.read.option("header", "true").csv(path)
    return raw.select(*(F.col(f"`{c}`").alias(c.replace("﻿", "").strip()) for c in raw.columns))


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Image manifests below a folder; the first path of an image wins; paths stay below the root."""
    rows = spark.read.option("header", "true").csv(f"{root}/*/images_manifest.csv").select("image_id", "path", F.col("_metadata.file_path").alias("file"))
    safe = ~F.col("path").startswith("/") & ~F.col("path").rlike(r"(^|/)\.\.(/|$)")
    return rows.filter(safe & (F.trim("image_id") != "")).groupBy("image_id").agg(F.min_by("path", F.struct("file", "path")).alias("path"))


def read_case_metadata(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Every metadata.json below a folder, with its id from the path."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.json").json(root, multiLine=True)
    parts = F.split(F.regexp_replace(F.regexp_replace("_metadata.file_path", "^file:/*", "/"), "/metadata\\.json$", ""), "/")
    skip = len([p for p in root.split("/") if p]) + 1
    return rows.withColumn("case_id", F.array_join(F.slice(parts, skip + 1, 100), "_"))


def read_tool_cache(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of tool results as (position, key, tool, args, output)."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    rows = raw.select(F.posexplode(F.map_entries("m")).alias("position", "e")).select("position", "e.key", F.col("e.value").alias("output"))
    split = F.instr("key", ":")
    return rows.select("position", "key", F.substring("key", F.lit(1), split - 1).alias("tool"), F.from_json(F.substring("key", split + 1, F.lit(1 << 20)), "map<string,string>").alias("args"), "output")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line_no, line) of text files, numbered from 1; a file of any length is read by many tasks.

    A task numbers the lines of each split that it reads; a table of one row a
    split, written first, says how many lines lie before it.  So the files are
    read twice and no line is shuffled while that table has at most
    BROADCAST_ROWS rows.  Splits that are dealt otherwise in the second read
    raise an error.  A line ends with LF or CR LF; after the last one there is
    no further line, and an empty file has none.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    parts = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    counts = parts.groupBy("path", "start").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("path").orderBy("start")) - F.col("n")
    offsets = stored(counts.select("path", "start", before.alias("before")), "splits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            places = []
            for split in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = n + 1 if split == last else 1
                last = split
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=["path", "start", "line", "place"])

    placed = parts.mapInArrow(run, "path string, start long, line string, place long").join(bounded_broadcast(offsets), ["path", "start"], "left")
    line_no = F.when(F.col("before").isNull(), F.raise_error(F.concat(F.lit("the splits of a file have changed: "), "path")).cast("long")).otherwise(F.col("before") + F.col("place"))
    return placed.select("path", line_no.alias("line_no"), F.regexp_replace("line", r"\r\z", "").alias("line"))


def last_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The last n lines of a file that are not blank, in order."""
    rows = numbered_lines(spark, path).filter("trim(line) <> ''").select("line_no", "line")
    return rows.orderBy(F.desc("line_no")).limit(n).orderBy("line_no")


def last_records(spark: SparkSession, path: str, schema: str, n: int) -> DataFrame:
    """The last n lines that parse, as records in order; bad lines do not count."""
    rows = numbered_lines(spark, path).filter("trim(line) <> ''").withColumn("record", F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    good = rows.filter("record._bad IS NULL AND ltrim(line) LIKE '{%'").orderBy(F.desc("line_no")).limit(n).orderBy("line_no")
    return good.select("line_no", "record.*").drop("_bad")


def read_jsonl_located(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines; the first bad line fails the read as ``path:line: invalid JSON``. Blank lines are skipped."""
    rows = numbered_lines(spark, path).filter("trim(line) <> ''").withColumn("record", F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    at = F.format_string("%s:%d: invalid JSON", "path", "line_no")
    bad = F.col("record._bad").isNotNull() | ~F.ltrim("line").startswith("{")
    checked = rows.withColumn("record", F.when(bad, F.raise_error(at).cast(rows.schema["record"].dataType)).otherwise(F.col("record")))
    return checked.select("path", "line_no", "record.*").drop("_bad")


def read_cases(spark: SparkSession, path: str, prefix: str = "case", limit: int | None = None) -> DataFrame:
    """Cases of a JSON lines file, a JSON file or a text file, as position, case_id and query.

    A JSON file is a list, an object with a list under cases, queries, questions
    or items, or one case; a case is an object or its bare question.  A text
    file has a question a line.  Missing ids become the prefix and the position.
    """
    suffix = path.rpartition(".")[2].lower()
    none = F.expr("cast(array() AS array<string>)")
    if suffix == "json":
        whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
        lists = [F.from_json(F.get_json_object("value", f"$.{key}"), "array<string>") for key in ("cases", "queries", "questions", "items")]
        items = F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.coalesce(*lists, F.array("value")))
        rows = whole.select(F.posexplode(F.coalesce(items, none)).alias("i", "item"))
    else:
        lines = numbered_lines(spark, path).filter("trim(line) <> ''")
        rows = lines.select((F.row_number().over(W.partitionBy("path").orderBy("line_no")) - 1).alias("i"), F.trim("line").alias("item"))
    field = lambda name: F.when(F.col("item").startswith("{"), F.get_json_object("item", f"$.{name}"))
    bare = F.when(~F.col("item").startswith("{"), F.regexp_replace("item", r'^"|"$', ""))
    cases = rows.select((F.col("i") + 1).cast("long").alias("position"), F.trim(F.coalesce(field("case_id"), field("id"))).alias("case_id"), F.trim(F.coalesce(field("query"), field("question"), bare)).alias("query"))
    cases = cases.withColumn("case_id", F.coalesce(F.nullif("case_id", F.lit("")), F.format_string(f"{prefix}_%03d", "position")))
    return cases if limit is None else cases.filter(F.col("position") <= limit)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """A summary index (doc, doc_name, title, summary, terms) from a list, an object with ``documents``, or an object by id.

    A plain string under an id is that document's summary.
    """
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    inner = F.when(F.col("value").startswith("["), F.col("value")).otherwise(F.coalesce(F.get_json_object("value", "$.documents"), F.col("value")))
    raw = whole.select(inner.alias("value"))
    listed = raw.filter("value LIKE '[%'").select(F.lit(None).cast("string").alias("key"), F.explode(F.from_json("value", "array<string>")).alias("item"))
    mapped = raw.filter("value LIKE '{%'").select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "item"))
    rows = listed.unionByName(mapped)
    field = lambda name: F.when(F.col("item").startswith("{"), F.get_json_object("item", f"$.{name}"))
    plain = F.when(~F.col("item").startswith("{"), F.col("item"))
    terms = F.coalesce(F.from_json(field("terms"), "array<string>"), F.expr("cast(array() AS array<string>)"))
    made = rows.select(F.trim(F.coalesce(field("doc_id"), F.col("key"))).alias("doc"), field("doc_name").alias("doc_name"), field("title").alias("title"), F.coalesce(field("summary"), plain).alias("summary"), terms.alias("terms"))
    return made.filter("doc <> ''")


def line_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last, from 1 and inclusive, clamped to the text."""
    lines = F.split(text, "\r?\n")
    low = F.greatest(first, F.lit(1))
    return F.array_join(F.slice(lines, low, F.greatest(F.least(last, F.size(lines)) - low + 1, F.lit(0))), "\n")


def projected_chunks(chunks: DataFrame) -> DataFrame:
    """Chunk records as documents; records without text are left out."""
    text = F.col("text")
    rows = chunks.filter(F.trim(F.coalesce(text, F.lit(""))) != "")
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.try_element_at("section_path", F.lit(-1)), F.lit(""))
    extra = {"index_text": F.coalesce(F.nullif(F.trim("index_text"), F.lit("")), text), "section_title": title, "char_count": F.length(text), "pic_count": F.when(F.col("pic_ids").isNotNull(), F.size("pic_ids")).otherwise(0)}
    return rows.withColumns(extra)


def is_structured(raw_json: Column) -> Column:
    """A record is structured iff it has any of five keys, a null value included."""
    keys = F.json_object_keys(raw_json)
    return F.coalesce(F.arrays_overlap(keys, F.array(*(F.lit(k) for k in STRUCTURED_KEYS))), F.lit(False))


def quarantine_split(rows: DataFrame, max_bytes: int = CONTENT_BYTES) -> tuple[DataFrame, DataFrame]:
    """K2, K3: rows that can be inserted, and the others with a reason."""
    reason = F.when(chunk_key(F.col("chunk_id")).isNull(), "no_id").when(F.trim(F.coalesce("text", F.lit(""))) == "", "no_text").when(F.octet_length("text") > max_bytes, "too_long")
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def embed_text(text: Column) -> Column:
    """K3: what is sent to an embedding model at last: trimmed, at most 8192 characters."""
    return F.substring(F.trim(text), 1, EMBED_CHARS)


def replace_documents(rows: DataFrame, path: str) -> None:
    """K4: replace whole documents: the partitions of the doc_ids in ``rows``, no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)


def write_ordered_jsonl(rows: DataFrame, path: str, first: list[str]) -> None:
    """K7, K8: JSON lines, known fields first, the others after."""
    rows.select(*(c for c in first if c in rows.columns), *(c for c in rows.columns if c not in first)).write.mode("overwrite").json(path)


def write_answers(rows: DataFrame, path: str) -> None:
    """K9: id, question and ret as CSV, ordered by id."""
    rows.select("id", "question", "ret").orderBy("id").write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def file_report(rows: DataFrame) -> DataFrame:
    """Per file the rows read, kept and refused; rows have path and reason."""
    return rows.groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.col("reason").isNull()).alias("kept"), F.count("reason").alias("refused"))


def numbered_case_ids(rows: DataFrame, order: list[str], prefix: str = "case") -> DataFrame:
    """A missing case_id becomes the prefix and the row's number."""
    number = F.row_number().over(W.orderBy(*order))
    return rows.withColumn("case_id", F.coalesce(F.nullif(F.trim("case_id"), F.lit("")), F.format_string(f"{prefix}_%03d", number)))


def append_traces(rows: DataFrame, path: str) -> None:
    """Rows appended as JSON lines, keys in sorted order."""
    rows.select(*sorted(rows.columns)).write.mode("append").json(path)


def changed_states(current: DataFrame, new: DataFrame, key: str = "session_id", at: str = "updated_at") -> DataFrame:
    """The states after an update: a new state replaces the old one only if anything but its time differs."""
    fields = [c for c in current.columns if c not in (key, at)]
    digest = F.xxhash64(*(F.to_json(F.struct(c)) for c in fields))
    old = current.select(key, F.struct(*current.columns).alias("old"), digest.alias("had"))
    made = new.select(key, F.struct(*current.columns).alias("new"), digest.alias("has"))
    both = old.join(made, key, "full")
    return both.select(F.when(F.col("new").isNotNull() & ~F.col("had").eqNullSafe(F.col("has")), F.col("new")).otherwise(F.coalesce("old", "new")).alias("s")).select("s.*")


def split_records(rows: DataFrame, path: str, number: str = "position", width: int = 4) -> None:
    """A folder a record, named by its zero-padded number, with the record as its one JSON line."""
    named = rows.withColumn("record", F.lpad(F.col(number).cast("string"), width, "0"))
    named.repartition("record").write.mode("overwrite").partitionBy("record").json(path)


def rebuild_collection(rows: DataFrame, path: str) -> None:
    """One collection dropped and written anew; others stay. ``rows`` must not be read from ``path``."""
    rows.write.mode("overwrite").parquet(path)
