"""Projections between chunk records, stored documents, index text and evidence."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from tessera.functions import text as X
from tessera.operators.retrieval import metadata_filter

# The bytes of stored metadata and of a field cut short, folders that a portable path may start with, rows of a bounded scan.
METADATA_BYTES, SHORT_BYTES, MARKERS, SCAN_LIMIT = 60_000, 2_000, ("data/", "docs/", "uploads/"), 256
# The metadata of an answer that may leave the service, and keys that are for traces.
API_KEYS = ("intent", "doc_id", "retrieval_stage", "intent_strategy", "recall_channels", "reranker_provider", "reranker_fallback", "timeout", "degraded", "top_hits", "warnings")
TRACE_KEYS = ("diagnostics", "evidence", "query", "query_understanding", "raw_candidates", "raw_query", "recall", "recall_candidates", "request_id", "reranker", "session_id", "trace")


def filled(*values: Column) -> Column:
    """The first value that is not blank, trimmed; null for none."""
    return F.coalesce(*(F.nullif(X.strip(v), F.lit("")) for v in values))


def portable_path(path: Column) -> Column:
    """P5: slashes folded, and what stands before the first known folder cut off; null for a blank path."""
    folded = F.regexp_replace(F.replace(X.strip(path), F.lit("\\"), F.lit("/")), "/+", "/")
    starts = [F.when(folded.contains(m), F.substr(folded, F.instr(folded, m))) for m in MARKERS]
    return F.when(folded != "", F.coalesce(*starts, folded))


def doc_name(name: Column, doc_id: Column, path: Column) -> Column:
    """The given name, the folder's name after ``__``, the id, or the file's stem."""
    parts = F.split(path, "/")
    folder = F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2))
    after = F.when(folder.contains("__"), F.regexp_replace(folder, "^.*?__", ""))
    return filled(name, after, doc_id, F.regexp_replace(F.get(parts, F.size(parts) - 1), r"(?<=.)\.[^.]*$", ""))


def legacy_documents(records: DataFrame) -> DataFrame:
    """Older chunk records as documents; records without text are left out.

    ``records`` has path, doc_id, doc_name, language, chunk_id, chunk_index,
    section_title, text, char_count, pic_count, source_parsed and the arrays
    image_paths and pic_refs.
    """
    none, content = F.expr("cast(array() AS array<string>)"), X.strip(F.coalesce("text", F.lit("")))
    file = F.element_at(F.split("path", "/"), -1)
    rows = records.filter(content != "")
    return rows.select(
        F.col("path").alias("_source"), F.regexp_extract(file, r".(\.[^.]+)$", 1).alias("_extension"), file.alias("_file_name"), "doc_id", doc_name(F.col("doc_name"), F.col("doc_id"), F.col("path")).alias("doc_name"), "language", "chunk_id", "chunk_index",
        "section_title", F.col("section_title").alias("title"), F.transform(F.coalesce("image_paths", none), portable_path).alias("image_paths"), F.coalesce("pic_refs", none).alias("pic_refs"), F.coalesce("pic_refs", none).alias("pic_ids"),
        portable_path(F.col("source_parsed")).alias("source_parsed"), content.alias("index_text"), content.alias("text"), "char_count", "pic_count",
    )


def json_bytes(values: Column, fields: int, items: Column | int = 0) -> Column:
    """The bytes of a struct of ``fields`` fields as JSON with a blank after each comma and colon; ``items`` counts commas inside arrays."""
    return F.octet_length(F.to_json(values, {"ignoreNullFields": "false"})) + F.lit(2 * fields - 1) + items


def budgeted(rows: DataFrame, fields: list[str], limit: int = METADATA_BYTES, short: int = SHORT_BYTES) -> DataFrame:
    """Rows whose metadata, the named fields as JSON, fit a number of bytes.

    In order and only as far as needed: index_text and text are cut to
    ``short`` bytes, then dropped (null).
    """
    inner = [F.greatest(F.coalesce(F.size(F.col(f)), F.lit(0)) - 1, F.lit(0)) for f in fields if rows.schema[f].dataType.typeName() == "array"]
    size = lambda df: df.withColumn("_bytes", json_bytes(F.struct(*fields), len(fields), sum(inner, F.lit(0))))
    out = size(rows)
    for change in (lambda f: X.utf8_truncate(F.col(f), short), lambda f: F.lit(None).cast("string")):
        for f in ("index_text", "text"):
            if f in fields:
                out = size(out.withColumn(f, F.when(F.col("_bytes") > limit, change(f)).otherwise(F.col(f))))
    return out.drop("_bytes")


def index_text(fields: list[Column]) -> Column:
    """What BM25 indexes: strings and arrays of strings in order, trimmed, blanks left out; a text given twice counts twice."""
    parts = F.flatten(F.array(*(f if isinstance(f, Column) else F.col(f) for f in fields)))
    return F.array_join(F.filter(F.transform(parts, lambda p: X.strip(F.coalesce(p, F.lit("")))), lambda p: p != ""), " ")


def rerank_text(index: Column, content: Column, text: Column) -> Column:
    """What a reranker reads: the first of index text, content and text that is not blank, else nothing."""
    return F.coalesce(filled(index, content, text), F.lit(""))


def evidence_hits(ranking: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank, role, score) rows with the stable fields of their chunks; absent ones are null or empty."""
    none = F.expr("cast(array() AS array<string>)")
    text = lambda c: F.col(c).cast("string").alias(c) if c in chunks.columns else F.lit(None).cast("string").alias(c)
    items = lambda c: (F.coalesce(F.col(c), none) if c in chunks.columns else none).alias(c)
    plain = ["doc_id", "doc_name", "title", "retrieval_tier", "chunk_type", "parent_chunk_id", "source_quality"]
    lists = ["section_path", "pic_ids", "image_paths", "source_lines", "source_issue_flags"]
    held = chunks.select("chunk_id", *map(text, plain), *map(items, lists), (portable_path(F.col("source_file")) if "source_file" in chunks.columns else F.lit(None).cast("string")).alias("source_file"), F.coalesce(text("source_issue_note"), F.lit("")).alias("source_issue_note"), F.coalesce(text("text"), F.lit("")).alias("text"))
    order = ["query_id", "rank", "role", "chunk_id", "doc_id", "doc_name", "title", "section_path", "retrieval_tier", "chunk_type", "parent_chunk_id", "score", "pic_ids", "image_paths", "source_file", "source_lines", "source_quality", "source_issue_flags", "source_issue_note", "text"]
    return ranking.select("query_id", "chunk_id", "rank", "role", F.coalesce("score", F.lit(0.0)).alias("score")).join(held, "chunk_id").select(*order)


def hit_summaries(hits: DataFrame) -> DataFrame:
    """The compact form of evidence: one row a question, its hits in order as structs."""
    item = F.struct("rank", "role", "chunk_id", "doc_id", "retrieval_tier", "chunk_type", "parent_chunk_id", "score", "pic_ids", "image_paths")
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("hits"), F.count_if((F.size("pic_ids") > 0) | (F.size("image_paths") > 0)).alias("with_images"))


def without_traces(value: Column, kind: DataType) -> Column | None:
    """P10: a value of this type without the fields and map keys that are for traces, at any depth; null where nothing is left.

    The walk is over the type, so the rows meet one native expression.
    """
    if isinstance(kind, StructType):
        parts = [(f.name, without_traces(value[f.name], f.dataType)) for f in kind.fields if f.name not in TRACE_KEYS]
        kept = [c.alias(name) for name, c in parts if c is not None]
        return F.when(value.isNotNull(), F.struct(*kept)) if kept else None
    if isinstance(kind, ArrayType):
        return None if without_traces(value, kind.elementType) is None else F.transform(value, lambda x: without_traces(x, kind.elementType))
    if isinstance(kind, MapType):
        named = F.map_filter(value, lambda k, _: ~k.cast("string").isin(*TRACE_KEYS))
        return None if without_traces(value, kind.valueType) is None else F.transform_values(named, lambda _, v: without_traces(v, kind.valueType))
    return value


def api_metadata(rows: DataFrame) -> DataFrame:
    """P10: only columns that may leave the service, without trace fields inside them."""
    kept = [(c, without_traces(F.col(c), rows.schema[c].dataType)) for c in API_KEYS if c in rows.columns]
    return rows.select(*(["query_id"] if "query_id" in rows.columns else []), *(value.alias(c) for c, value in kept if value is not None))


def api_metadata_json(text: Column) -> Column:
    """P10 for metadata held as JSON text: the keys that may leave, without trace keys at any depth; null for what is no object or has none of them."""

    def clean(value):
        if isinstance(value, dict):
            return {k: clean(v) for k, v in value.items() if k not in TRACE_KEYS}
        return [clean(v) for v in value] if isinstance(value, list) else value

    def one(raw):
        try:
            found = json.loads(raw) if raw else None
        except ValueError:
            return None
        kept = {k: clean(found[k]) for k in API_KEYS if k in found} if isinstance(found, dict) else {}
        return json.dumps(kept, ensure_ascii=False, separators=(",", ":")) if kept else None

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return cleaned(text)


def collection_scan(chunks: DataFrame, allowed: dict[str, list]) -> DataFrame:
    """Every row under the metadata filters, with no score; pages of the compared store vanish in one scan."""
    return chunks.filter(metadata_filter(allowed)).withColumn("score", F.lit(0.0))


def bounded_scan(chunks: DataFrame, allowed: dict[str, list], limit: int = SCAN_LIMIT, key: str = "chunk_id") -> DataFrame:
    """The first ``limit`` rows, by id, under the metadata filters."""
    return collection_scan(chunks, allowed).orderBy(key).limit(limit)
