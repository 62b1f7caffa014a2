"""Support nodes of a document's sections, with their text from the source lines.

All of it is joins and windows by document: the prefixes of paths that no chunk
has become nodes, every chunk hangs on the head of its path or the node above,
and a node's text is a slice of its document's lines, found by one equi-join on
the document.  Line numbers count from 1, ends are included, and what lies
outside the document is cut off.

Edges: chunks without a path have neither parent nor children; auxiliary chunks
keep tier and text and stay without a parent unless their path has a head; a
document without source lines gives null texts; null texts of sources are empty;
columns other than those named are dropped; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as X

_HEADING = r"^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$"


def line_slice(lines: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last`` as one text, without white space at its end."""
    begin = F.greatest(first, F.lit(1))
    size = F.greatest(F.least(last, F.size(lines)) - begin + 1, F.lit(0))
    return F.regexp_replace(F.array_join(F.slice(lines, begin, size), "\n"), r"(?U)\s+\z", "")


def heading_line(lines: Column, title: Column, first: Column) -> Column:
    """The last line at or above ``first`` that is a heading with this title; else ``first``."""
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    at = F.least(F.greatest(first, F.lit(1)), F.size(lines))
    above = F.transform(F.slice(lines, F.lit(1), at), lambda x, i: F.when(plain(F.regexp_extract(x, _HEADING, 1)) == plain(title), i + 1))
    return F.coalesce(F.array_max(above), first)


def completed_sections(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """H9: chunks and the missing support nodes above them, with parents, tiers, texts and new ids.

    ``chunks`` has doc, pos, chunk_id, tier, path, first_line, last_line, text
    and pic_ids; ``sources`` doc and text.  A node spans the lines of all that
    lies below it, from its heading on; it has the pictures of what lies below
    in their order.  Ids follow pos, new nodes first, then shorter paths.
    """
    rows = chunks.select(
        F.col("doc").cast("string").alias("doc"), F.col("pos").cast("long").alias("pos"), F.col("chunk_id").cast("string").alias("chunk_id"), "tier", F.coalesce("path", F.array().cast("array<string>")).alias("path"),
        "first_line", "last_line", "text", F.coalesce("pic_ids", F.array().cast("array<string>")).alias("pic_ids"), (F.col("tier").eqNullSafe("auxiliary")).alias("aside"),
    )
    main = rows.filter("NOT aside AND size(path) > 0")
    ups = main.select("doc", "pos", "chunk_id", "path", "first_line", "last_line", "pic_ids", F.explode(F.expr("transform(sequence(1, size(path)), n -> slice(path, 1, n))")).alias("node"))
    pictures = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "chunk_id", "pic_ids"))), lambda x: x["pic_ids"])))
    head = F.min(F.when(F.col("node") == F.col("path"), F.struct("pos", "chunk_id")))
    nodes = ups.groupBy("doc", F.col("node").alias("path")).agg(
        F.min("pos").alias("pos"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), pictures.alias("pic_ids"), head["chunk_id"].alias("head"), F.count("*").alias("below")
    )
    nodes = nodes.withColumn("head_id", F.coalesce("head", F.concat(F.lit("node:"), F.array_join("path", "\u0001"))))
    made = nodes.filter("head IS NULL").select("doc", "pos", F.col("head_id").alias("chunk_id"), F.lit("support").alias("tier"), "path", "first_line", "last_line", F.lit("").alias("text"), "pic_ids", F.lit(False).alias("aside"), F.lit(True).alias("synthetic"))
    every = rows.withColumn("synthetic", F.lit(False)).unionByName(made)
    own = nodes.select("doc", "path", F.col("head_id").alias("own_head"), "below", F.col("first_line").alias("from_line"), F.col("last_line").alias("to_line"), F.col("pic_ids").alias("all_pics"))
    above = nodes.select("doc", F.col("path").alias("up"), F.col("head_id").alias("up_head"))
    placed = every.join(own, ["doc", "path"], "left").withColumn("up", F.when(F.size("path") > 1, F.slice("path", 1, F.size("path") - 1))).join(above, ["doc", "up"], "left")
    is_head = F.col("chunk_id").eqNullSafe(F.col("own_head"))
    placed = placed.withColumn("parent_id", F.when(F.col("own_head").isNotNull() & ~is_head, F.col("own_head")).otherwise(F.col("up_head")))
    # a head has children if anything but itself lies below it; a new node always has
    inner = is_head & (F.col("synthetic") | (F.col("below") > 1)) & ~F.col("aside")
    placed = placed.withColumn("tier", F.when(F.col("aside"), F.col("tier")).when(inner, "support").otherwise("primary"))
    title = F.element_at("path", -1)
    lined = sources.select(F.col("doc").cast("string").alias("doc"), F.split(F.coalesce("text", F.lit("")), "\r\n|\n|\r").alias("lines"))
    told = placed.join(lined, "doc", "left").withColumn("start", F.when(inner, heading_line(F.col("lines"), title, F.col("from_line"))).otherwise(F.col("first_line")))
    told = told.withColumns({"last_line": F.when(inner, F.col("to_line")).otherwise(F.col("last_line")), "pic_ids": F.when(inner, F.col("all_pics")).otherwise(F.col("pic_ids"))})
    told = told.withColumn("text", F.when(inner, line_slice(F.col("lines"), F.col("start"), F.col("last_line"))).otherwise(F.col("text")))
    order = W.partitionBy("doc").orderBy("pos", F.when(F.col("synthetic"), 0).otherwise(1), F.size("path"), "path", "chunk_id")
    told = told.withColumn("new_id", F.format_string("%s_%04d", "doc", F.row_number().over(order)))
    names = told.select("doc", F.col("chunk_id").alias("parent_id"), F.col("new_id").alias("new_parent"))
    index = F.when(F.col("tier") == "support", X.markdown_to_index_text(F.concat_ws("\n", title, "text"))).otherwise(F.col("text"))
    out = told.join(names, ["doc", "parent_id"], "left")
    return out.select("doc", F.col("new_id").alias("chunk_id"), F.col("new_parent").alias("parent_id"), "tier", F.when(F.size("path") > 0, title).alias("title"), "path", F.col("start").alias("first_line"), "last_line", "text", index.alias("index_text"), "pic_ids", "synthetic", F.when(~F.col("synthetic"), F.col("chunk_id")).alias("old_id"))
