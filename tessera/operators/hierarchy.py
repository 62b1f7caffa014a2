"""Operators on a forest of chunks: (chunk_id, parent_id, tier, ...).

The forest is at most ``DEPTH`` levels deep where it is walked, so walks are a
fixed number of equi-joins and never a recursion over the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.retrieval import first_by, ranked

DEPTH, PER_PARENT, MAX_DESCENDANTS = 4, 3, 100
BIG_SUPPORT = 8000
MISSING = 1_000_000


def parent_rows(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The parents of primary hits in first-seen order, those of a support tier."""
    asked = hits.filter("tier = 'primary' AND parent_id IS NOT NULL").groupBy("query_id", "parent_id").agg(F.min("rank").alias("seen"))
    parents = chunks.filter(F.col("tier").isin("support", "big_support")).select(F.col("chunk_id").alias("parent_id"), F.col("tier").alias("parent_tier"))
    found = asked.join(parents.dropDuplicates(["parent_id"]), "parent_id")
    return ranked(found, [F.asc("seen"), F.asc("parent_id")]).select("query_id", "parent_id", "parent_tier", "rank")


def support_context(parents: DataFrame, hits: DataFrame) -> DataFrame:
    """Parents that are no hits themselves, each once."""
    mine = hits.select("query_id", F.col("chunk_id").alias("parent_id"))
    return first_by(parents.join(mine, ["query_id", "parent_id"], "left_anti"), ["query_id", "parent_id"], [F.asc("rank")])


def children(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """The children of a set of chunks (column parent_id), with their parent."""
    return chunks.join(parents.select("parent_id").distinct(), "parent_id")


def descendants(chunks: DataFrame, roots: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(root, chunk_id, tier, depth) of all chunks below the roots, each once at its least depth."""
    edges = chunks.select(F.col("parent_id").alias("at"), F.col("chunk_id").alias("below"), "tier")
    level = roots.select(F.col("chunk_id").alias("root"), F.col("chunk_id").alias("at"))
    found: DataFrame | None = None
    for d in range(1, depth + 1):
        step = level.join(edges, "at").select("root", F.col("below").alias("chunk_id"), "tier", F.lit(d).alias("depth"))
        found = step if found is None else found.unionByName(step)
        level = step.filter("tier <> 'primary'").select("root", F.col("chunk_id").alias("at"))
    return found.filter("chunk_id <> root").groupBy("root", "chunk_id", "tier").agg(F.min("depth").alias("depth"))


def best_per_parent(scored: DataFrame, k: int = PER_PARENT) -> DataFrame:
    """The best k chunks of each parent."""
    return ranked(scored, [F.desc("score"), F.asc("chunk_id")], ["parent_id"]).filter(F.col("rank") <= k)


def hierarchy_order(chunks: DataFrame) -> DataFrame:
    """Chunks in the order of index, first line, number in the id, input; missing ones last."""
    number = F.regexp_extract(F.col("chunk_id").cast("string"), r"(\d+)$", 1).try_cast("long")
    keys = [F.coalesce(F.col("chunk_index"), F.lit(MISSING)), F.coalesce(F.col("first_line"), F.lit(MISSING)), F.coalesce(number, F.lit(MISSING)), F.col("pos")]
    return chunks.withColumn("rank", F.row_number().over(W.partitionBy("parent_id").orderBy(*keys)))


def missing_prefixes(paths: DataFrame) -> DataFrame:
    """Every prefix of a path that is no path itself."""
    prefixes = paths.select("doc", F.explode(F.expr("transform(sequence(1, size(path)), n -> slice(path, 1, n))")).alias("path")).distinct()
    return prefixes.join(paths.select("doc", "path").distinct(), ["doc", "path"], "left_anti")


def nearest_ancestor(paths: DataFrame) -> DataFrame:
    """For each path the longest proper prefix that is a path; null for none."""
    have = paths.select("doc", F.col("path").alias("prefix")).distinct()
    tries = paths.filter("size(path) > 1").select("doc", "path", F.explode(F.expr("transform(sequence(1, size(path) - 1), n -> slice(path, 1, n))")).alias("prefix"))
    best = tries.join(have, ["doc", "prefix"]).groupBy("doc", "path").agg(F.max_by("prefix", F.size("prefix")).alias("ancestor"))
    return paths.select("doc", "path").distinct().join(best, ["doc", "path"], "left")


def violations(chunks: DataFrame) -> DataFrame:
    """Counts of structural faults: dangling parents, primaries with children, childless support, self-parents."""
    ids = chunks.select(F.col("chunk_id").alias("parent_id")).distinct()
    kids = chunks.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("chunk_id")).agg(F.count("*").alias("kids"))
    dangling = chunks.filter("parent_id IS NOT NULL").join(ids, "parent_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("dangling_parent").alias("fault"), "n")
    joined = chunks.join(kids, "chunk_id", "left")
    counts = joined.agg(
        F.count_if((F.col("tier") == "primary") & (F.col("kids") > 0)).alias("primary_with_children"),
        F.count_if(F.col("tier").isin("support", "big_support") & F.col("kids").isNull()).alias("childless_support"),
        F.count_if(F.col("chunk_id") == F.col("parent_id")).alias("self_parent"),
    )
    rest = counts.selectExpr("stack(3, 'primary_with_children', primary_with_children, 'childless_support', childless_support, 'self_parent', self_parent) AS (fault, n)")
    return dangling.unionByName(rest)


def tier_depth_profile(chunks: DataFrame) -> DataFrame:
    """Counts by tier and depth of the section path."""
    return chunks.groupBy("tier", F.size("path").alias("depth")).agg(F.count("*").alias("n"), F.count("parent_id").alias("with_parent"))


def renumbered(chunks: DataFrame, form: str = "%s_%04d") -> DataFrame:
    """Ids in document order, parents rewritten, a self-parent made null."""
    new = chunks.withColumn("new_id", F.format_string(form, F.col("doc").cast("string"), F.row_number().over(W.partitionBy("doc").orderBy("pos", "chunk_id"))))
    names = new.select("doc", F.col("chunk_id").alias("parent_id"), F.col("new_id").alias("new_parent"))
    out = new.join(names, ["doc", "parent_id"], "left")
    return out.select("doc", "chunk_id", "new_id", F.when(F.col("new_parent") != F.col("new_id"), F.col("new_parent")).alias("new_parent"))


def sibling_context(chunks: DataFrame) -> DataFrame:
    """The previous and next primary of each chunk under the same parent; ids are unique under a parent.

    The next one is the last before it in the opposite order: a frame that ends
    at the last row would be read anew for each row.
    """
    primary = F.when(F.col("tier") == "primary", F.col("chunk_id"))
    last = lambda *order: F.last(primary, True).over(W.partitionBy("parent_id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    before, after = last(F.asc("pos"), F.asc("chunk_id")), last(F.desc("pos"), F.desc("chunk_id"))
    return chunks.select("chunk_id", "parent_id", before.alias("prev_primary"), after.alias("next_primary"))


def big_support(chunks: DataFrame, limit: int = BIG_SUPPORT) -> DataFrame:
    """Support with a long text becomes big_support and ends before its first child's line."""
    kids = chunks.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("chunk_id"), F.col("first_line").alias("kid_line"))
    starts = chunks.select("chunk_id", F.col("first_line").alias("own_line")).join(kids, "chunk_id").filter("kid_line >= own_line").groupBy("chunk_id").agg(F.min("kid_line").alias("kid_line"))
    out = chunks.join(starts, "chunk_id", "left")
    big = (F.col("tier") == "support") & (F.col("n_chars") > limit)
    return out.select("chunk_id", F.when(big, "big_support").otherwise(F.col("tier")).alias("tier"), F.when(big & F.col("kid_line").isNotNull(), F.col("kid_line") - 1).otherwise(F.col("last_line")).alias("last_line"))
