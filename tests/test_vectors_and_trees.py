"""The cell index against exact search, and chunk trees against a recursion over small trees."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.operators import trees as T
from tessera.operators import vectors as V
from tessera.plans.queries import queries


def recall(found, exact):
    want = {(r.query_id, r.chunk_id) for r in exact.collect()}
    return len(want & {(r.query_id, r.chunk_id) for r in found.collect()}) / len(want)


@pytest.mark.parametrize("at", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall_over_all_embeddings(spark, at):
    q = queries()
    assert recall(q["r01_indexed_cosine"](spark, at), q["r01_cosine"](spark, at)) >= 0.9
    found = q["f01_indexed_cosine"](spark, at)
    assert recall(found, q["f01_filtered_cosine"](spark, at)) >= 0.9
    assert {r["count"] for r in found.groupBy("query_id").count().collect()} == {3}


def clustered(spark, n, groups, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 16))
    of = np.where(rng.random(n) < 0.34, 0, rng.integers(0, groups, n))
    rows = centres[of] + 0.3 * rng.normal(size=(n, 16))
    return spark.createDataFrame([(i, v.tolist(), int(i % 7)) for i, v in enumerate(rows)], "id long, v array<float>, label int")


def test_a_search_reads_few_cells(spark):
    corpus = clustered(spark, 3000, 30)
    index = V.build_index(corpus, "id", "v", ["label"], cells=50)
    assert index.rows(spark).count() == 3000 and index.probes < 20
    asked = corpus.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    exact = R.cosine_hits(asked, corpus.select(F.col("id").alias("chunk_id"), "v"), 5)
    assert recall(V.search(index, asked, 5), exact) >= 0.9
    one = asked.filter("query_id = 0")
    hits = V._block_hits(index, index.rows(spark), [0], V._unit(np.array([one.first().qv])), 0, index.probes, 5, V.search(index, one, 5).select("query_id", "chunk_id", "score").schema)
    assert "PartitionFilters: [isnotnull(index_cell" in hits._jdf.queryExecution().toString() or "PartitionFilters: [index_cell" in hits._jdf.queryExecution().toString()


def test_a_narrow_filter_goes_on_to_more_cells(spark):
    corpus = clustered(spark, 1000, 20, 2).withColumn("label", F.when(F.col("id") % 250 == 0, 99).otherwise(0))
    index = V.build_index(corpus, "id", "v", ["label"])
    asked = corpus.limit(9).select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    rows = V.search(index, asked, 3, F.col("label") == 99, probes=1).collect()
    assert len(rows) == 27 and {r.chunk_id for r in rows} <= {0, 250, 500, 750}
    assert V.search(index, asked, 3, F.col("label") == 1234, probes=1).collect() == []


def test_odd_vectors(spark):
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, 0.0], 0), (5, [1.0, 0.0], 1), (6, [0.0, 2.0], 0)]
    corpus = spark.createDataFrame(rows, "id long, v array<float>, label int")
    index = V.build_index(corpus, "id", "v")
    asked = corpus.select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    got = sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in V.search(index, asked, 2).collect())
    assert got [:4] == [(4, 4, 1.0, 1), (4, 5, 1.0, 2), (5, 4, 1.0, 1), (5, 5, 1.0, 2)]
    none = V.build_index(corpus.filter("false"), "id", "v")
    assert V.search(none, asked, 2).collect() == [] and V.search(index, asked.filter("false"), 2).collect() == []


# --- trees ------------------------------------------------------------------


def once(text):
    """Lines of a text, each kept where it is first met, blank stretches as one line."""
    met, out = set(), []
    for line in map(str.strip, text.splitlines()):
        if line == "":
            out.append("")
        elif re.sub(r"[ \t\r\f\v]+", " ", line) not in met:
            met.add(re.sub(r"[ \t\r\f\v]+", " ", line))
            out.append(line)
    return re.sub("\n{2,}", "\n\n", "\n".join(out)).strip("\n")


def whole(nodes):
    return once("\n\n".join(n["index"] for n in nodes))


def fold(run):
    groups = []
    for n in run:
        size = len(n["index"])
        last = groups[-1] if groups else None
        if last and len(last[0]["index"]) <= 3200 and size >= 0:
            both, own = len(whole([*last, n])), len(whole(last))
            fits = both <= 3200 and (own < 800 or both <= 1600)
            if size > 3200:
                fits = fits and len(last) >= 1
            if fits:
                last.append(n)
                continue
        groups.append([n])
    if len(groups) > 1 and len(whole(groups[-1])) < 800 and len(whole(groups[-2] + groups[-1])) <= 3200 and all(len(n["index"]) <= 3200 for n in groups[-2] + groups[-1]):
        groups[-2:] = [groups[-2] + groups[-1]]
    return [g[0] if len(g) == 1 else {**g[0], "index": whole(g), "ids": [i for n in g for i in n["ids"]]} for g in groups]


def grow(rows, row):
    """A node and what stays below it."""
    kids = [grow(rows, r) for r in rows if r[2] == row[1]]
    merged, run = [], []
    for kid in [*kids, None]:
        if kid is not None and kid["tier"] == "primary":
            run.append(kid)
            continue
        merged += fold(run)
        run = []
        if kid is not None:
            merged.append(kid)
    node = {"ids": [row[1]], "index": row[3], "tier": "support", "kids": merged}
    if not merged:
        node["tier"] = "primary"
    elif len(merged) == 1 and merged[0]["tier"] == "primary" and len(row[3]) <= 3200:
        node |= {"tier": "primary", "ids": [row[1], *merged[0]["ids"]], "kids": []}
    return node


def flat(node):
    yield tuple(node["ids"]), node["tier"], node["index"]
    for kid in node["kids"]:
        yield from flat(kid)


def forest(rng, n):
    rows = []
    for i in range(n):
        parent = f"c{rng.randrange(max(0, i - 6), i)}" if i and rng.random() < 0.9 else None
        text = "\n".join(rng.choice(["same line", f"line {i} {j} " + "x" * rng.randint(0, 400), ""]) for j in range(rng.randint(0, 9)))
        rows.append((i, f"c{i}", parent, text))
    return rows


def test_merged_tree_is_the_recursion(spark):
    rng = random.Random(11)
    given, want = [], []
    for doc in range(25):
        rows = forest(rng, rng.randint(1, 30))
        given += [(str(doc), pos, i, p, rng.choice(["primary", "support"]), t) for pos, i, p, t in rows]
        for row in rows:
            if row[2] is None:
                want += [(str(doc), *x) for x in flat(grow(rows, row))]
    df = spark.createDataFrame(given, "doc string, pos long, chunk_id string, parent_id string, tier string, text string")
    got = T.merged_tree(df, padding=False).collect()
    assert sorted((r.doc, tuple(r.ids), r.tier, r.index_text) for r in got) == sorted(want)
    ids = {(r.doc, r.chunk_id) for r in got}
    assert len(ids) == len(got) and all((r.doc, r.parent_id) in ids for r in got if r.parent_id)
    parents = {(r.doc, r.parent_id) for r in got if r.parent_id}
    assert all((r.tier == "support") == ((r.doc, r.chunk_id) in parents) for r in got)


def test_short_chunks_borrow_sentences(spark):
    long = "First fact. Second fact. Third fact. " + "y" * 900
    rows = [("d", 0, "r", None, "support", "Root"), ("d", 1, "a", "r", "primary", "Short start."), ("d", 2, "s", "r", "support", "S"), ("d", 3, "s1", "s", "primary", "z" * 3300), ("d", 4, "s2", "s", "primary", "w" * 3300), ("d", 5, "b", "r", "primary", long), ("d", 6, "t", "r", "support", "S"), ("d", 7, "t1", "t", "primary", "u" * 3300), ("d", 8, "t2", "t", "primary", "v" * 3300), ("d", 9, "c", "r", "primary", "Short end.")]
    df = spark.createDataFrame(rows, "doc string, pos long, chunk_id string, parent_id string, tier string, text string")
    found = {r.ids[0]: r.index_text for r in T.merged_tree(df).collect()}
    assert found["a"] == "Short start.\n\nFirst fact. Second fact."
    assert found["c"].endswith("Short end.") and found["b"] == long.strip()
    plain = {r.ids[0]: r.index_text for r in T.merged_tree(df, padding=False).collect()}
    assert plain["c"] == "Short end."


def test_odd_trees(spark):
    rows = [("d", 0, "a", "b", "primary", "x"), ("d", 1, "b", "a", "primary", "y"), ("e", 0, "c", "gone", None, None), ("f", 0, "g", "h", "auxiliary", "aux"), ("f", 1, "h", None, "support", "top")]
    df = spark.createDataFrame(rows, "doc string, pos long, chunk_id string, parent_id string, tier string, text string").withColumn("depth", F.lit("clash")).withColumn("new_id", F.lit(1))
    got = sorted((r.doc, r.chunk_id, r.parent_id, r.tier, r.text) for r in T.merged_tree(df).collect())
    assert got == [("e", "e_0001", None, "primary", ""), ("f", "f_0001", "f_0002", "auxiliary", "aux"), ("f", "f_0002", None, "primary", "top")]
    assert T.merged_tree(df.filter("false")).collect() == []


def test_forest_of_documents_keeps_every_chunk(spark, sf):
    chunks = T.window_forest(spark.read.parquet(f"{sf}/documents.parquet"))
    out = queries()["h08_merged_tree"](spark, sf)
    assert out.selectExpr("explode(ids) AS i").count() == chunks.count()
    assert out.filter("merged").count() > 0 and out.filter("collapsed").count() > 0 and out.filter("tier = 'support'").count() > 0
