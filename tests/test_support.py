"""Support completion on hand-made sections."""

from tessera.operators.support import completed_sections

SOURCE = "# Manual\nintro\n## Parts\nlist <PIC:p1>\n### Screws\nlong\nshort\n## Use\nturn on   \n\n"
CHUNK = "doc string, pos int, chunk_id string, tier string, path array<string>, first_line int, last_line int, text string, pic_ids array<string>, parent_id string, up string"


def rows(spark, chunks, sources):
    df = spark.createDataFrame([(*c, "old", "clash") for c in chunks], CHUNK)
    found = completed_sections(df, spark.createDataFrame(sources, "doc string, text string, lines int"))
    return {r.chunk_id: r for r in found.collect()}


def test_missing_prefixes_get_nodes_with_text(spark):
    chunks = [
        ("d", 0, "a", "primary", ["Manual"], 2, 2, "intro", None),
        ("d", 1, "b", "primary", ["Manual", "Parts", "Screws"], 6, 6, "long", ["p2"]),
        ("d", 2, "c", "primary", ["Manual", "Parts", "Screws"], 7, 7, "short", ["p1", "p2"]),
        ("d", 3, "e", "support", ["Manual", "Use"], 9, 9, "turn on", []),
        ("d", 4, "x", "auxiliary", ["Manual", "Pictures"], 4, 4, "p1", ["p1"]),
        ("d", 5, "y", None, None, None, None, None, None),
    ]
    got = rows(spark, chunks, [("d", SOURCE, 1)])
    by_old = {r.old_id: r for r in got.values() if r.old_id}
    made = next(r for r in got.values() if r.synthetic)
    assert [r.old_id for _, r in sorted(got.items())] == ["a", None, "b", "c", "e", "x", "y"] and sorted(got) == [f"d_{i:04d}" for i in range(1, 8)]
    assert (by_old["a"].tier, by_old["a"].first_line, by_old["a"].last_line, by_old["a"].parent_id, by_old["a"].pic_ids) == ("support", 1, 9, None, ["p2", "p1"])
    assert by_old["a"].text == SOURCE.rstrip() and by_old["a"].index_text.startswith("Manual\nManual\nintro\nParts\nlist")
    assert (made.path, made.first_line, made.last_line, made.parent_id, made.text) == (["Manual", "Parts"], 3, 7, by_old["a"].chunk_id, "## Parts\nlist <PIC:p1>\n### Screws\nlong\nshort")
    assert (by_old["b"].tier, by_old["b"].parent_id, by_old["b"].text, by_old["b"].pic_ids) == ("support", made.chunk_id, "### Screws\nlong\nshort", ["p2", "p1"])
    assert (by_old["c"].tier, by_old["c"].parent_id, by_old["c"].text) == ("primary", by_old["b"].chunk_id, "short")
    assert (by_old["e"].tier, by_old["e"].text, by_old["e"].parent_id) == ("primary", "turn on", by_old["a"].chunk_id)
    assert (by_old["x"].tier, by_old["x"].text) == ("auxiliary", "p1") and (by_old["y"].parent_id, by_old["y"].tier) == (None, "primary")


def test_documents_without_lines_and_empty_tables(spark):
    one = rows(spark, [("e", 0, "a", "primary", ["A", "B"], 5, 9, "t", None)], [("e", None, 0)])
    assert [(r.tier, r.text, r.first_line) for _, r in sorted(one.items())] == [("support", "", 5), ("primary", "t", 5)]
    gone = rows(spark, [("f", 0, "a", "primary", ["A", "B"], 5, 9, "t", None)], [("g", "x", 0)])
    assert [(r.tier, r.text) for _, r in sorted(gone.items())] == [("support", None), ("primary", "t")]
    assert rows(spark, [], []) == {}
