"""License scans (operator 8), in DataFrame functions only.

Texts and templates become 5-word shingles.  Overlapping windows of a text,
one series for each size class of templates, are sketched by MinHash; a window
retrieves every template of its class with which it shares a band, and a
retrieved template is confirmed by exact containment: at least 80 percent of
its distinct shingles occur in the text.

Bands.  A window of a class is twice the class's size long and starts at every
class's size, so a contained template lies whole in some window and shares at
least 0.8 * m of at most 2 * M + 0.2 * m shingles with it, where m > M / 2 is
its size and M its class: a similarity of at least 0.19.  One row a band and
``BANDS`` = 64 bands leave it out with probability (1 - 0.19)**64 = 1.4e-6;
where its shingles lie close together, far less.

A text that holds no shingle of any template can share no band with one, so its
windows are not sketched: that test loses nothing.

Defined results: a null or empty text has no license; a null doc_id is returned
as null; repeated rows get equal results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

SHINGLE, MIN_PERCENT, BANDS = 5, 80, 64
CLASSES = (1, 2, 4, 8, 16, 32, 64)

#: Notices of public licenses.  Fixed values.
TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "Licensed under CC BY 4.0 by its author.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def shingles(text: Column) -> Column:
    """Hashes of the 5-word shingles of a text, in order; words are runs of letters a-z and digits."""
    hashes = F.transform(F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), ""), lambda w: F.xxhash64(w))
    return hashes


def _joined(words: str) -> Column:
    part = lambda i: f"slice({words}, {i + 1}, greatest(size({words}) - {SHINGLE - 1}, 0))"
    two = lambda a, b: f"zip_with({a}, {b}, (x, y) -> xxhash64(x, y))"
    return F.expr(reduce(two, (part(i) for i in range(SHINGLE))))


def _seeds() -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda j: F.xxhash64(j))


def _sketch(values: Column) -> Column:
    """The least value under each of the permutations that the seeds stand for."""
    return F.transform(_seeds(), lambda j: F.array_min(F.transform(values, lambda h: h.bitwiseXOR(j))))


def template_table(spark: SparkSession, templates: dict[str, str]) -> list[tuple[str, list[int], list[int]]]:
    """The distinct shingles and the sketch of each template, by the same expressions as texts'."""
    rows = spark.createDataFrame(sorted(templates.items()), "id string, text string")
    made = rows.select("id", shingles(F.col("text")).alias("words")).select("id", F.array_distinct(_joined("words")).alias("s"))
    return [(r.id, list(r.s), list(r.k)) for r in made.filter("size(s) > 0").select("id", "s", _sketch(F.col("s")).alias("k")).orderBy("id").collect()]


def _longs(values: list[int]) -> str:
    return "array(" + ", ".join(f"{v}L" if v != -(1 << 63) else "-9223372036854775807L - 1L" for v in values) + ")"


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id and ``matches``: (id, containment) of every confirmed template, by id."""
    found = template_table(docs.sparkSession, templates or TEMPLATES)
    every = F.expr(_longs(sorted({h for _, s, _ in found for h in s})))
    rows = documents(docs).select("doc_id", shingles(F.coalesce("text", F.lit(""))).alias("words")).select("doc_id", _joined("words").alias("s"))
    rows = rows.select("doc_id", F.when(F.arrays_overlap("s", every), F.col("s")).alias("s"))
    empty = F.expr("cast(array() AS array<string>)")
    retrieved = []
    for low, size in zip((0, *CLASSES), CLASSES, strict=False):
        group = [(name, s, k) for name, s, k in found if low < len(s) <= size or size == CLASSES[-1] < len(s)]
        if not group:
            continue
        step = max(size, *(len(s) for _, s, _ in group))
        windows = F.expr(f"transform(sequence(0, int((greatest(size(s), 1) - 1) / {step})), k -> slice(s, k * {step} + 1, {2 * step}))")
        sketches = F.transform(F.filter(windows, lambda w: F.arrays_overlap(w, every)), _sketch)
        shares = [f"exists(sketches, k -> exists(zip_with(k, {_longs(keys)}, (x, y) -> x = y), e -> e))" for _, _, keys in group]
        hits = [F.when(F.expr(shared), F.array(F.lit(name))).otherwise(empty) for shared, (name, _, _) in zip(shares, group, strict=True)]
        retrieved.append((size, sketches, hits))
    names = empty
    for size, sketches, hits in retrieved:
        rows = rows.withColumn("sketches", F.when(F.col("s").isNotNull(), sketches)).withColumn(f"of_{size}", F.when(F.col("s").isNotNull(), F.concat(*hits)).otherwise(empty))
        names = F.concat(names, F.col(f"of_{size}"))
    rows = rows.select("doc_id", "s", names.alias("names"))
    share = lambda s: F.size(F.array_intersect(F.col("s"), F.expr(_longs(s)))) / F.lit(len(s))
    kind = "array<struct<id:string,containment:double>>"
    confirmed = [
        F.when(F.array_contains("names", name) & (100 * share(s) >= MIN_PERCENT), F.array(F.struct(F.lit(name).alias("id"), share(s).alias("containment")))).otherwise(F.expr(f"cast(array() AS {kind})")) for name, s, _ in found
    ]
    return rows.select("doc_id", F.when(F.size("names") > 0, F.concat(*confirmed)).otherwise(F.expr(f"cast(array() AS {kind})")).alias("matches"))


def license_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_licenses, licenses (ids, comma-joined) and the best containment, for every document."""
    found = license_matches(docs)
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_licenses"), F.array_join(F.transform("matches", lambda m: m["id"]), ",").alias("licenses"), F.round(best, 6).alias("best_containment")
    )


def license_sql() -> str:
    """The same result by containment alone, in DuckDB SQL."""
    rows = ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in sorted(TEMPLATES.items()))
    cut = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""
WITH t AS (SELECT id, {cut.format("text")} AS w FROM (VALUES {rows}) AS v(id, text)),
ts AS (SELECT DISTINCT id, array_to_string(w[i:i+{SHINGLE - 1}], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM t)),
tn AS (SELECT id, count(*) AS n FROM ts GROUP BY id),
d AS (SELECT doc_id, {cut.format("coalesce(text, '')")} AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+{SHINGLE - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM d)),
m AS (SELECT doc_id, id, count(*) AS k FROM ds JOIN ts USING (s) GROUP BY doc_id, id),
ok AS (SELECT doc_id, id, k / n AS share FROM m JOIN tn USING (id) WHERE 100 * k >= {MIN_PERCENT} * n)
SELECT doc_id, count(id) AS n_licenses, coalesce(string_agg(id, ',' ORDER BY id), '') AS licenses, round(coalesce(max(share), 0.0), 6) AS best_containment
FROM documents LEFT JOIN ok USING (doc_id) GROUP BY doc_id
"""
