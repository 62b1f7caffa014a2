"""Operators 11 to 13 against brute force."""

import datetime
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import spelling, suffixes
from tessera.llm.compaction import FirstFit, compacted_clicks
from tessera.llm.repeats import passage_digest
from tessera.llm.spelling import Trie, near_words, neighbours, spelling_variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    by_size = defaultdict(list)
    for w in n:
        by_size[len(w)].append(w)
    out, form = {}, {}
    for w in n:
        around = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_size[size] if near(w, v)]
        best = min(around, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = [n[w], len(around)]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, *out[w], n[form[w]] if form[w] else None)
    return sorted(out.values())


def spelled(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_trie_meets_automaton_like_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 90))})
        counts = [rng.randint(1, 4) for _ in words]
        asked = sorted({"".join(rng.choice("abéz") for _ in range(rng.randint(1, 7))) for _ in range(60)})
        want = {}
        for i, w in enumerate(asked):
            found = [j for j, v in enumerate(words) if near(w, v)]
            if found:
                best = min(found, key=lambda j: (-counts[j], words[j]))
                want[i] = (len(found), counts[best], words[best])
        assert {i: tuple(r) for i, *r in neighbours(Trie.unpack(Trie(words, counts).pack()), asked)} == want


def test_spelling_of_a_table(spark):
    rng, stems = random.Random(5), ["consider", "naïveté", "absolutely", "absolutley", "considera", "ALPHABET"]
    texts = []
    for i in range(400):
        words = [rng.choice(stems) for _ in range(rng.randint(0, 30))]
        texts.append((i, " ".join(w if rng.random() > 0.05 else w[:3] + rng.choice("xyz") + w[4:] for w in words)))
    texts += [(None, "consider consider"), (1000, None), (1001, ""), (1002, "a" * 5000 + " " + "a" * 5000), (1003, "zebrafish zebrafish"), (1003, "zebrafish zebrafish")]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS word", "1 AS n")
    assert spelled(spelling_variants(df)) == brute_spelling(texts)
    assert spelled(spelling_variants(df.filter("false"))) == []


def test_spelling_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    from tessera.llm.queries import queries

    assert spelled(queries()["op11_spelling_variants"](spark, sf)) == brute_spelling(rows)


def test_many_shards_give_what_one_gives(spark, tmp_path):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcd") for _ in range(7)) for _ in range(900)})
    df = spark.createDataFrame([(w, rng.randint(2, 50)) for w in words], "word string, n long")
    one = sorted(map(tuple, near_words(df, f"{tmp_path}/one").collect()))
    assert sorted(map(tuple, near_words(df, f"{tmp_path}/many", shard_words=100, most=4_000).collect())) == one
    assert spelling.BROADCAST_BYTES >= 10 * 4_000


def first_fit(sizes, full):
    groups = []
    for s in sizes:
        at = next((i for i, g in enumerate(groups) if sum(g) + s <= full), None)
        if at is None:
            groups.append([s])
        else:
            groups[at].append(s)
        yield len(groups) - 1 if at is None else at


def test_first_fit_takes_the_earliest_group():
    rng = random.Random(2)
    for _ in range(200):
        full = rng.randint(5, 60)
        sizes = sorted((rng.randint(1, full) for _ in range(rng.randint(1, 80))), reverse=rng.random() < 0.7)
        fit = FirstFit(sizes, full)
        assert [fit.place(s) for s in sizes] == list(first_fit(sizes, full))


def brute_compaction(table):
    """name of each final file: its rows' ids in order, cents, sources, whether rewritten."""
    rows = table.to_pylist()
    total = len(rows)
    s = {x: 1 + total // x for x in (150, 400, 600)}
    days = defaultdict(list)
    for r in rows:
        days[None if r["arrived_at"] is None else (r["arrived_at"] - datetime.datetime(1970, 1, 1)).days].append(r)
    out = []
    for day, own in days.items():
        files = defaultdict(list)
        for r in own:
            h = zlib.crc32(("" if r["click_id"] is None else str(r["click_id"])).encode())
            files[h // 16 % (1 + len(own) // s[150]), min(h % 4, h // 4 % 4)].append(r)
        low = datetime.datetime.min
        for f in files.values():
            f.sort(key=lambda r: (r["arrived_at"] or low, r["click_id"] is not None, r["click_id"] or 0))
        small = sorted((f for f in files if len(files[f]) < s[600]), key=lambda f: (-len(files[f]), f))
        groups = defaultdict(list)
        for f, g in zip(small, first_fit([len(files[f]) for f in small], s[400]), strict=True):
            groups[g].append(f)
        for g in [[f] for f in files if f not in small] + list(groups.values()):
            members = [r for f in g for r in files[f]]
            ids = [r["click_id"] for r in members]
            known = [i for i in ids if i is not None]
            cents = sum(int((100 * r["value"] + 0.5) // 1) for r in members if r["value"] is not None)
            digest = hashlib.sha256(",".join("" if i is None else str(i) for i in ids).encode()).hexdigest()
            out.append((day, *g[0], len(ids), min(known, default=None), max(known, default=None), cents, ",".join(f"{a}-{b}" for a, b in g), digest, len(g) > 1))
    return sorted(out, key=str)


COMPACTED = ("day", "lot", "piece", "n_rows", "min_click_id", "max_click_id", "cents", "sources", "ids_sha256", "rewritten")


def check_compaction(df, tmp_path):
    df.write.parquet(f"{tmp_path}/clicks")
    table = pq.read_table(f"{tmp_path}/clicks")
    found = compacted_clicks(df).collect()
    assert sorted((tuple(r[c] for c in COMPACTED) for r in found), key=str) == brute_compaction(table)
    folders = {os.path.dirname(r.path.removeprefix("file:")) for r in found}
    assert len(folders) == (1 if found else 0)
    for folder in folders:
        assert {f for f in os.listdir(folder) if not f.startswith(".")} == {os.path.basename(r.path) for r in found}
    for r in found[:20]:
        held = pq.read_table(r.path.removeprefix("file:"))
        assert held.column_names == r.columns.split(",") == table.column_names and held.num_rows == r.n_rows
    return found


def test_compaction_of_the_clicks(spark, sf, tmp_path):
    found = check_compaction(spark.read.parquet(f"{sf}/clicks.parquet").filter("click_id < 700"), tmp_path)
    assert any(r.rewritten for r in found) and any(not r.rewritten for r in found)


def test_compaction_of_odd_clicks(spark, tmp_path):
    rows = [(i % 40 if i % 11 else None, None if i % 7 == 0 else datetime.datetime(2024, 1, 1 + i % 3, i % 24), None if i % 5 == 0 else i / 8, "a", i) for i in range(300)]
    df = spark.createDataFrame(rows, "click_id long, arrived_at timestamp_ntz, value double, c_key string, file_name int")
    check_compaction(df, tmp_path)
    assert compacted_clicks(df.filter("false")).collect() == []


def test_other_files_stay_byte_for_byte(spark, tmp_path):
    from tessera.llm.compaction import compact, plan_groups, write_sorted_files

    folder = str(tmp_path / "files")
    df = spark.createDataFrame([(k, i) for k, n in (("a", 50), ("b", 3), ("c", 2), ("d", 9)) for i in range(n)], "k string, v long")
    write_sorted_files(df.withColumn("key", df.k), "key", ["v"], folder)
    before = {f: open(f"{folder}/{f}", "rb").read() for f in ("a.parquet", "d.parquet")}
    sizes = df.groupBy("k").count().selectExpr("1L AS day", "k AS name", "count AS n_rows", "ascii(k) AS lot")
    compact(folder, plan_groups(sizes, "day", 10, 10, ["lot"]), df.schema)
    assert sorted(f for f in os.listdir(folder) if not f.startswith(".")) == ["a.parquet", "d.parquet", "merged-b.parquet"]
    assert before == {f: open(f"{folder}/{f}", "rb").read() for f in before}
    assert pq.read_table(f"{folder}/merged-b.parquet").column("v").to_pylist() == [0, 1, 2, 0, 1]


@pytest.mark.parametrize(("n", "letters"), [(1, 1), (4, 1), (61, 1), (100, 3)])
def test_suffix_ranks(spark, tmp_path, monkeypatch, n, letters):
    monkeypatch.setattr(suffixes, "BLOCK", 8)
    monkeypatch.setattr(suffixes, "PART_ROWS", 20)
    rng = random.Random(n)
    text = [rng.randint(1, letters) for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(text)), "pos long, c long")
    got = suffixes.suffix_ranks(df, n, str(tmp_path / "sa")).collect()
    order = [r["pos"] for r in sorted(got, key=lambda r: r["rank"])]
    assert order == sorted(range(n), key=lambda i: text[i:]) and sorted(r["rank"] for r in got) == list(range(1, n + 1))


@pytest.mark.parametrize("levels", [1, 2, 9])
def test_ranks_of_texts(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(suffixes, "BLOCK", 8)
    monkeypatch.setattr(suffixes, "PART_ROWS", 20)
    monkeypatch.setattr(suffixes, "TUPLE", 2)
    monkeypatch.setattr(suffixes, "LEVELS", levels)
    rng = random.Random(levels)
    base, own, rows = [rng.randint(10, 12) for _ in range(40)], iter(rng.sample(range(1, 10), 9)), []
    for uid, text in enumerate([base, base[5:], [11] * 30, base[:20], [], base[3:20] + base[:9]]):
        pos, stops = rng.sample(range(100), len(text) + 2), {len(text) // 3, len(text) + 1} if uid % 2 else {len(text) + 1}
        text = [next(own) if i in stops else c for i, c in enumerate([*text, 10, 10])]
        rows += [(uid, at, c, i in stops) for i, (at, c) in enumerate(zip(sorted(pos), text, strict=True))]
    df = spark.createDataFrame(rows, "uid long, pos long, c long, stop boolean").orderBy(F.rand(1))
    got = suffixes.text_ranks(df, len(rows), 12, str(tmp_path / "sa")).collect()
    order = [(r["uid"], r["pos"]) for r in sorted(got, key=lambda r: r["rank"])]
    key = {(u, p): [c for v, q, c, _ in rows if v == u and q >= p] for u, p, _, _ in rows}
    assert order == sorted(key, key=key.get) and sorted(r["rank"] for r in got) == list(range(1, len(rows) + 1))


def test_suffixes_of_texts_are_sorted_few_times(spark, monkeypatch):
    rng, sizes, real = random.Random(8), [], suffixes.numbered
    base = ["".join(rng.choice("abcdefgh ") for _ in range(3000)) for _ in range(8)]
    rows = [(i, "".join(rng.choice("xyz") for _ in range(500)) + base[i % 8][rng.randint(0, 300) :]) for i in range(40)]
    monkeypatch.setattr(suffixes, "numbered", lambda df, order, path, n, *a, **b: sizes.append(n) or real(df, order, path, n, *a, **b))
    got = passage_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute_passages(rows)
    assert sum(sizes) < 3 * max(sizes)


def brute_passages(rows):
    texts, starts = [(d, (t or "").encode()) for d, t in rows], Counter()
    for _, b in texts:
        starts.update(b[p : p + 400] for p in range(len(b) - 399))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - 399):
            if starts[b[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_passages_of_made_texts(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh ") for _ in range(2500))
    rows = [(1, base), (2, base[100:499] + "x" + base[600:1200]), (3, base[1000:1400]), (4, base[1000:1399]), (5, "a" * 900), (6, "ab" * 500), (7, None), (8, ""), (9, base), (9, base)]
    rows += [(None, "é" * 300 + base[2000:2450]), (11, base[:700] + base[:700]), (12, base[200:650] + "QQ" + base[300:720] + "ZZ" + base[305:760])]
    for i in range(20, 45):
        text = list(base)
        for _ in range(rng.randint(1, 12)):
            text[rng.randrange(len(text))] = "#"
        at = rng.randint(0, 1900)
        rows.append((i, "".join(text[at : at + rng.randint(300, 1300)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS uid", "2 AS pos", "3 AS body")
    assert sorted(map(tuple, passage_digest(df).collect()), key=str) == brute_passages(rows)


def test_passages_query_and_empty_table(spark, sf):
    from tessera.llm.queries import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = queries()["op13_repeated_passages"](spark, sf)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_passages(rows)
    assert passage_digest(docs.filter("false")).collect() == []


def test_a_text_longer_than_a_piece(spark, monkeypatch):
    from tessera.llm import repeats

    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(6000))
    text += text[1000:1900] + "".join(rng.choice("xyz") for _ in range(3000)) + text[2500:3000]
    whole = repeats._joined(repeats.sampled([text.encode(), b"short", text[:500].encode()]))
    monkeypatch.setattr(repeats, "_PIECE", 4000)
    cut = repeats._joined(repeats.sampled([text.encode(), b"short", text[:500].encode()]))
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))
