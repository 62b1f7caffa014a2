import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

from tessera.llm import components, decontam, neardup

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_contamination(docs, items, width=10):
    windows = defaultdict(set)
    for name, text in items:
        w = WORD.findall((text or "").translate(LOW))
        for k in range(max(1, len(w) - width + 1)):
            if w:
                windows[tuple(w[k : k + width])].add(str(name))
    out = []
    for doc_id, text in docs:
        w = WORD.findall((text or "").translate(LOW))
        hit, names = set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= found
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_contamination_equals_brute_force(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = sorted((tuple(r) for r in decontam.contamination_digest(docs, bench).collect()), key=str)
    want = brute_contamination([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert got == want and any(r[5] for r in want)


def test_contamination_of_odd_rows_and_blocks(spark, odd, none):
    bench = spark.createDataFrame([(1, "A b C a b c"), (2, None), (3, ""), (None, "one"), (4, "some TEXT, with a few words in it"), (5, "a b c a b c"), (6, "!!")], "item_id long, text string")
    items = [(r.item_id, r.text) for r in bench.collect() if r.item_id is not None]
    want = brute_contamination([(r.doc_id, r.text) for r in odd.collect()], items)
    assert sorted((tuple(r) for r in decontam.contamination_digest(odd, bench).collect()), key=str) == want
    blocks = decontam.decontaminate(odd, bench, block_items=2).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in blocks), key=str) == [r[:4] for r in want]
    assert decontam.contamination_digest(none, bench).count() == 0
    assert not any(r.contaminated for r in decontam.contamination_digest(odd, bench.filter("false")).collect())


def test_a_window_does_not_cross_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "f g h i j")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert not any(r.contaminated for r in decontam.contamination_digest(docs, bench).collect())


def test_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(1, "x the red fox runs"), (2, "red quick fox red fox"), (3, "fox red")], "doc_id long, text string").coalesce(1)
    found = decontam.search(decontam.build_index(docs), [("q", "Red fox")], slop=1).collect()
    assert sorted((r.doc_id, r.position, r.width, r.exact) for r in found) == [(1, 2, 2, True), (2, 0, 3, False), (2, 3, 2, True)]


def words(text):
    return (text or "").encode().lower().split()


def brute_components(rows):
    sets, parent = {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for doc_id, text in rows:
        w = words(text)
        parent[doc_id] = doc_id
        sets[doc_id] = set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return sorted((i, len(sets[i]), find(i), i == find(i)) for i in ids)


def near_copies(seed=3, base=30):
    """Families around one text at distances about the threshold, linked in chains."""
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for _ in range(base):
        text = rng.integers(0, 5000, rng.integers(1, 120)).tolist()
        for _ in range(rng.integers(1, 12)):
            copy = list(text)
            for _ in range(rng.integers(0, max(1, len(text) // 8) + 1)):
                copy[rng.integers(0, len(copy))] = int(rng.integers(0, 5000))
            rows.append((n, " ".join(f"W{x}" for x in copy)))
            n += 1
            if rng.random() < 0.5:
                text = copy
    return rows


def test_components_of_near_copies_equal_brute_force(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in neardup.near_duplicates(docs).collect()) == brute_components(rows)


def family(members=700, length=60, seed=5):
    """One text with up to 14 of its words replaced, often by the same few words: many members just under and over the bound."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 5000, length)
    for n in range(members):
        copy = base.copy()
        at = rng.choice(length, rng.integers(0, 15), replace=False)
        copy[at] = 9000 + at * 3 + rng.integers(0, 3, len(at)) if n % 3 else rng.integers(10_000, 90_000, len(at))
        yield n, " ".join(f"w{x}" for x in copy)


def test_a_large_family_forms_few_pairs(spark, monkeypatch):
    rows, counts, write = list(family()), {}, neardup.materialize

    def counted(df, path):
        out = write(df, path)
        counts[path.rpartition("/")[2]] = out.count()
        return out

    monkeypatch.setattr(neardup, "materialize", counted)
    got = sorted(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)
    assert sum(c > 1 for c in Counter(r[2] for r in got).values()) and sum(r[3] for r in got) > 20
    assert 0 < counts["rest"] <= counts["buckets"] and counts["stars"] <= counts["buckets"]


def template(members=400, slots=12, values=4, length=60, seed=9):
    """Texts of one template that differ in a few slots of few values each."""
    rng = np.random.default_rng(seed)
    for i in range(members):
        words = [f"w{j}" for j in range(length)]
        for s, v in enumerate(rng.integers(0, values, slots)):
            words[s * (length // slots) + 2] = f"s{s}v{v}"
        yield i, " ".join(words)


def test_a_template_of_few_values_forms_few_pairs(spark, monkeypatch):
    rows, counts, write = list(template()), {}, neardup.materialize

    def counted(df, path):
        out = write(df, path)
        counts[path.rpartition("/")[2]] = out.count() if path.endswith(("rest", "buckets")) else 0
        return out

    monkeypatch.setattr(neardup, "materialize", counted)
    got = sorted(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)
    assert 0 < counts["rest"] <= counts["buckets"] / 2 and counts["rest"] < 0.08 * len(rows) ** 2 / 2


def test_prefixes_hold_the_common_elements_of_every_pair():
    rng = np.random.default_rng(2)
    for _ in range(300):
        weights, holders = rng.integers(1, 4, 30), rng.integers(2, 90, 30)
        order = sorted(range(30), key=lambda e: (holders[e], e))
        x, y = (set(rng.choice(30, rng.integers(4, 16), replace=False).tolist()) for _ in range(2))
        needed = int(sum(weights[e] for e in x & y))
        if not needed:
            continue
        lists = [[{"c": int(holders[e]), "e": e, "w": int(weights[e])} for e in order if e in s] for s in (x, y)]
        firsts = [neardup.prefixes(part, needed, 100) for part in lists]
        m = min(map(len, firsts))
        first = [{v["e"] for v in part[: f[m - 1]]} for part, f in zip(lists, firsts, strict=True)]
        assert m >= 1 and len(first[0] & first[1]) >= m


def test_texts_of_one_document_count_together(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (2, a), (2, b), (3, b), (4, a + " x"), (5, "other words here")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)} and len(got) == 6


def test_near_duplicates_of_odd_rows(odd, none):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(odd).collect()}
    want = set(brute_components(dict((r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None).items()))
    assert got == want | {(None, 7, None, True)}
    assert neardup.near_duplicates(odd).count() == odd.count()
    assert neardup.near_duplicates(none).count() == 0


def test_densified_bins_agree_as_often_as_sets():
    rng = np.random.default_rng(1)
    for n in (4, 20, 400):
        agree = []
        for _ in range(200):
            both = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            one = np.unique(np.r_[both, rng.integers(0, 1 << 63, n // 4, dtype=np.uint64) * np.uint64(2)])
            agree.append(np.mean(neardup.one_permutation(both, 300) == neardup.one_permutation(one, 300)))
        assert abs(np.mean(agree) - 0.8) < 0.03


def test_components_of_a_long_chain_and_a_star(spark, tmp_path):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(50)] + [(5, 5), (None, 7), (41, 40)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), str(tmp_path / "cc"))
    labels = {r.id: r.component for r in got.collect()}
    assert labels == {**{i: 0 for i in range(42)}, **{1000 + i: 1000 for i in range(50)}}
