"""Evaluation: recall, hit rates, length statistics, profiles of documents."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from tessera.functions import text as X
from tessera.functions.patterns import Patterns
from tessera.operators.retrieval import arrow_rows, blockwise, ranked

# Upper bounds of the length buckets.
BUCKETS = (50, 100, 200, 500, 1000)


def recall_at(hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """By group and over all, the percent of queries with a relevant hit among the first k.

    ``hits`` has (query_id, rank, relevant), ``queries`` (query_id, grp).  The
    row of a null group holds all queries.
    """
    best = hits.filter(F.col("rank") <= k).groupBy("query_id").agg(F.max(F.col("relevant").cast("int")).alias("hit"))
    rows = queries.join(best, "query_id", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return rows.rollup("grp").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.round(100 * F.avg("hit"), 1).alias("recall"))


def hit_rates(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries with a relevant hit first, among three, and anywhere."""
    flag = lambda k: F.max((F.col("relevant") & (F.col("rank") <= k)).cast("int"))
    best = hits.groupBy("query_id").agg(flag(1).alias("at1"), flag(3).alias("at3"), flag(1 << 30).alias("anywhere"))
    joined = queries.select("query_id").join(best, "query_id", "left")
    return joined.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("at1", "at3", "anywhere")))


def length_statistics(rows: DataFrame, length: Column, by: list[str], pictures: Column | None = None) -> DataFrame:
    """Count, least, greatest, mean, median and sample deviation (0 for one) of a length, and rows with pictures."""
    shown = F.lit(False) if pictures is None else F.coalesce(pictures, F.lit(False))
    return rows.select(*by, length.alias("length"), shown.cast("long").alias("shown")).groupBy(*by).agg(
        F.sum("shown").alias("with_pics"),
        F.count("length").alias("n"), F.min("length").alias("least"), F.max("length").alias("greatest"), F.round(F.avg("length"), 1).alias("mean"), F.round(F.median("length"), 1).alias("median"), F.coalesce(F.round(F.stddev_samp("length"), 1), F.lit(0.0)).alias("deviation")
    )


def length_bucket(length: Column) -> Column:
    """The name of the bucket of a length."""
    out, low = None, 0
    for high in BUCKETS:
        name = f"{low}-{high - 1}" if low else f"<{high}"
        out = F.when(length < high, name) if out is None else out.when(length < high, name)
        low = high
    return out.otherwise(f"{low}+")


def document_profiles(chunks: DataFrame, terms: int = 256) -> DataFrame:
    """A5: per document the shortest name, its most frequent terms and its chunk count.

    Terms have two characters or more and are no stop words nor page labels
    (F17).  Counts are over the whole table.  Where chunks have pic_ids, an
    array, the profile has their prefixes.
    """
    words = chunks.select("doc", F.explode(X.english_tokens(F.col("text"))).alias("term")).filter((F.length("term") >= 2) & ~F.col("term").rlike("^(manual|page)[0-9]+$"))
    counts = words.groupBy("doc", "term").agg(F.count("*").alias("n"))
    top = ranked(counts, [F.desc("n"), F.asc("term")], ["doc"]).filter(F.col("rank") <= terms)
    listed = top.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda t: t["term"]).alias("terms"))
    basics = chunks.groupBy("doc").agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("name"), F.count("*").alias("chunks"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    out = basics.join(listed, "doc", "left")
    if "pic_ids" not in chunks.columns:
        return out
    pic = X.normalize_text(F.col("pic"))
    prefix = F.when(pic.rlike("_[0-9]+$"), F.regexp_replace(pic, "_[0-9]+$", "_")).otherwise(F.concat(F.substring_index(pic, "_", 1), F.lit("_")))
    prefixes = chunks.select("doc", F.explode("pic_ids").alias("pic")).filter(F.col("pic").contains("_")).groupBy("doc").agg(F.array_sort(F.collect_set(prefix)).alias("pic_prefixes"))
    return out.join(prefixes, "doc", "left")


#: Profiles that a task compares with a block of questions at once.
PROFILE_ROWS = 200


class Profiles:
    """A few profiles, found by what a question contains (J14); points are hundredths."""

    def __init__(self, rows: list[tuple], terms: int, first: int, asked: Patterns) -> None:
        self.inside: dict[str, list[int]] = defaultdict(list)
        self.named: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.whole: dict[str, set[int]] = defaultdict(set)
        self.early: dict[str, set[int]] = defaultdict(set)
        self.pictured: dict[str, set[int]] = defaultdict(set)
        for i, (_, name, key, held, prefixes) in enumerate(rows):
            self.named[name].append((i, 85))
            self.named[key].append((i, 75))
            for n, t in enumerate(held):
                self.whole[t].add(i)
                if n < terms:
                    self.inside[t].append(i)
                if n < first and len(t) >= 2:
                    self.early[t].add(i)
            for p in prefixes:
                if p is not None:
                    self.pictured[p].add(i)
        self._patterns, self._early = Patterns({*self.inside, *self.named}), Patterns(self.early)
        self._longer: dict[str, list[str]] = defaultdict(list)  # a question's term: profile terms that contain it
        for t in self.early:
            for a in asked.within(t):
                self._longer[a].append(t)
        self._near: dict[str, set[int]] = {}

    def near(self, term: str) -> set[int]:
        """Profiles with an early term that contains the question's or lies in it."""
        if term not in self._near:
            found = {*self._early.within(term), *self._longer.get(term, ())} if len(term) >= 2 else ()
            self._near[term] = set().union(*(self.early[t] for t in found))
        return self._near[term]

    def scores(self, query: str, asked: list[str], pic: str) -> dict[int, int]:
        fixed, inside, shared = Counter(), Counter(), Counter()
        for found in self._patterns.within(query):
            for i in self.inside.get(found, ()):
                inside[i] += 12 if len(found) >= 4 else 8
            for i, points in self.named.get(found, ()):
                fixed[i] += points
        if pic:
            for i in set().union(*(self.pictured.get(pic[:n], ()) for n in range(len(pic) + 1))):
                fixed[i] += 100
        for a in asked:
            equal = self.whole.get(a, set())
            for i in equal:
                shared[i] += 10
            for i in self.near(a) - equal:
                shared[i] += 6
        return {i: min(100, fixed[i] + min(45, inside[i]) + min(30, shared[i])) for i in {*fixed, *inside, *shared}}


def profile_scores(queries: DataFrame, profiles: DataFrame, terms: int = 256, first: int = 32) -> DataFrame:
    """Queries scored against document profiles by picture prefix, name, id and terms; 0.18 or more.

    A picture id that starts with one of the profile's prefixes gives 1, the
    document's name in the query 0.85, its id 0.75.  Profile terms contained in
    the query give 0.12 (four characters or more) or 0.08, 0.45 at most; query
    terms give 0.1 where equal to a profile term and else 0.06 where one of the
    first 32 contains them or is contained, 0.3 at most.

    Containment has no key: a task builds automata of the strings of a few
    profiles and of a block's query terms, and only pairs that share something
    are scored.  Queries are a stated set and go in blocks; profiles stay where
    they are.  Null names, ids and texts are empty and match nothing; rows that
    share an id count each.
    """
    norm = lambda c: X.normalize_text(F.coalesce(c.cast("string"), F.lit("")))
    asked = queries.select("query_id", norm(F.col("text")).alias("query"), F.transform(X.query_terms(F.col("text")), norm).alias("asked"), norm(X.picture_id(F.col("text"))).alias("pic"))
    none = F.expr("cast(array() AS array<string>)")
    listed = F.filter(F.transform(F.coalesce("terms", none), norm), lambda t: t != "")
    prefixes = F.coalesce("pic_prefixes", none) if "pic_prefixes" in profiles.columns else none
    held = profiles.select("doc", norm(F.col("name")).alias("name"), norm(F.col("doc")).alias("key"), listed.alias("terms"), prefixes.alias("prefixes"))
    types = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField("doc", held.schema["doc"].dataType), StructField("score", DoubleType())])

    def block_scores(block: list) -> DataFrame:
        questions = [tuple(r) for r in block]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = Patterns({a for _, _, asked, _ in questions for a in asked or ()})
            for batch in (b.slice(i, PROFILE_ROWS) for b in batches for i in range(0, b.num_rows, PROFILE_ROWS)):
                rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
                some = Profiles(rows, terms, first, words)
                for i, query, asked, pic in questions:
                    yield from arrow_rows([(i, rows[p][0], s / 100) for p, s in some.scores(query, asked or [], pic).items() if s >= 18], types)

        return held.mapInArrow(run, types)

    return blockwise(asked, block_scores)


def summary_scores(queries: DataFrame, summaries: DataFrame) -> DataFrame:
    """Queries scored against document summaries; 0.18 or more, 0.92 at most.

    A query term contained in name, title, summary and terms together, without
    white space, gives 0.16 (four characters or more) or 0.1, the whole query
    0.4.  ``summaries`` has doc, doc_name, title, summary and the array terms;
    ``matched`` holds the terms found, in the order of the query.  Terms and
    texts of a block of queries form one automaton, and a summary is read once
    for each block.  Null and empty queries match nothing, nor do summaries
    without an id or a text.
    """
    blank, none = F.lit(""), F.expr("cast(array() AS array<string>)")
    said = F.concat_ws(" ", *(F.coalesce(F.col(c), blank) for c in ("doc_name", "title", "summary")), F.array_join(F.coalesce("terms", none), " "))
    held = summaries.select("doc", X.normalize_text(said).alias("hay")).filter("trim(doc) <> '' AND hay <> ''")
    asked = queries.select("query_id", X.normalize_text(F.coalesce("text", blank)).alias("query"), F.filter(F.transform(X.query_terms(F.col("text")), X.normalize_text), lambda t: t != "").alias("asked"))
    types = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField("doc", held.schema["doc"].dataType), StructField("score", DoubleType()), StructField("matched", ArrayType(StringType()))])

    def block_scores(block: list) -> DataFrame:
        questions = [(i, query, asked or []) for i, query, asked in block]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            holders: dict[str, list[int]] = defaultdict(list)
            for q, (_, query, terms) in enumerate(questions):
                for t in {query, *terms}:
                    holders[t].append(q)
            patterns = Patterns(holders)
            for batch in batches:
                for doc, hay in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found, rows = patterns.within(hay), []
                    for q in set().union(*(holders[t] for t in found)):
                        i, query, terms = questions[q]
                        matched = [t for t in terms if t in found]
                        score = min(92, sum(16 if len(t) >= 4 else 10 for t in matched) + (40 if query in found else 0))
                        if score >= 18:
                            rows.append((i, doc, score / 100, matched))
                    yield from arrow_rows(rows, types)

        return held.mapInArrow(run, types)

    return blockwise(asked, block_scores)


def profile_summaries(profiles: DataFrame, first: int = 32) -> DataFrame:
    """Document profiles as summaries, where no summary index is given."""
    none = F.expr("cast(array() AS array<string>)")
    terms = F.coalesce("terms", none)
    said = F.array_join(F.concat(F.slice(terms, 1, first), F.coalesce("kinds", none)), " ")
    return profiles.select("doc", F.col("name").alias("doc_name"), F.col("name").alias("title"), said.alias("summary"), terms.alias("terms"))


def judge_accuracy(hypotheses: DataFrame, labels: DataFrame) -> DataFrame:
    """By question type and over all (a null type), the share of answers that a judge called correct.

    ``hypotheses`` has question_id and question_type, each question once;
    ``labels`` question_id and the judge's word, yes or no with at most one end
    mark.  Any other word is refused, not counted.
    """
    word = F.lower(X.strip(F.col("label")))
    said = labels.select("question_id", F.when(word.rlike(r"^yes[.!。]?\z"), 1).when(word.rlike(r"^no[.!。]?\z"), 0).alias("correct"))
    rows = hypotheses.join(said, "question_id")
    return rows.rollup("question_type").agg(F.count("correct").alias("n"), F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"), F.round(F.avg("correct"), 4).alias("accuracy"), F.count_if(F.col("correct").isNull()).alias("refused"))


def case_subset(cases: DataFrame, ids: list | None = None, skip: int = 0, limit: int | None = None, key: str = "case_id") -> DataFrame:
    """cases of a set of ids, then a slice of them in the order of the id."""
    rows = (cases if not ids else cases.filter(F.col(key).isin(ids))).orderBy(key)
    rows = rows.offset(skip) if skip else rows
    return rows if limit is None else rows.limit(limit)


def evidence_evaluation(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Per case whether the intent agrees and an expected chunk is first, among three, or anywhere; and a picture.

    ``cases`` has query_id, intent, said_intent and the arrays expected and
    expected_pics; ``hits`` query_id, chunk_id, rank, role and the array
    pic_ids.  Support hits count for anywhere only.  No expected picture is a
    hit, no expected chunk none.
    """
    none = F.expr("cast(array() AS array<string>)")
    primary = F.col("role") == "primary"
    ids = lambda k: F.collect_set(F.when(primary & (F.col("rank") <= k), F.col("chunk_id")))
    shown = hits.groupBy("query_id").agg(ids(1).alias("one"), ids(3).alias("three"), F.collect_set("chunk_id").alias("every"), F.flatten(F.collect_set(F.coalesce("pic_ids", none))).alias("pics"))
    rows = cases.join(shown, "query_id", "left")
    meets = lambda a, b: F.coalesce(F.arrays_overlap(F.coalesce(F.col(a), none), F.coalesce(F.col(b), none)), F.lit(False))
    asked = F.coalesce("expected_pics", none)
    return rows.select(
        "query_id", F.coalesce(F.col("intent") == F.col("said_intent"), F.lit(False)).alias("intent_match"), meets("expected", "one").alias("hit_at_1"), meets("expected", "three").alias("hit_at_3"),
        meets("expected", "every").alias("hit_anywhere"), ((F.size(asked) == 0) | meets("expected_pics", "pics")).alias("pic_hit"),
    )


def shared_term_scores(queries: DataFrame, profiles: DataFrame, first: int = 32) -> DataFrame:
    """The part of J14 that an equi-join can give: whole terms shared with the first 32, capped; 0.18 or more.

    No name, id, picture, substring or later term counts; ``profile_scores`` has
    the whole rule.
    """
    asked = queries.select("query_id", F.explode(X.query_terms(F.col("text"))).alias("term"))
    held = profiles.select("doc", F.explode(F.slice("terms", 1, first)).alias("term"))
    score = F.round(F.least(F.lit(0.3), F.sum(F.lit(0.1))) + F.least(F.lit(0.45), F.sum(F.when(F.length("term") >= 4, 0.12).otherwise(0.08))), 4)
    return asked.join(held, "term").groupBy("query_id", "doc").agg(F.least(F.lit(1.0), score).alias("score")).filter("score >= 0.18")


#: Questions of one pass over the documents, and words or n-grams that a task holds at once.
TFIDF_BLOCK, TFIDF_HELD = 256, 400_000


class _Numbers(dict):
    """Strings numbered in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Grams:
    """Character n-grams of the words of lower-cased texts, as numbers in an index."""

    def __init__(self, low: int, high: int, index: dict[str, int] | None = None) -> None:
        self.low, self.high, self.fixed = low, high, index is not None
        self.index: dict[str, int] = index if index is not None else _Numbers()
        self._words: dict[str, np.ndarray] = {}

    def _of(self, word: str) -> np.ndarray:
        if (ids := self._words.get(word)) is None:
            if len(self._words) >= TFIDF_HELD:
                self._words.clear()
            w = f" {word} "
            grams = [w[i : i + n] for n in range(self.low, self.high + 1) for i in range(len(w) - n + 1)]
            found = map(self.index.get, grams, repeat(-1)) if self.fixed else map(self.index.__getitem__, grams)
            ids = np.array(list(found), np.int64)
            self._words[word] = ids = ids[ids >= 0]
        return ids

    def forget(self) -> None:
        self.index, self._words = _Numbers(), {}

    def counts(self, low: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of a text and how often each occurs."""
        parts = [self._of(w) for w in re.findall(r"\S+", low or "", re.ASCII)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.unique(np.concatenate(parts), return_counts=True)

    def vector(self, low: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of a text and their weights, of length one."""
        held, tf = self.counts(low)
        w = (1 + np.log(tf)) * idf[held]
        return held, w / (np.sqrt(w @ w) or 1.0)


def tfidf_hits(docs: DataFrame, queries: DataFrame, k: int = 5, low: int = 2, high: int = 4, max_features: int = 50_000) -> DataFrame:
    """Character n-grams inside words, sublinear tf, smooth idf, cosine; positive scores, the best k.

    ``docs`` has (id, text), ``queries`` (query_id, text).  One pass over the
    documents counts n-grams, of which the ``max_features`` most frequent are
    kept; one more for each block of questions scores every document, and a
    task hands on its best k of each question.  Each row of ``docs`` is a
    document; rows that share an id count by the best.
    """
    texts = docs.select("id", F.lower("text").alias("low"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, df, total = Grams(low, high), np.zeros(1024, np.int64), np.zeros(1024, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            names, n = list(grams.index), len(grams.index)
            for i in range(0, n, 50_000):
                j = min(n, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(names[i:j], pa.string()), pa.array(df[i:j]), pa.array(total[i:j])], names=["gram", "df", "total"])

        for batch in batches:
            for text in batch.column(1).to_pylist():
                held, tf = grams.counts(text)
                if len(grams.index) > len(df):
                    df, total = (np.concatenate([x, np.zeros(2 * len(grams.index) - len(x), np.int64)]) for x in (df, total))
                df[held] += 1
                total[held] += tf
                if len(grams.index) >= TFIDF_HELD:
                    yield from out()
                    grams.forget()
                    df[:], total[:] = 0, 0
        yield from out()

    counted = texts.mapInArrow(count, "gram string, df long, total long").groupBy("gram").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    features = counted.orderBy(F.desc("total"), F.asc("gram")).limit(max_features).collect()
    n_docs = docs.count()
    names, idf = [r.gram for r in features], np.array([math.log((1 + n_docs) / (1 + r.df)) + 1 for r in features])
    asked = queries.select("query_id", F.lower("text").alias("low"))
    types = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField("chunk_id", texts.schema["id"].dataType), StructField("score", DoubleType())])

    def block_hits(block: list) -> DataFrame:
        ids, questions = [r[0] for r in block], [r[1] for r in block]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams = Grams(low, high, {g: i for i, g in enumerate(names)})
            vectors = [grams.vector(t, idf) for t in questions]
            used = np.unique(np.concatenate([held for held, _ in vectors])) if vectors else np.zeros(0, np.int64)
            place = np.full(len(names) + 1, -1)
            place[used] = np.arange(len(used))
            weights = np.zeros((len(used), len(ids)))
            for q, (held, w) in enumerate(vectors):
                weights[place[held], q] = w
            best: list[dict] = [{} for _ in ids]
            floor = np.zeros(len(ids))
            for batch in batches:
                for chunk, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held, w = grams.vector(text, idf)
                    at = place[held]
                    scores = np.round(w[at >= 0] @ weights[at[at >= 0]], 6)
                    for q in np.flatnonzero((scores > 0) & (scores >= floor)):
                        mine = best[q]
                        mine[chunk] = max(mine.get(chunk, 0.0), float(scores[q]))
                        if len(mine) > 4 * k:
                            best[q] = mine = dict(sorted(mine.items(), key=lambda m: (-m[1], m[0] is not None, m[0]))[:k])
                            floor[q] = min(mine.values())
            yield from arrow_rows([(ids[q], c, v) for q, mine in enumerate(best) for c, v in mine.items()], types)

        return texts.mapInArrow(run, types)

    found = blockwise(asked, block_hits, TFIDF_BLOCK)
    hits = found.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return ranked(hits, [F.desc("score"), F.asc("chunk_id")]).filter(F.col("rank") <= k)
