"""A counterfactual-regularised toxicity classifier (operator 4).

Texts become sets of hashed features: words and word beginnings, so that
inflected forms of a stem share one.  A logistic model is fitted on a bounded,
documented sample of the labelled training rows.  For every sentence of them
that names a group, a counterfactual sentence is made by swapping each identity
term for another of its list; the loss adds ``penalty`` times the squared change
of the score between a sentence and its counterfactual, so weights that only
tell groups apart are driven to zero and neutral mentions of a group are not
flagged.

The sample is the ``MAX_ROWS`` training rows of least hashed doc_id; only its
ids, a table of proven size, are broadcast.  Features are counted and selected
on the executors; the driver gets at most ``MAX_FEATURES`` of them, each sampled
row as a subset of these, and at most ``MAX_PAIRS`` pairs of sentences, so what
it holds does not grow with the length of texts.  Scoring is one pass without a
shuffle.

Defined results: a null or empty text has no features and gets the score of the
intercept; labels that are null are not learned from, and a document labelled
more than once counts as toxic if any label says so; with no usable labels every
score is 0; a null doc_id is held out and returned as null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, held_out, materialize, scratch

#: Labelled rows that the model is fitted on, at most.
MAX_ROWS = 12_000
#: Weight of the counterfactual penalty, of the ridge, and steps of the fit.
PENALTY, RIDGE, STEPS, RATE = 4.0, 2e-4, 400, 0.1
#: A feature is used if that many texts have it and its association with the label is that many deviations.
MIN_TEXTS, MIN_DEVIATIONS, MAX_FEATURES = 4, 5.0, 20_000
#: Distinct pairs of a sentence and its counterfactual that the model is fitted on, at most, by least hash.
MAX_PAIRS = 50_000
#: Lengths of word beginnings.
BEGINNINGS = (4, 5)
CACHE = 300_000

#: Identity terms of four languages; a term is in one list and is swapped within it.  Fixed values.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("gay", "lesbian", "bisexual", "transgender", "straight"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("disabled", "deaf", "blind", "old", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten", "katholiken"),
    ("schwule", "lesben", "transsexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "bürger"),
    ("behinderte", "gehörlose", "blinde", "alte", "junge"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre", "niña", "niño"),
    ("musulmán", "cristiano", "judío", "budista", "ateo", "católico"),
    ("musulmanes", "cristianos", "judíos", "budistas", "ateos", "católicos"),
    ("homosexuales", "heterosexuales", "bisexuales"),
    ("negro", "blanco", "asiático", "africano", "europeo"),
    ("inmigrante", "refugiado", "extranjero", "ciudadano"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
    ("discapacitado", "sordo", "ciego", "viejo", "joven"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée", "catholique"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("homosexuels", "hétérosexuels", "bisexuels"),
    ("noir", "blanc", "asiatique", "africain", "européen"),
    ("immigré", "réfugié", "étranger", "citoyen"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("handicapé", "sourd", "aveugle", "vieux", "jeune"),
)
SWAP = {term: group[(i + 1) % len(group)] for group in IDENTITY for i, term in enumerate(group)}

_WORDS, _SENTENCE = re.compile(r"[^\W\d_]+"), re.compile(r"[^.!?\n]+")


def _hash(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) & 0x7FFFFFFF


def word_features(word: str) -> tuple[int, ...]:
    return (_hash(f"w {word}"), *(_hash(f"b {word[:n]}") for n in BEGINNINGS if len(word) > n))


class Features(dict):
    """The features of each word, computed once while the cache has room."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = word_features(word)
        return value


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall(text.lower())) if text else set()


def swapped(words: set[str]) -> set[str] | None:
    """The words with every identity term swapped; None if there is none."""
    if not words & SWAP.keys():
        return None
    return {SWAP.get(w, w) for w in words}


def counterfactuals(text: str | None) -> Iterator[tuple[set[str], set[str]]]:
    """The words of each sentence that names a group, and those of its counterfactual."""
    if text and not SWAP.keys().isdisjoint(words_of(text)):
        for sentence in _SENTENCE.findall(text):
            mine = words_of(sentence)
            if its := swapped(mine):
                yield mine, its


@dataclass
class Model:
    """A linear model over hashed features."""

    intercept: float = -1e9
    weights: dict[int, float] = field(default_factory=dict)

    def score(self, features: set[int]) -> float:
        z = self.intercept + sum(self.weights[f] for f in features if f in self.weights)
        return float(1 / (1 + np.exp(-z))) if z > -700 else 0.0


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(texts: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], penalty: float = PENALTY, min_deviations: float = MIN_DEVIATIONS, min_texts: int = MIN_TEXTS) -> Model:
    """Fit on feature sets; ``pairs`` are those of a sentence and of its counterfactual."""
    if not len(texts) or not 0 < labels.sum() < len(labels):
        return Model()
    flat = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    names, column = np.unique(flat, return_inverse=True)
    n, positive = len(labels), labels.sum()
    have, toxic = np.bincount(column), np.bincount(column, weights=labels[row])
    rate = positive / n
    deviation = (toxic - have * rate) / np.sqrt(np.maximum(have * rate * (1 - rate) * (1 - have / (n + 1)), 1e-9))
    strong = np.flatnonzero((have >= min_texts) & (np.abs(deviation) >= min_deviations))
    strong = strong[np.argsort(-np.abs(deviation[strong]), kind="stable")][:MAX_FEATURES]
    place = np.full(len(names), -1)
    place[strong] = np.arange(len(strong))
    use = place[column] >= 0
    r, c = row[use], place[column][use]
    of = {int(names[s]): i for i, s in enumerate(strong)}

    def side(k: int) -> tuple[np.ndarray, np.ndarray]:
        """(pair, column) of the used features on one side of the pairs."""
        entries = [(i, of[f]) for i, pair in enumerate(pairs) for f in pair[k].tolist() if f in of]
        return tuple(np.array(entries, int).reshape(-1, 2).T)

    (mr, mc), (ir, ic), n_pairs = side(0), side(1), len(pairs)
    w, b = np.zeros(len(strong)), float(np.log(rate / (1 - rate)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(r, w[c], minlength=n)
        p = _sigmoid(z)
        error = (p - labels) / n
        grad = np.bincount(c, error[r], minlength=len(w)) + RIDGE * w
        grad_b = error.sum()
        if n_pairs:
            mine = _sigmoid(b + np.bincount(mr, w[mc], minlength=n_pairs))
            its = _sigmoid(b + np.bincount(ir, w[ic], minlength=n_pairs))
            change = 2 * penalty * (mine - its) / n_pairs
            up, down = change * mine * (1 - mine), change * its * (1 - its)
            grad += np.bincount(mc, up[mr], minlength=len(w)) - np.bincount(ic, down[ir], minlength=len(w))
            grad_b += (up - down).sum()
        g = np.append(grad, grad_b)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return Model(b, {int(names[s]): float(x) for s, x in zip(strong, w, strict=True)})


def _packed(words: set[str], features: Features) -> bytes:
    return np.unique(np.fromiter((f for w in words for f in features[w]), np.int32)).tobytes()


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = MAX_ROWS, penalty: float = PENALTY) -> Model:
    """Fit on at most ``max_rows`` labelled rows of the training folds."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    rows = rows.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Features()
        unpacked = lambda words: np.frombuffer(_packed(words, held), np.int32)
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pairs = [{"mine": unpacked(mine), "its": unpacked(its)} for mine, its in counterfactuals(text)]
                yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([unpacked(words_of(text))], sets), pa.array([pairs], pa.list_(pa.struct([("mine", sets), ("its", sets)])))], names=["y", "mine", "pairs"])

    sets, folder = pa.list_(pa.int32()), scratch(docs.sparkSession, "toxicity")
    chosen = documents(docs).join(F.broadcast(sample), "doc_id").select("y", "text")
    found = materialize(chosen.mapInArrow(run, "y int, mine array<int>, pairs array<struct<mine:array<int>,its:array<int>>>"), f"{folder}/sample")
    # Equal texts count once; the order of the rows does not matter to the result.
    rows = materialize(found.groupBy("mine").agg(F.max(F.when(F.col("y") != 0, 1).otherwise(0)).alias("y")), f"{folder}/rows")
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < positive < n:
        return Model()
    rate = positive / n
    counted = rows.select("y", F.explode("mine").alias("f")).groupBy("f").agg(F.count("*").alias("have"), F.sum("y").alias("toxic")).filter(F.col("have") >= MIN_TEXTS)
    spread = F.greatest(F.col("have") * rate * (1 - rate) * (1 - F.col("have") / (n + 1)), F.lit(1e-9))
    strong = counted.withColumn("deviation", F.abs(F.col("toxic") - F.col("have") * rate) / F.sqrt(spread)).filter(F.col("deviation") >= MIN_DEVIATIONS * (1 - 1e-9))
    used = np.array([r.f for r in strong.orderBy(F.desc("deviation"), "f").limit(MAX_FEATURES).select("f").collect()], np.int32)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[np.sort(v[np.isin(v, used)]).tobytes() for v in (np.array(x, np.int32) for x in column.to_pylist())] for column in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in columns)], names=batch.schema.names)

    of = lambda packed: np.frombuffer(packed, np.int32)
    picked = sorted((bytes(r.mine), r.y) for r in rows.select("y", "mine").mapInArrow(select, "y int, mine binary").collect())
    pairs = found.select("y", F.inline("pairs")).mapInArrow(select, "y int, mine binary, its binary").select("mine", "its").filter("mine <> its").distinct()
    pairs = sorted((bytes(r.mine), bytes(r.its)) for r in pairs.orderBy(F.xxhash64("mine", "its"), "mine", "its").limit(MAX_PAIRS).collect())
    return fit([of(mine) for mine, _ in picked], np.array([float(y) for _, y in picked]), [(of(mine), of(its)) for mine, its in pairs], penalty)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        held = model.weights
        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                hits: set[int] = set()
                for word in words_of(text):
                    features = known.get(word)
                    if features is None:
                        if len(known) >= CACHE:
                            known.clear()
                        known[word] = features = tuple(f for f in word_features(word) if f in held)
                    if features:
                        hits.update(features)
                scores.append(model.score(hits))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, score double")


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the contract."""
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
