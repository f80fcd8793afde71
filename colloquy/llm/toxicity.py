"""Toxicity by a counterfactual-regularised classifier.

Method: logistic regression over the words of a text and their beginnings. In
sentences of labelled texts that name a group, the group's term is swapped for the
others of its language and kind; the squared change of the score of the whole text that a swap makes is added to
the loss, so that neutral mentions of a group don't move the score.

Fitting reads a bounded sample: at most SAMPLE labelled rows, taken by a hash of
their id from rows that are not held out; FEATURES features are kept, those
whose share differs most between the labels. Scoring reads every whole text.

Defined results: a null or empty text has no features and gets the score of the
bias alone. An id with several labels counts as toxic if one of them is. Without
labels of both kinds every score is the share of toxic labels (0 if there are none).
Every row gives one row. An empty table gives an empty result. Columns other than
id, text and label are not read. Ties between features go to the smaller word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .language_id import held_out

#: Bounds of the fitting sample and of the model.
SAMPLE = 20_000
FEATURES = 4_000
LEAST_TEXTS = 3
BEGINNINGS = (4, 5, 6)
TEXTS_PER_BATCH = 200
STEPS, RATE, RIDGE = 300, 0.1, 1e-4
#: Weight of the counterfactual term.
SWAP_WEIGHT = 1.0
THRESHOLD = 0.3

WORDS = re.compile(r"[^\W\d_]+")
SENTENCES = re.compile(r"[.!?\n]+")

#: Fixed lists of terms that name groups, by language and kind; a swap stays within both.
IDENTITY_TERMS = {
    "en gender": ("woman", "man", "women", "men", "female", "male", "transgender", "nonbinary"),
    "en religion": ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    "en origin": ("african", "american", "asian", "european", "arab", "mexican", "immigrant"),
    "en colour": ("black", "white", "brown"),
    "en orientation": ("gay", "lesbian", "straight", "bisexual", "queer"),
    "en age": ("old", "young", "elderly", "teenage"),
    "en ability": ("blind", "deaf", "disabled", "autistic"),
    "fr gender": ("femme", "homme", "femmes", "hommes", "transgenre"),
    "fr religion": ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée", "catholique"),
    "fr origin": ("africain", "américain", "asiatique", "européen", "arabe", "mexicain", "immigré"),
    "fr orientation": ("homosexuel", "lesbienne", "hétérosexuel", "bisexuel"),
    "fr ability": ("aveugle", "sourd", "handicapé", "autiste"),
    "de gender": ("frau", "mann", "frauen", "männer", "transgender"),
    "de religion": ("muslim", "christ", "jude", "hindu", "buddhist", "atheist", "katholik"),
    "de origin": ("afrikaner", "amerikaner", "asiate", "europäer", "araber", "mexikaner", "einwanderer"),
    "de orientation": ("schwul", "lesbisch", "heterosexuell", "bisexuell"),
    "de ability": ("blind", "taub", "behindert", "autistisch"),
    "es gender": ("mujer", "hombre", "mujeres", "hombres", "transgénero"),
    "es religion": ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo", "católico"),
    "es origin": ("africano", "americano", "asiático", "europeo", "árabe", "mexicano", "inmigrante"),
    "es orientation": ("homosexual", "lesbiana", "heterosexual", "bisexual"),
    "es ability": ("ciego", "sordo", "discapacitado", "autista"),
}


def others_of(term: str) -> list[str]:
    """What a term is swapped for: the other terms of each of its kinds."""
    return list(dict.fromkeys(x for terms in IDENTITY_TERMS.values() if term in terms for x in terms if x != term))


OTHERS = {term: others_of(term) for terms in IDENTITY_TERMS.values() for term in terms}


def features_of_word(word: str) -> list[str]:
    return [word, *(f"^{word[:n]}" for n in BEGINNINGS if len(word) > n)]


def features_of(text: str | None) -> set[str]:
    return {f for w in set(WORDS.findall((text or "").lower())) for f in features_of_word(w)}


def swap_changes(text: str | None) -> Counter:
    """What swaps do to a text's features: (features that come, features that go) and how many swaps do just that.

    A swap puts another term in the place of a group's term throughout one sentence. A feature goes
    if nothing else in the text gives it, and comes if nothing gave it, so
    counts of the text's words tell it, however many sentences there are.
    """
    sentences = [Counter(WORDS.findall(s)) for s in SENTENCES.split((text or "").lower())]
    words = Counter()
    for s in sentences:
        words.update(s)
    given = Counter(f for w in words for f in features_of_word(w))
    out = Counter()
    for s in sentences:
        for term in OTHERS.keys() & s.keys():
            gone = features_of_word(term) if words[term] == s[term] else []
            for other in OTHERS[term]:
                came = features_of_word(other) if other not in words else []
                left = frozenset(f for f in gone if given[f] == 1 and f not in came)
                out[frozenset(f for f in came if not given[f]), left] += 1
    return out


@dataclass
class Model:
    """``swaps``: how many swaps the fit used, equal ones of a text counted each."""

    bias: float = -20.0
    weights: dict[str, float] = field(default_factory=dict)
    swaps: int = 0

    def score(self, text: str | None) -> float:
        weights = self.weights
        total = self.bias + sum(weights[f] for f in features_of(text) if f in weights)
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -30.0, 30.0))))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, toxic) of at most SAMPLE labelled ids; the ids are few enough to send to all executors. Of rows of one id the smallest text."""
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("toxic"))
    few = ids.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(few), "_id")
    return found.groupBy("_id").agg(F.min("_text").alias("_text"), F.first("toxic").alias("toxic")).select("_text", "toxic")


def fit_weights(texts: list[list[int]], toxic: np.ndarray, size: int, swaps: list[list[int]], times: list[int], swap_weight: float = SWAP_WEIGHT) -> tuple[float, np.ndarray]:
    """Bias and weights by accelerated full-batch gradient steps (Adam).

    A swap is the features that it brings (place + 1) and takes away (-place - 1), ``times`` how often it stands.
    """
    share = np.array(times, float) / max(sum(times), 1)
    swap_of = np.repeat(np.arange(len(swaps)), [len(x) for x in swaps])
    moved = np.fromiter((f for x in swaps for f in x), np.int64)
    swap_at, sign = np.abs(moved) - 1, np.sign(moved).astype(float)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    at = np.fromiter((f for t in texts for f in t), np.int64)
    n = len(texts)
    w = np.zeros(size + 1)
    w[-1] = np.log(max(toxic.mean(), 1e-6) / max(1 - toxic.mean(), 1e-6))
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        z = w[-1] + np.bincount(of, w[at], minlength=n)
        left = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic
        grad = np.append(np.bincount(at, left[of], minlength=size) / n + RIDGE * w[:-1], left.mean())
        if len(swaps):
            change = np.bincount(swap_of, sign * w[swap_at], minlength=len(swaps))
            grad[:-1] += 2 * swap_weight * np.bincount(swap_at, sign * (share * change)[swap_of], minlength=size)
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        w -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return float(w[-1]), w[:-1]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", swap_weight: float = SWAP_WEIGHT) -> Model:
    """Fit on the labelled sample."""
    sample = stored(labelled_sample(docs, labels, id_col, text_col, label_col), "toxicity-sample")
    totals = {r["toxic"]: r["count"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    ones, zeros = totals.get(1, 0), totals.get(0, 0)
    if not ones or not zeros:
        return Model(bias=30.0 if ones else -30.0)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), TEXTS_PER_BATCH):
                part = b.iloc[at : at + TEXTS_PER_BATCH]
                found = [list(features_of(t)) for t in part["_text"]]
                ones_ = np.repeat((part["toxic"] > 0).astype(int).to_numpy(), [len(f) for f in found])
                yield pd.DataFrame({"feature": pd.Series([x for f in found for x in f], dtype=object), "one": ones_})

    counted = sample.mapInPandas(words, "feature string, one int").groupBy("feature").agg(F.sum("one").alias("a"), F.count("*").alias("n")).where(F.col("n") >= LEAST_TEXTS)
    share = F.col("n") / float(ones + zeros)
    apart = F.abs(F.col("a") / float(ones) - (F.col("n") - F.col("a")) / float(zeros)) / F.sqrt(share * (1.0 - share) + 1e-9)
    kept = [r["feature"] for r in counted.select("feature", apart.alias("apart")).orderBy(F.desc("apart"), "feature").limit(FEATURES).collect()]
    # Group terms are features in any case, so that swaps have a score to change.
    place = {f: i for i, f in enumerate(dict.fromkeys([*kept, *(f for t in OTHERS for f in features_of_word(t))]))}

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, one in zip(b["_text"], b["toxic"] > 0, strict=True):
                own = {place[f] for f in features_of(text) if f in place}
                changes = swap_changes(text)
                coded_ = [sorted([*(place[f] + 1 for f in came if f in place), *(-place[f] - 1 for f in left if f in place)]) for came, left in changes]
                rows.append((sorted(own), coded_, list(changes.values()), int(one)))
            yield pd.DataFrame(rows, columns=["features", "swaps", "times", "one"])

    texts, toxic, swaps, times = [], [], [], []
    # A text gives no more different swaps than the lists have pairs of terms, however long it is.
    for r in sample.mapInPandas(coded, "features array<int>, swaps array<array<int>>, times array<long>, one int").toLocalIterator():
        texts.append(r["features"])
        toxic.append(r["one"])
        swaps += r["swaps"]
        times += r["times"]
    bias, weights = fit_weights(texts, np.array(toxic, float), len(place), swaps, times, swap_weight)
    return Model(bias, {f: float(weights[i]) for f, i in place.items() if weights[i]}, sum(times))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id and score."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "score": [model.score(t) for t in b["_text"]]})

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, f"_id {kind}, score double").withColumnRenamed("_id", id_col)
