"""Toxicity: cumulative-link ordinal regression on sparse text features.

Keys of a text are its words and the beginnings of its longer words (insults are often built on one
stem). A key gives up to three features: it occurs; it makes up a noticeable share of the words; a
large share. The model has one weight per feature, shared by all ordered thresholds:
P(grade >= k) = sigmoid(weights * features - threshold k). The expected severity is the sum of these
over k; a document is called toxic if P(grade >= 1) reaches the cut.

Labels say toxic or not; grades beyond that come from the labelled texts themselves: toxic documents
are cut into `GRADES` - 1 equal groups by the share of their words that speak for toxicity.

The model is fitted on a bounded sample: at most `per_label` documents of each label, those with the
lowest hash of doc_id, none of them held out (see quality.held_out). Its features are all that speak for
toxicity with some certainty: their log odds are at least `least_z` standard errors above 0. What speaks
against it is only how much clean text there is. Feature counts of the sample are summed by Spark. All
documents are scored, whole.

Null and empty texts have no features: their score is that of the thresholds alone. Contradicting
labels of one doc_id are left out; repeated rows are scored each; with no label of either kind to
learn from, scores and severities are 0. An empty table gives an empty result. Only doc_id and text of documents are
read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payscope.llm.common import by_batch, staged, texts
from payscope.llm.quality import held_out, labelled_sample

GRADES = 4  # 0 (not toxic) to 3
STEPS = (0.0, 0.005, 0.02)  # least share of all words for each feature of a key
STEMS = (4, 5, 7)
_LETTERS = bytes(
    b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def keys_of(word: bytes) -> list[bytes]:
    """The word and the beginnings of its longer forms, marked by a hyphen."""
    if len(word) <= STEMS[0]:
        return [word]
    letters = word.decode("utf-8", "replace")
    return [word, *(letters[:n].encode() + b"-" for n in STEMS if len(letters) >= n)]


def _words(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def _steps(count: int, n: int) -> range:
    """The features of a key that occurs `count` times in n words; shares need two occurrences."""
    return range(1 + sum(count >= 2 and count >= s * n for s in STEPS[1:]))


def features_of(text: bytes) -> set[tuple[bytes, int]]:
    words = _words(text)
    counts: Counter = Counter()
    for word, c in Counter(words).items():
        for key in keys_of(word):
            counts[key] += c
    return {(key, s) for key, c in counts.items() for s in _steps(c, len(words))}


class Extractor:
    """Numbers of the model's features in a text; words are looked up once and kept."""

    def __init__(self, features: dict[tuple[bytes, int], int], cached: int = 100_000):
        self.features = features
        known = {key for key, _ in features}

        class Known(dict):
            def __missing__(self, word: bytes) -> tuple[bytes, ...]:
                if len(self) >= cached:
                    self.clear()
                self[word] = found = tuple(k for k in keys_of(word) if k in known)
                return found

        self.known = Known().__getitem__

    def __call__(self, text: bytes) -> tuple[list[int], int]:
        """Feature numbers, and the number of words."""
        words = _words(text)
        counts: Counter = Counter()
        for keys in filter(None, map(self.known, words)):
            counts.update(keys)
        found = [
            n
            for key, c in counts.items()
            for s in _steps(c, len(words))
            if (n := self.features.get((key, s))) is not None
        ]
        return found, len(words)


@dataclass
class Model:
    features: dict[tuple[bytes, int], int]
    weights: np.ndarray
    thresholds: np.ndarray  # ascending


def _select(sample: DataFrame, least_z: float) -> list[tuple[bytes, int, float]]:
    """(key, step, log odds) of all features that speak for toxicity with that certainty."""

    def work():
        def each(batch):
            counts: dict[tuple[bytes, int], list[int]] = {}
            columns = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("label").to_pylist()
            for text, label in zip(*columns, strict=True):
                for feature in features_of(text):
                    counts.setdefault(feature, [0, 0])[label] += 1
            return {
                "key": [k for k, _ in counts],
                "step": [s for _, s in counts],
                "clean": [c[0] for c in counts.values()],
                "toxic": [c[1] for c in counts.values()],
            }

        return each

    texts_with_label = sample.select("text", F.col("label").cast("int").alias("label"))
    counted = by_batch(texts_with_label, work, "key binary, step int, clean bigint, toxic bigint")
    totals = sample.agg(F.count(F.when(F.col("label") == 0, 1)), F.count(F.when(F.col("label") == 1, 1))).first()
    summed = counted.groupBy("key", "step").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (totals[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (totals[0] + 1.0))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = (
        summed.withColumn("odds", odds)
        # What speaks against toxicity is only how much clean text there is, so a long text would
        # outweigh its insults.
        .filter(F.col("odds") >= least_z * error)
        .select("key", "step", "odds")
    )
    # As many as a bounded sample has such features; in a fixed order.
    return sorted((bytes(r["key"]), r["step"], r["odds"]) for r in best.toLocalIterator())


def ordinal_fit(
    rows: list[list[int]],
    grades: np.ndarray,
    n_features: int,
    ridge: float = 1.0,
    rounds: int = 400,
    rate: float = 0.05,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient descent on the cumulative-link likelihood (Adam steps)."""
    k = GRADES - 1
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.array([c for r in rows for c in r], np.int64)
    shared = np.bincount(grades, minlength=GRADES)[::-1].cumsum()[::-1][1:] / len(grades)
    start = np.log((1 - shared + 1e-3) / (shared + 1e-3))
    # Thresholds ascend: the first one, then logarithms of the gaps.
    value = np.concatenate([np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    first, second = np.zeros_like(value), np.zeros_like(value)
    for n in range(1, rounds + 1):
        gaps = np.exp(value[n_features + 1 :])
        thresholds = value[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(owner, value[column], len(rows))
        # P(grade >= 0) is 1, P(grade >= GRADES) is 0.
        at_least = np.zeros((len(rows), GRADES + 1))
        at_least[:, 0] = 1
        at_least[:, 1:GRADES] = 1 / (1 + np.exp(np.clip(thresholds - z[:, None], -500, 500)))
        i = np.arange(len(rows))
        a, b = at_least[i, grades], at_least[i, grades + 1]
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p  # d log p by z - threshold, above and below
        slope = da - db
        by_threshold = np.zeros(k)
        np.add.at(by_threshold, grades[grades > 0] - 1, -da[grades > 0])
        np.add.at(by_threshold, grades[grades < k], db[grades < k])
        gradient = np.concatenate(
            [
                np.bincount(column, slope[owner], n_features) - ridge * value[:n_features],
                [by_threshold.sum()],
                [by_threshold[j + 1 :].sum() * gaps[j] for j in range(k - 1)],
            ]
        )
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        value = value + rate * (first / (1 - 0.9**n)) / (np.sqrt(second / (1 - 0.99**n)) + 1e-8)
    gaps = np.exp(value[n_features + 1 :])
    return value[:n_features], value[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])


def fit(sample: DataFrame, least_z: float = 2.0) -> Model | None:
    sample = staged(sample, "toxicity-sample")
    chosen = _select(sample, least_z)
    if not chosen:
        return None
    features = {(key, s): n for n, (key, s, _) in enumerate(chosen)}
    strong = {n for n, (_, s, odds) in enumerate(chosen) if s == 0 and odds >= 2.0}

    def work():
        extract = Extractor(features)

        def each(batch):
            made = [extract(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            return {
                "doc_id": batch.column("doc_id"),
                "label": batch.column("label"),
                "features": [sorted(f) for f, _ in made],
                "words": [n for _, n in made],
            }

        return each

    ddl = "doc_id bigint, label int, features array<int>, words bigint"
    taken = by_batch(sample.select("doc_id", F.col("label").cast("int").alias("label"), "text"), work, ddl)
    rows = sorted(taken.collect(), key=lambda r: r["doc_id"])  # at most 2 * per_label
    labels = np.array([r["label"] for r in rows])
    if len(np.unique(labels)) < 2:
        return None
    # Grades of the toxic documents by how many of their words speak for toxicity.
    share = np.array([len(strong.intersection(r["features"])) / max(1, r["words"]) for r in rows])
    cuts = np.quantile(share[labels == 1], [g / (GRADES - 1) for g in range(1, GRADES - 1)])
    grades = np.where(labels == 1, 1 + np.searchsorted(cuts, share, side="left"), 0)
    weights, thresholds = ordinal_fit([r["features"] for r in rows], grades, len(features))
    return Model(features, weights, thresholds)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (P(grade >= 1)) and severity (expected grade) of every document."""

    def work():
        extract = Extractor(model.features) if model else None

        def each(batch):
            scores, severities = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist() if model else []:
                z = model.weights[extract(text)[0]].sum()
                at_least = 1 / (1 + np.exp(np.clip(model.thresholds - z, -500, 500)))
                scores.append(float(at_least[0]))
                severities.append(float(at_least.sum()))
            empty = [] if model else [0.0] * batch.num_rows
            return {"doc_id": batch.column("doc_id"), "score": scores or empty, "severity": severities or empty}

        return each

    return by_batch(texts(docs), work, "doc_id bigint, score double, severity double")


def classify(docs: DataFrame, labels: DataFrame, per_label: int = 1500, cut: float = 0.5) -> DataFrame:
    """The columns of query op10."""
    model = fit(labelled_sample(docs, labels, "toxic", per_label))
    return score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        "severity",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )
