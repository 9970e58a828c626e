"""Toxicity severity by cumulative-link ordinal regression (operator 5).

Features of a text are its distinct words (lower-cased runs of word characters) and their
prefixes of 4, 5 and 6 characters, hashed to 64 bits. A feature is selected if its document frequency among
toxic training texts is ``z`` standard deviations above or below the expected one. So the model is sparse
and a long clean text has few features.

Severity grades 0 < 1 < ... < K-1 share one weight vector: P(grade >= k) = sigmoid(w x - t_k) with ordered
thresholds t_1 < t_2 < ... (kept ordered by positive steps). The expected severity is the sum of
these probabilities. ``fit`` takes any number of grades. The given labels are 0 and 1; ``graded`` makes
three of them: a toxic text is grade 2 if more of its distinct words have selected features than in the
median toxic text, else 1.

The model is trained on a bounded sample: at most ``toxic_sample`` and ``clean_sample`` labelled
texts, those with the least hash of doc_id. Spark picks them, counts their features and selects; the driver
gets selected features only. Scoring is one pass over all rows without a shuffle.

A null or empty text has no features and severity near 0. Null labels, labels other than 0 and 1 and labels
of unknown documents teach nothing; a document with several labels takes the largest. Without labels of both
kinds nothing is learned and every severity is 0. Repeated rows are scored each on their own; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import Scratch, map_rows

WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6)


def word_features(word: str) -> list[int]:
    """Signed 64-bit hashes of the word and its prefixes."""
    own = ["w " + word, *(f"{n} {word[:n]}" for n in PREFIXES if len(word) >= n)]
    return [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in own]


class Features:
    """Feature hashes of texts, with a bounded memo by word.

    With ``chosen``, only the numbers of chosen features are given, and words that do not begin like a word
    of the training sample that has one (``starts``) are not hashed at all.
    """

    def __init__(self, chosen: dict[int, int] | None = None, starts: frozenset[str] | None = None, most: int = 100_000):
        self.chosen, self.starts, self.most, self.memo = chosen, starts, most, {}

    def word(self, word: str) -> list[int]:
        if len(self.memo) >= self.most:
            self.memo.clear()
        own = word_features(word)
        if self.chosen is not None:
            own = [self.chosen[f] for f in own if f in self.chosen]
        self.memo[word] = own
        return own

    def of(self, words: set[str]) -> tuple[set[int], int]:
        """(features, words that have any)."""
        if self.starts is not None:
            words = [w for w in words if w[:4] in self.starts]
        out, having = set(), 0
        for w in words:
            own = self.memo.get(w)
            if own is None:
                own = self.word(w)
            if own:
                out.update(own)
                having += 1
        return out, having


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


class CumulativeLink:
    """Shared weights and ordered thresholds of ``grades`` severity grades."""

    def __init__(self, n_features: int, grades: int):
        self.weights = np.zeros(n_features)
        self.first, self.steps = 0.0, np.zeros(grades - 2)

    @property
    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate([[0.0], np.cumsum(np.exp(self.steps))])

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... as columns."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -500, 500)))

    def fit(self, rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, ridge: float, rounds: int, rate: float = 0.1):
        """Full-batch Adam on the mean negative log likelihood; (rows, columns) are the ones of a 0/1 matrix."""
        n, d, k = len(grades), len(self.weights), len(self.steps) + 2
        moment, square = np.zeros(d + k - 1), np.zeros(d + k - 1)
        for r in range(1, rounds + 1):
            score = np.bincount(rows, self.weights[columns], n)
            p = np.column_stack([np.ones(n), self.exceed(score), np.zeros(n)])
            mass = np.maximum(p[np.arange(n), grades] - p[np.arange(n), grades + 1], 1e-12)
            slope = p * (1 - p)  # d p_k / d score
            d_score = (slope[np.arange(n), grades] - slope[np.arange(n), grades + 1]) / mass
            d_threshold = np.zeros((n, k - 1))  # d log mass / d t_k
            for j in range(1, k):
                d_threshold[:, j - 1] = ((grades == j - 1) * 1.0 - (grades == j)) * slope[:, j] / mass
            g_t = -d_threshold.sum(axis=0) / n
            g_steps = np.array([g_t[j + 1:].sum() * np.exp(self.steps[j]) for j in range(k - 2)])
            gradient = np.concatenate([
                -np.bincount(columns, d_score[rows], d) / n + ridge * self.weights, [g_t.sum()], g_steps])
            moment = 0.9 * moment + 0.1 * gradient
            square = 0.999 * square + 0.001 * gradient ** 2
            step = rate * (moment / (1 - 0.9 ** r)) / (np.sqrt(square / (1 - 0.999 ** r)) + 1e-8)
            self.weights -= step[:d]
            self.first -= step[d]
            self.steps -= step[d + 1:]
        return self


def training_texts(docs: DataFrame, labels: DataFrame, label: str, sample: dict[int, int]) -> DataFrame:
    """(label, text) of at most ``sample[k]`` documents of each label k."""
    own = (labels.where(F.col(label).isin(*sample) & F.col("doc_id").isNotNull())
           .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")))
    taken = [own.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in sample.items()]
    ids = taken[0]
    for t in taken[1:]:
        ids = ids.union(t)
    # the ids are bounded by the sample sizes
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("label", "text")


def frequencies(rows: DataFrame) -> DataFrame:
    """(feature, n, n_toxic): in how many training texts a feature is."""

    def run(batches):
        features = Features()
        for batch in batches:
            own, toxic = [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                found = np.fromiter(features.of(words(text))[0], np.int64)
                own.append(found)
                toxic.append(np.full(len(found), label, np.int64))
            if not own:
                continue
            each, place = np.unique(np.concatenate(own), return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(each), pa.array(np.bincount(place, minlength=len(each))),
                 pa.array(np.bincount(place, np.concatenate(toxic), len(each)).astype(np.int64))],
                ["feature", "n", "n_toxic"])

    return (map_rows(rows, run, "feature long, n long, n_toxic long")
            .groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic")))


def chosen_rows(rows: DataFrame, chosen: dict[int, int]) -> DataFrame:
    """(label, features, having, starts): chosen features of each text, and how the words begin that have any."""

    def run(batches):
        features = Features(chosen)
        for batch in batches:
            sets = [words(t) for t in batch.column("text").to_pylist()]
            found = [features.of(s) for s in sets]
            starts = [sorted({w[:4] for w in s if features.memo.get(w) or features.word(w)}) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([sorted(f) for f, _ in found], pa.list_(pa.int32())),
                 pa.array([h for _, h in found], pa.int64()), pa.array(starts, pa.list_(pa.string()))],
                ["label", "features", "having", "starts"])

    return map_rows(rows, run, "label int, features array<int>, having long, starts array<string>")


def graded(label: np.ndarray, having: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2 from a 0/1 label and the number of words with chosen features."""
    middle = np.median(having[label == 1])
    return label + ((label == 1) & (having > middle))


class Severity:
    """The fitted model as it is sent to the tasks."""

    def __init__(self, chosen: dict[int, int], starts: frozenset[str], model: CumulativeLink | None):
        self.chosen, self.starts, self.model = chosen, starts, model

    def features(self) -> Features:
        return Features(self.chosen, self.starts)

    def of(self, features: Features, texts: list[str | None]) -> np.ndarray:
        """P(grade >= k), a row per text."""
        if self.model is None:
            return np.zeros((len(texts), 1))
        w = self.model.weights
        return self.model.exceed(np.array([sum(w[f] for f in sorted(features.of(words(t))[0])) for t in texts], float))


def deviations(n: int, full: int) -> float:
    """8 for a full sample; down to 4.5, the noise of some 100,000 features, for small ones, where nothing reaches 8."""
    return min(8.0, max(4.5, 8.0 * (n / full) ** (1 / 6)))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", toxic_sample: int = 8000,
          clean_sample: int = 16000, z: float | None = None, ridge: float = 1e-6, rounds: int = 600) -> Severity:
    """Fit the model on a bounded sample of labelled documents.

    A feature is chosen if its share of toxic texts is ``z`` deviations off; by default ``deviations`` of the sample's size.
    Without any chosen feature there is no model, and nothing is rejected.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.put(training_texts(docs, labels, label, {0: clean_sample, 1: toxic_sample}))
    sizes = dict(rows.groupBy("label").agg(F.count("*")).collect())
    n, toxic = sum(sizes.values()), sizes.get(1, 0)
    if not toxic or toxic == n:
        return Severity({}, frozenset(), None)
    p = toxic / n
    deviation = (F.col("n_toxic") - p * F.col("n")) / F.sqrt(p * (1 - p) * F.col("n"))
    z = deviations(n, toxic_sample + clean_sample) if z is None else z
    picked = frequencies(rows).where(F.abs(deviation) >= z).select("feature").toArrow().column("feature").to_pylist()
    if not picked:
        return Severity({}, frozenset(), None)
    chosen = {f: i for i, f in enumerate(sorted(picked))}
    got = chosen_rows(rows, chosen).toArrow()
    rows_ = sorted(zip(got.column("label").to_pylist(), got.column("features").to_pylist(), got.column("having").to_pylist()))
    starts = frozenset(s for own in got.column("starts").to_pylist() for s in own)
    label_ = np.array([r[0] for r in rows_])
    grades = graded(label_, np.array([r[2] for r in rows_]))
    at = np.repeat(np.arange(len(rows_)), [len(r[1]) for r in rows_])
    columns = np.array([f for r in rows_ for f in r[1]], np.int64)
    return Severity(chosen, starts, CumulativeLink(len(chosen), 3).fit(at, columns, grades, ridge, rounds))


def score(docs: DataFrame, model: Severity, reject: float = 0.5) -> DataFrame:
    """doc_id, severity, p_toxic, grade, rejected of every row; grade is the most likely one."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = sent.value
        features = own.features()
        for batch in batches:
            p = own.of(features, batch.column("text").to_pylist())
            mass = -np.diff(np.column_stack([np.ones(len(p)), p, np.zeros(len(p))]), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p.sum(axis=1)), pa.array(p[:, 0]),
                 pa.array(mass.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0] >= reject)],
                ["doc_id", "severity", "p_toxic", "grade", "rejected"])

    return map_rows(docs.select("doc_id", "text"), run,
                    f"doc_id {kind}, severity double, p_toxic double, grade int, rejected boolean")


def keep_clean(docs: DataFrame, model: Severity, reject: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are not rejected, columns unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        features = own.features()
        for texts in parts:
            yield pd.Series(own.of(features, texts.tolist())[:, 0] < reject)

    return docs.where(F.pandas_udf(clean, "boolean")(F.col("text")))
