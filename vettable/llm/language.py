"""Operator 10: language identification.

Features are the 1- to 3-character n-grams of the lowered whole text, hashed
into ``BUCKETS`` columns, weighted ``(1 + ln tf) * idf`` and scaled to length one.
The document frequencies behind ``idf`` cover all training documents (one
histogram per task, added up). A multinomial logistic regression is trained on
them with follow-the-regularised-leader (per-coordinate steps) and an
elastic-net penalty, which leaves most weights at exactly zero; softmax scores
are then calibrated with one temperature on training documents the regression
has not seen.

The regression is fitted on the driver on a bounded sample: about ``sample``
documents in all (default 6,000), shared evenly by the languages, whole texts.
Prediction is one pass without a shuffle; the model (``BUCKETS`` x languages) is
broadcast.

Defined results: null text and text without a letter give ``und`` with score 0;
with no training rows every text is ``und``; a single learned language is
predicted for all. Rows without ``lang`` are never trained on. Repeated rows are
predicted each. Columns of ``docs`` stay; columns with the names of the results
are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, map_arrow
from .sampling import held_out, per_class

BITS = 15
BUCKETS = 1 << BITS
SAMPLE = 6_000
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the character n-grams of a text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    a = c * np.uint32(2654435761)
    found = [a >> np.uint32(32 - BITS)]
    if len(c) > 1:
        two = (a[:-1] ^ (c[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
        found.append(two >> np.uint32(32 - BITS))
        if len(c) > 2:
            found.append(((two[:-1] + c[2:]) * np.uint32(668265263)) >> np.uint32(32 - BITS))
    counts = np.bincount(np.concatenate(found), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = grams(text)
    x = (1 + np.log(n)) * idf[at]
    return at, x / (np.sqrt(x @ x) or 1.0)


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


class Ftrl:
    """Follow-the-regularised-leader for a softmax over ``classes``, elastic-net penalty."""

    def __init__(self, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((BUCKETS, classes))
        self.n = np.zeros((BUCKETS, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max())
    return e / e.sum()


def best_temperature(margins: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, on a logarithmic grid."""
    def loss(t: float) -> float:
        m = margins / t
        m = m - m.max(axis=1, keepdims=True)
        return float((np.log(np.exp(m).sum(axis=1)) - m[np.arange(len(m)), labels]).mean())

    return min(np.geomspace(0.02, 20, 121).tolist(), key=loss)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray | None = None
    weights: np.ndarray | None = None
    temperature: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        if self.weights is None:
            return self.languages[0], 1.0
        at, x = features(text, self.idf)
        p = softmax(x @ self.weights[at] / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per bucket and documents in all, over every training row."""
    def count(batches):
        total, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for t in b.column("text").to_pylist():
                if has_letter(t):
                    total[grams(t)[0]] += 1
                    n += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int64()),
                                          pa.array(np.append(total[seen], n))], names=["g", "n"])

    rows = map_arrow(docs.select("text"), count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    n = 0
    for r in rows:
        if r["g"] < 0:
            n = r["n"]
        else:
            out[r["g"]] = r["n"]
    return out, n


def fit_language(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
                 sample: int = SAMPLE, epochs: int = 3, seed: int = 7) -> LanguageModel:
    """Fit on rows with a language outside the held-out fold."""
    train = (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
             .filter(F.col("lang").isNotNull() & ~held_out()))
    keys = train.select("doc_id", "lang")
    languages = sorted(r["lang"] for r in keys.select("lang").distinct().collect())
    if len(languages) < 2:
        return LanguageModel(languages)
    df, n = document_frequencies(train)
    idf = np.log((1 + n) / (1 + df)) + 1
    chosen, _ = per_class(train, "lang", "doc_id", max(50, sample // len(languages)))
    rows = [(r["text"], languages.index(r["lang"])) for r in chosen.collect() if has_letter(r["text"])]
    rows.sort()
    order = np.random.default_rng(seed).permutation(len(rows))
    cut = max(1, len(rows) * 4 // 5)
    model = Ftrl(len(languages))
    seen = [(features(rows[i][0], idf), rows[i][1]) for i in order[:cut]]
    for _ in range(epochs):
        for (at, x), y in seen:
            model.learn(at, x, y)
    w = model.weights()
    rest = [(features(rows[i][0], idf), rows[i][1]) for i in order[cut:]] or seen
    margins = np.array([x @ w[at] for (at, x), _ in rest])
    return LanguageModel(languages, idf, w, best_temperature(margins, np.array([y for _, y in rest])))


def predict_language(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batches):
        m = shared.value
        for b in batches:
            got = [m.predict(t) for t in b.column(text).to_pylist()]
            yield [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]

    return append_columns(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())],
                          make)
