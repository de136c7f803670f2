"""Operator 1: compression classifier for text quality.

Two zstandard dictionaries are built, one from good and one from bad labelled
texts. A text is cut into pieces of ``PIECE`` bytes (so the dictionary, not the
text's own past, explains each piece) and every piece of the whole text is
compressed with both. With the compressed sizes ``g`` and ``b`` the features are
the normalised difference ``(b - g) / (b + g)`` and the compressed share
``(b + g) / (2 * bytes)``; the share tells texts that repeat themselves, where
both sizes are tiny and their difference says little. A cubic logistic
calibration, fitted on labelled texts that are in neither dictionary and
weighted to the label frequencies of the corpus, gives the score.

Fitting uses a bounded sample (``sample`` rows of each label, default 2,000: half
build the dictionaries, half calibrate); label frequencies cover all training
rows. Scoring is one pass over the texts, without a shuffle; the model (two
dictionaries of ``DICTIONARY`` bytes and ten numbers) is broadcast.

Defined results: null and empty text score the corpus share of label 1;
documents without a label are scored like all others; labels other than 0 and 1
and labels of unknown documents are ignored; with one label only (or none)
every score is that share (0.5 without labels). Repeated rows are scored each.
Columns of ``docs`` stay; columns with the names of the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, raw_texts
from .sampling import held_out, per_class

PIECE = 1024
DICTIONARY = 64 << 10
LEVEL = 3
SAMPLE = 2_000


def pieces(raw: bytes) -> list[bytes]:
    return [raw[i:i + PIECE] for i in range(0, len(raw), PIECE)]


def build_dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; of very few texts, their own bytes."""
    import zstandard

    parts = [p for t in texts for p in pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(parts)[-DICTIONARY:]


class Compressors:
    """Both compressors of a worker."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.use = []
        for data in (good, bad):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            self.use.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False,
                                                     write_dict_id=False).compress)

    def features(self, raw: bytes) -> tuple[float, float]:
        good, bad = self.use
        parts = pieces(raw)
        g = sum(len(good(p)) for p in parts)
        b = sum(len(bad(p)) for p in parts)
        return (b - g) / (b + g), (b + g) / (2 * len(raw))


def _terms(x: np.ndarray) -> np.ndarray:
    d, c = x[:, 0], x[:, 1]
    return np.stack([np.ones(len(x)), d, c, d * c, c ** 2, d ** 2, c ** 3, d ** 3], axis=1)


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    base: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def score(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((features - self.mean) / self.scale, -4, 4)
        return 1 / (1 + np.exp(-np.clip(_terms(z) @ self.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Weighted ridge logistic regression by damped Newton steps."""
    def loss(beta):
        m = x @ beta
        return float(w @ (np.logaddexp(0, m) - y * m) + ridge / 2 * beta @ beta)

    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + ridge * beta
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), grad)
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return beta


def fit_quality(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id",
                label: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Fit on labelled rows outside the held-out fold."""
    marks = (labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y"))
             .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out()))
    chosen, counts = per_class(marks, "y", "doc_id", sample)
    total = sum(counts.values())
    base = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return QualityModel(b"", b"", base)
    # At most about 2 x sample narrow rows: a bounded broadcast.
    rows = (docs.select(F.col(doc_id).alias("doc_id"), F.encode(F.col(text), "UTF-8").alias("t"))
            .join(F.broadcast(chosen), "doc_id").filter("length(t) > 0")
            .orderBy(F.xxhash64("doc_id", "t")).collect())
    by = {y: [bytes(r["t"]) for r in rows if r["y"] == y] for y in (0, 1)}
    if min(len(v) for v in by.values()) < 2:
        return QualityModel(b"", b"", base)
    half = {y: v[:len(v) // 2] for y, v in by.items()}
    rest = {y: v[len(v) // 2:] for y, v in by.items()}
    model = QualityModel(build_dictionary(half[1]), build_dictionary(half[0]), base)
    c = Compressors(model.good, model.bad)
    x = np.array([c.features(t) for y in (1, 0) for t in rest[y]])
    y = np.array([1.0] * len(rest[1]) + [0.0] * len(rest[0]))
    w = np.where(y == 1, base / len(rest[1]), (1 - base) / len(rest[0]))
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = _logistic(_terms(np.clip((x - model.mean) / model.scale, -4, 4)), y, w)
    return model


def score_quality(docs: DataFrame, model: QualityModel, *, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` plus the probability ``out`` that the label is 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batches):
        m = shared.value
        c = Compressors(m.good, m.bad) if m.weights is not None else None
        for b in batches:
            scores = np.full(b.num_rows, m.base)
            if c is not None:
                raw = raw_texts(b, text)
                full = [i for i, t in enumerate(raw) if t]
                if full:
                    scores[full] = m.score(np.array([c.features(raw[i]) for i in full]))
            yield [pa.array(scores)]

    return append_columns(docs, [T.StructField(out, T.DoubleType())], make)
