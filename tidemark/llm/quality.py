"""Quality classifier by positive-unlabelled learning with a non-negative risk.

Trusted positives and unlabelled web text give an unbiased estimate of the risk of a linear score g on all text,

    prior * E_positive[loss(g)] + max(0, E_unlabelled[loss(-g)] - prior * E_positive[loss(-g)]),

whose second term, the risk on bad text, is kept from going negative: where a batch drives it below zero, the step is taken
against it. The loss is logistic, so that the logistic function of g estimates the probability of good text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import small_side, stored

#: Frequencies of hashed byte pairs, besides the named features.
PAIRS = 256
NAMED = (
    "log_chars", "upper", "digit", "space", "line", "mark", "symbol", "bang", "bar", "wide", "word_length",
    "distinct", "top_word", "repeated", "line_copies", "log_words",
)
_KIND = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:'\"()?-", b"#$%&*@^~<>{}[]=+_\\/`", b"!", b"|"), 1):
    _KIND[np.frombuffer(_chars, np.uint8)] = _i
_KIND[128:] = 9


def features(text: str) -> np.ndarray:
    """Shape of a whole text: shares of character kinds, repetition of words and lines, and byte pairs."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    out = np.zeros(len(NAMED) + PAIRS, np.float32)
    n = len(data)
    if not n:
        return out
    kinds = np.bincount(_KIND[data], minlength=10)
    words = text.split()
    w = max(1, len(words))
    top = Counter(words).most_common(1)[0][1] if words else 0
    lines = text.split("\n")
    out[: len(NAMED)] = (
        np.log1p(n), *(kinds[1:10] / n), min(50.0, n / w) / 10, len(set(words)) / w / (1 if w < 50 else 50 ** 0.15 / w ** 0.15),
        top / w, sum(map(eq, words, words[1:])) / w, 1 - len(set(lines)) / len(lines), np.log1p(len(words)),
    )
    pairs = (data[:-1].astype(np.int64) * 37 + data[1:]) % PAIRS
    out[len(NAMED) :] = np.sqrt(np.bincount(pairs, minlength=PAIRS) / max(1, n - 1))
    return out


class Model(NamedTuple):
    """Score of a text: logistic((features - mean) / scale . weights + bias)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        g = (rows - self.mean) / self.scale @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def prior_from_scores(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The largest share of positives that unlabelled scores allow: the least ratio of the two upper tails.

    Tails of fewer than 5 % of the positives are too noisy to count.
    """
    cuts = np.quantile(positive, np.linspace(0.0, 0.95, 96))
    tails = [(np.mean(unlabelled >= c), np.mean(positive >= c)) for c in cuts]
    return float(np.clip(min(u / p for u, p in tails if p > 0), 0.01, 0.99))


def risk_step(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """Risks of weights w (the last is the bias) on positives p and unlabelled u: prior * E_p[log(1 + exp(-g))], and that on bad
    text, E_u[log(1 + exp(g))] - prior * E_p[log(1 + exp(g))]; and the gradient to follow: of their sum, or, where the second is
    negative, of that risk with the opposite sign."""
    gp, gu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
    good_risk = prior * np.logaddexp(0, -gp).mean()
    bad_risk = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    sign = 1.0 if bad_risk >= 0 else -1.0
    dp, du = -sign * prior * _sigmoid(gp) / len(p), sign * _sigmoid(gu) / len(u)
    if sign > 0:
        dp = dp - prior * (1 - _sigmoid(gp)) / len(p)
    return good_risk, bad_risk, np.append(dp @ p + du @ u, dp.sum() + du.sum())


def _parts(x: np.ndarray, rows: int = 1024) -> Iterator[np.ndarray]:
    """x in parts of double precision: the driver never holds it whole in that width."""
    return (x[i : i + rows].astype(np.float64) for i in range(0, len(x), rows))


def _moments(sides: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each column over all rows of both sides."""
    n = sum(map(len, sides))
    mean = sum(part.sum(axis=0) for x in sides for part in _parts(x)) / n
    return mean, np.sqrt(sum(((part - mean) ** 2).sum(axis=0) for x in sides for part in _parts(x)) / n)


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, np.float32)
    for i, part in enumerate(_parts(x)):
        out[i * 1024 : i * 1024 + len(part)] = (part - mean) / scale
    return out


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 60, rate: float = 0.02, decay: float = 1e-4) -> Model:
    """Adam steps on batches of both kinds of rows. The same rows in the same order give the same model."""
    mean, scale = _moments([positive, unlabelled])
    scale += 1e-3
    xp, xu = (_standard(x, mean, scale) for x in (positive, unlabelled))
    random = np.random.default_rng(7)
    w = np.zeros(xp.shape[1] + 1)
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    batches = max(1, len(xu) // 1024)
    for epoch in range(epochs):
        parts = zip(np.array_split(random.permutation(len(xp)), batches), np.array_split(random.permutation(len(xu)), batches))
        for p_rows, u_rows in parts:
            p, u = xp[p_rows].astype(np.float64), xu[u_rows].astype(np.float64)
            if not len(p) or not len(u):
                continue
            _, _, grad = risk_step(w, p, u, prior)
            grad[:-1] += decay * w[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            step = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def train(docs: DataFrame, labels: DataFrame, sample: int = 24_000, prior: float | None = None) -> Model:
    """A model from documents and labels (doc_id, quality).

    sample bounds the training rows: half of it the positives, documents labelled 1, and half of it unlabelled text, documents
    without a label. Of more on one side, those whose id hashes into this side's share are taken; of several rows of one id only
    one is, that with the least features, so that the bound is one of rows. Without a given prior it is
    the share of 1 among all labelled documents if there are labels of both kinds; else it comes from the scores of a first
    model (prior 0.5). Of several labels of one document the largest counts. Without positives or unlabelled text every score
    is the prior (0.5); if there are some but none was sampled, a ValueError says so.
    """
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = stored(docs.filter(F.col("doc_id").isNotNull()).select("doc_id").join(marks, "doc_id", "left"))
    good, open_ = F.col("quality") == 1, F.col("quality").isNull()
    sides = F.count_if(good), F.count_if(open_), F.count_if(F.col("quality") == 0), F.count("quality")
    n_good, n_open, n_bad, n_labelled = ids.agg(*(c.alias(f"n{i}") for i, c in enumerate(sides))).first()
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    shares = (min(1.0, sample / 2 / max(1, n)) for n in (n_good, n_open))
    chosen = ids.filter(F.when(good, place < next(shares)).when(open_, place < next(shares))).distinct()
    rows = docs.select("doc_id", "text").join(small_side(chosen, min(sample, n_good + n_open)), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [features(t.as_py() or "").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat, pa.binary())], names=["doc_id", "features"])

    one = rows.mapInArrow(run, "doc_id long, features binary").groupBy("doc_id").agg(F.min("features").alias("features"))
    found = one.join(chosen, "doc_id").toArrow()
    order = pc.sort_indices(found, [("doc_id", "ascending"), ("features", "ascending")]).to_numpy()
    width = len(NAMED) + PAIRS
    quality = found["quality"].cast(pa.float64()).to_pandas().to_numpy()[order]

    def side(places: np.ndarray) -> np.ndarray:
        x = np.empty((len(places), width), np.float32)
        for row, i in zip(x, places.tolist()):
            row[:] = np.frombuffer(found["features"][i].as_buffer(), np.float32)
        return x

    positive, unlabelled = side(order[quality == 1]), side(order[np.isnan(quality)])
    del found  # the driver's memory is scarce
    pa.default_memory_pool().release_unused()
    if n_good and not len(positive) or n_open and not len(unlabelled):
        raise ValueError(f"none sampled of {n_good} documents labelled 1 or of {n_open} without a label")
    if not n_good or not n_open:
        p = 0.5 if prior is None else prior
        return Model(np.zeros(width), np.ones(width), np.zeros(width), float(np.log(p / (1 - p))), p)
    if prior is None and n_bad:
        prior = float(np.clip(n_good / n_labelled, 0.01, 0.99))
    elif prior is None:
        first = fit(positive, unlabelled, 0.5, epochs=20)
        prior = prior_from_scores(*(np.concatenate([first.scores(part) for part in _parts(x)]) for x in (positive, unlabelled)))
    return fit(positive, unlabelled, prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns as they are in a struct `row`, with doc_id and score (0 to 1). A null text is scored as an empty one."""
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            out = [sent.value.scores(np.stack([features(t.as_py() or "") for t in texts[i : i + 256]])) for i in range(0, len(texts), 256)]
            scores = pa.array(np.concatenate(out) if out else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, _SCORE])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(_SCORE, T.DoubleType())])).select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col(_SCORE).alias("score")
    )


_SCORE = "__quality_score"
