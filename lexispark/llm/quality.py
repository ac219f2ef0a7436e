"""Quality classifier by positive-unlabelled learning.

A linear model on hashed character pairs and a few text statistics minimises
the non-negative unbiased risk of trusted positives (rows labelled 1) against
unlabelled texts (rows of any or no label, their labels unread), with a class
prior estimated from the two.  Labelled rows apart from both then calibrate
the model's value to a probability.

Only the fit is on samples, of at most about ``positive_rows``,
``unlabelled_rows`` and ``calibration_rows`` rows, drawn by a hash of the id;
the ids are the only thing shuffled or broadcast for that, and their number is
bounded.  Scores read nothing but the whole text.

Defined results: null and empty texts have the features of an empty text and
are scored like any other; conflicting labels of a row count as 0; repeated
rows each get the same score; without positives or without documents to fit
on, every score is 0.5; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm import ngrams
from lexispark.llm.common import bounded_batches, fresh, give_back, share, slices

STATISTICS = 20


@dataclass(frozen=True)
class Settings:
    bits: int = 9
    #: What a character pair's standard deviation counts against a statistic's: pairs are many and would drown the statistics of few rows.
    pairs: float = 0.1
    positive_rows: int = 4000
    unlabelled_rows: int = 6000
    calibration_rows: int = 2000
    epochs: int = 40
    batch: int = 256
    rate: float = 0.02
    decay: float = 1e-4


def statistics(text: str) -> list[float]:
    """Length, repetition, case and marks of a text, each of the order of one."""
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    digits = sum(map(str.isdigit, text))
    marks = len(text) - letters - digits - sum(map(str.isspace, text))
    ended = sum(not (w[-1].isalnum() or w[-1] in ".,;:?") for w in words)
    bare = sum(not any(map(str.isalnum, w)) for w in words)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    size = max(1, len(text))
    return [
        np.log1p(len(words)) / 5,
        len("".join(words)) / n / 8,
        len(set(words)) / n,
        repeats / n,
        letters / size,
        upper / max(1, letters),
        digits / size,
        marks / size,
        ended / n,
        bare / n,
        sum(w.isupper() for w in words) / n,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(lines)) / 3,
        max(map(len, words), default=0) / 40,
        text.count("!") / n,
        min(1.0, n / 8),
        *(min(1.0, 5 * x) for x in (repeats / n, ended / n, bare / n, 0.5 * upper / max(1, letters))),
    ]


def features(text: str | None, s: Settings) -> np.ndarray:
    text = text or ""
    grams = np.sqrt(ngrams.counts(ngrams.code_points(text), s.bits, (2,)))
    size = np.sqrt(grams @ grams)
    return np.concatenate((statistics(text), grams / size if size else grams))


@dataclass(frozen=True)
class QualityModel:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    prior: float
    settings: Settings

    def values(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.centre) / self.scale, -8, 8) @ self.weights + self.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        values = [np.zeros(0)]
        for at in range(0, len(texts), 500):  # few rows of features at a time
            values.append(self.values(np.array([features(x, self.settings) for x in texts[at : at + 500]])))
        return sigmoid(self.slope * np.concatenate(values) + self.shift)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def non_negative_risk(p: np.ndarray, u: np.ndarray, prior: float, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative unbiased risk with the sigmoid loss, by Adam.

    The risk is prior * loss of positives as such, plus the loss of unlabelled
    rows as negatives less prior times that of positives; where the latter part
    falls under zero in a batch, the step goes up its gradient instead.
    """
    rng = np.random.default_rng(3)
    w, m, v, step = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1), 0
    p, u = np.hstack((p, np.ones((len(p), 1)))), np.hstack((u, np.ones((len(u), 1))))
    for _ in range(s.epochs):
        order = rng.permutation(len(u))
        for at in range(0, len(u), s.batch):
            bu, bp = u[order[at : at + s.batch]], p[rng.integers(0, len(p), s.batch)]
            lp, lu = sigmoid(bp @ w), sigmoid(bu @ w)  # the loss as a negative; as a positive it is 1 - this
            gp, gu = bp.T @ (lp * (1 - lp)) / len(bp), bu.T @ (lu * (1 - lu)) / len(bu)
            negative = lu.mean() - prior * lp.mean()
            g = -prior * gp + gu - prior * gp if negative >= 0 else -(gu - prior * gp)
            g[:-1] += s.decay * w[:-1]
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, steps: int, penalty: float, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression by Newton's method."""
    x, w = np.hstack((x, np.ones((len(x), 1)))), np.zeros(x.shape[1] + 1)
    k = np.ones(len(x)) if weight is None else weight
    for _ in range(steps):
        q = sigmoid(x @ w)
        h = (x * (k * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + penalty * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (k * (q - y)) + penalty * w)
    return w


def estimated_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of the two tails of a
    positive-against-unlabelled classifier on rows it didn't see, over thresholds that
    leave enough positives to trust the ratio."""
    half_p, half_u = len(p) // 2, len(u) // 2
    x, y = np.vstack((p[:half_p], u[:half_u])), np.repeat((1.0, 0.0), (half_p, half_u))
    w = logistic(x, y, 12, 10.0)
    vp, vu = np.sort(p[half_p:] @ w[:-1]), np.sort(u[half_u:] @ w[:-1])
    cuts = np.quantile(vp, np.linspace(0.02, 0.9, 60))
    tail_p, tail_u = 1 - np.searchsorted(vp, cuts) / len(vp), 1 - np.searchsorted(vu, cuts) / len(vu)
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(vp)) + 1 / np.sqrt(len(vu)))
    best = int(((tail_u + slack) / tail_p).argmin())
    return float(np.clip(tail_u[best] / tail_p[best], 0.05, 0.98))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), *, text: str = "text", key: str = "doc_id", label: str = "quality") -> QualityModel:
    """Fit on docs and labels (both a training fold)."""
    s = settings
    bounded_batches(docs)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null")
    known = labels.select(F.col(key).alias("key"), F.col(label).alias("y")).where("key is not null and y in (0, 1)").groupBy("key").agg(F.min("y").cast("double").alias("y"))
    per = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = rows.agg(F.count("key")).first()[0]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [features(x, s).astype("<f2").tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("at"), batch.column("key"), pa.array(out, pa.binary())], ["y", "at", "key", "x"])

    def gathered(some: DataFrame, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """Features, not texts, in an order of the keys' own, so that a fit doesn't depend on how the rows lie."""
        got = some.select("y", share(F.col("key"), 9).alias("at"), F.col("key").cast("string").alias("key"), "text").mapInArrow(vectors, "y double, at double, key string, x binary").limit(2 * bound).collect()
        got.sort(key=lambda r: (r.at, r.key, bytes(r.x)))
        return np.array([np.frombuffer(r.x, "<f2") for r in got], np.float64).reshape(len(got), STATISTICS + (1 << s.bits)), np.array([r.y for r in got])

    def drawn(wanted: Column, bound: int) -> tuple[np.ndarray, np.ndarray]:
        ids = known.where(wanted).orderBy(share(F.col("key"), 2), "key").limit(2 * bound)
        return gathered(rows.join(F.broadcast(ids), "key"), 2 * bound)

    odds = {name: min(1.0, bound / max(1, n)) for name, bound, n in (("p", s.positive_rows, per.get(1.0, 0)), ("c", s.calibration_rows, sum(per.values())), ("u", s.unlabelled_rows, total))}
    u_of = share(F.col("key"), 1)
    held = 0.25 if odds["c"] > 0.25 else odds["c"]  # of the labelled rows, for calibration alone
    p, _ = drawn((F.col("y") == 1) & (u_of >= held) & (u_of < held + (1 - held) * odds["p"]), s.positive_rows)
    c, y = drawn(u_of < held, s.calibration_rows)
    u, _ = gathered(rows.where(share(F.col("key"), 4) < odds["u"]).select(F.lit(None).cast("double").alias("y"), "key", "text"), s.unlabelled_rows)
    width = STATISTICS + (1 << s.bits)
    if len(p) < 10 or len(u) < 10:
        return QualityModel(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0, 0.0, 0.5, s)
    centre, scale = u.mean(axis=0), (u.std(axis=0) + 0.02) / np.repeat((1.0, s.pairs), (STATISTICS, 1 << s.bits))
    p, u = np.clip((p - centre) / scale, -8, 8), np.clip((u - centre) / scale, -8, 8)
    order = np.random.default_rng(8)
    p, u = p[order.permutation(len(p))], u[order.permutation(len(u))]
    prior = estimated_prior(p, u)
    weights, bias = non_negative_risk(p, u, prior, s)
    model = QualityModel(centre, scale, weights, bias, 1.0, 0.0, prior, s)
    if len(set(y)) == 2:
        slope, shift = logistic(model.values(c)[:, None], y, 25, 0.05)
        if slope > 0:
            return QualityModel(centre, scale, weights, bias, float(slope), float(shift), prior, s)
    return model


def scored(docs: DataFrame, model: QualityModel, *, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a last column of scores (under a fresh name if docs has that one)."""
    bounded_batches(docs)
    (name,) = fresh(docs, name)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = pa.array(shipped.value.scores(texts.to_pylist()), pa.float64())
        give_back()
        return out

    return docs.withColumn(name, score(F.col(text)))


def accepted(docs: DataFrame, model: QualityModel, least: float, *, text: str = "text") -> DataFrame:
    """The rows of docs that score least or more, with docs' columns."""
    out = scored(docs, model, text=text)
    return out.where(F.col(out.columns[-1]) >= least).select(*docs.columns)
