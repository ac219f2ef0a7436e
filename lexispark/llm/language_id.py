"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams.

Training reads the folds it may: document frequencies come from every training
row; the weights are fitted on a bounded sample of labelled rows (at most about
``fit_rows`` a language) by follow-the-regularised-leader with elastic-net
penalties, and one temperature is then fitted on a second, disjoint sample.
Prediction reads nothing but the whole text.

Defined results: a null text, an empty text and a text without letters are
``und`` with score 0; of languages that are equally likely, the first by name
is predicted; repeated rows each get the same answer; an empty table
gives an empty result; without any labelled row every text is ``und``; other
columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import ngrams
from lexispark.llm.common import bounded_batches, fresh, share

UNDETERMINED = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Settings:
    bits: int = 14
    sizes: tuple[int, ...] = (1, 2, 3)
    fit_rows: int = 700
    calibration_rows: int = 250
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 1.0


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    settings: Settings

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for text in texts:
            got = grams(text, self.settings)
            if got is None or not self.languages:
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            at, values = weigh(got, self.idf)
            p = softmax((values @ self.weights[at] + self.bias) / self.temperature)
            k = int(p.argmax())
            names.append(self.languages[k])
            scores.append(float(p[k]))
        return names, scores


def grams(text: str | None, s: Settings) -> np.ndarray | None:
    """Counts of the text's n-grams over letters, runs of others being one space; None without letters."""
    if not text:
        return None
    bare = NOT_LETTERS.sub(" ", text.lower()).strip()
    return ngrams.counts(ngrams.code_points(f" {bare} "), s.bits, s.sizes) if any(map(str.isalpha, bare)) else None


def weigh(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = counts.nonzero()[0]
    values = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(values @ values)
    return at, values / norm if norm else values


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate FTRL-proximal for the softmax loss with L1 and L2 penalties."""
    d = 1 << s.bits
    z, n, bias, bias_n = np.zeros((d, classes)), np.zeros((d, classes)), np.zeros(classes), np.zeros(classes)

    def leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)
        return np.where(np.abs(z) <= s.l1, 0.0, w)

    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for k in order.permutation(len(rows)):
            at, values, label = rows[k]
            w = leader(z[at], n[at])
            p = softmax(values @ w + bias)
            p[label] -= 1
            g = values[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / s.alpha * w
            n[at] = grown
            bias_n += p * p
            bias -= s.alpha * p / (s.beta + np.sqrt(bias_n))
    return leader(z, n), bias


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()

    a, b, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, settings: Settings = Settings(), *, text: str = "text", label: str = "lang", key: str = "doc_id") -> LanguageModel:
    """Fit on the rows of docs (a training fold); rows without text letters or label teach nothing."""
    bounded_batches(docs)
    rows = docs.select(F.col(text).alias("text"), F.col(label).alias("lang"), F.col(key).alias("key")).where("lang is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(1 << settings.bits, np.int64), 0
        per: dict[str, int] = {}
        for batch in batches:
            for body, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if (got := grams(body, settings)) is not None:
                    seen += got > 0
                    total += 1
                    per[lang] = per.get(lang, 0) + 1
        at = seen.nonzero()[0]
        langs = sorted(per)
        yield pa.RecordBatch.from_pydict({
            "feature": pa.array([*at.tolist(), *[None] * len(langs)], pa.int32()),
            "lang": pa.array([*[None] * len(at), *langs], pa.string()),
            "n": pa.array([*seen[at].tolist(), *(per[x] for x in langs)], pa.int64()),
        })

    found = rows.select("text", "lang").mapInArrow(frequencies, "feature int, lang string, n long")
    found = found.groupBy("feature", "lang").agg(F.sum("n").alias("n")).collect()  # at most 2**bits features, and the languages
    per = {r.lang: r.n for r in found if r.lang is not None}
    languages, total = tuple(sorted(per)), sum(per.values())
    df = np.zeros(1 << settings.bits)
    for r in found:
        if r.feature is not None:
            df[r.feature] = r.n
    idf = np.log((1 + total) / (1 + df)) + 1
    empty = LanguageModel(languages, idf, np.zeros((1 << settings.bits, len(languages))), np.zeros(len(languages)), 1.0, settings)
    if not languages:
        return empty

    def sampled(seed: int, bound: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
        odds = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, bound / per[lang]))])
        u = share(F.col("key"), seed)

        def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.column("lang").to_pylist()
                out = [(lang, u, g, g.nonzero()[0]) for lang, u, g in zip(names, batch.column("u").to_pylist(), (grams(body, settings) for body in batch.column("text").to_pylist()), strict=True) if g is not None]
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([x[0] for x in out], pa.string()),
                    "u": pa.array([x[1] for x in out], pa.float64()),
                    "at": pa.array([x[3].astype("<i4").tobytes() for x in out], pa.binary()),
                    "n": pa.array([x[2][x[3]].astype("<i4").tobytes() for x in out], pa.binary()),
                })

        # Counts, not texts, are gathered.
        picked = rows.where(u < odds[F.col("lang")]).select("text", "lang", u.alias("u")).mapInArrow(sparse, "lang string, u double, at binary, n binary")
        got = []
        for r in picked.orderBy("u", "lang", "at", "n").limit(2 * bound * len(languages)).collect():
            counts = np.zeros(1 << settings.bits, np.int64)
            counts[np.frombuffer(r.at, "<i4")] = np.frombuffer(r.n, "<i4")
            got.append((*weigh(counts, idf), languages.index(r.lang)))
        return got

    fit, check = sampled(11, settings.fit_rows), sampled(12, settings.calibration_rows)
    weights, bias = ftrl(fit, len(languages), settings)
    logits = np.array([v @ weights[at] + bias for at, v, _ in check]).reshape(len(check), len(languages))
    return LanguageModel(languages, idf, weights, bias, temperature(logits, np.array([k for *_, k in check], int)), settings)


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """docs' columns, then lang_pred and score (under fresh names if docs has those already)."""
    bounded_batches(docs)
    name, score, got = fresh(docs, "lang_pred", "score", "language")
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits rows a language: fixed size

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        names, scores = shipped.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    out = docs.withColumn(got, predict(F.col(text)))
    return out.select(*docs.columns, F.col(f"{got}.lang_pred").alias(name), F.col(f"{got}.score").alias(score))
