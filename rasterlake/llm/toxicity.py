"""Toxicity by a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios.

Every n-gram of a lower-cased text is hashed to 64 bits. A feature is an n-gram at a level: that it occurs at all, or at
least so often for the length of the text. On the labelled sample, those whose shares among toxic and other texts differ
clearly are kept; each is scaled by its log-count ratio, and logistic regression over the scaled features gives the
weights. Scoring looks up every n-gram of a whole text in a table of the kept ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import bounded_batches, held_out, lean, table
from rasterlake.llm.labelled import labelled_texts

#: Lengths of n-grams; bounds of the labelled sample (rows, characters in all) and of the number of features.
LENGTHS, MOST_LABELLED, MOST_CHARS, MOST_FEATURES = (4, 5, 6, 7), 4000, 48_000_000, 20_000
#: Levels: occurring, and occurring at least once per so many characters.
PER_CHARS = (1600, 400)
LEVELS = 1 + len(PER_CHARS)
#: A feature's least number of labelled texts, and least difference of shares in standard errors.
LEAST_TEXTS, LEAST_Z = 4, 4.0
#: Characters hashed at once; longer texts are hashed piece by piece, overlapping by the longest n-gram.
PIECE = 200_000
#: The share of toxic texts that the fit is weighted to, and the score from which a text is called toxic.
TOXIC_WEIGHT, THRESHOLD = 0.4, 0.5

_P, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of a text, lower-cased and with a blank at either end, array by array."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes[(codes >= 9) & (codes <= 13)] = 32
    for start in range(0, len(codes), PIECE):
        c = codes[start : start + PIECE + max(LENGTHS) - 1]
        h = c
        for n in range(2, max(LENGTHS) + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * _P + c[n - 1 :]
            if n in LENGTHS:
                own = h[: PIECE if start + PIECE < len(codes) else None]
                mixed = (own ^ (own >> np.uint64(31))) * _MIX
                yield mixed ^ (mixed >> np.uint64(29)) ^ np.uint64(n)


@dataclass
class Model:
    """Sorted hashes of n-grams, the weights (scale times coefficient) of their levels, and the intercept."""

    hashes: np.ndarray
    weights: np.ndarray
    intercept: float

    def __post_init__(self) -> None:
        bits = 20
        self.shift = np.uint64(64 - bits)
        self.slot = np.full(1 << bits, -1, np.int32)
        self.more = {}
        for i, (h, s) in enumerate(zip(self.hashes.tolist(), (self.hashes >> self.shift).tolist())):
            if self.slot[s] < 0:
                self.slot[s] = i
            else:
                self.more[h] = i
        self.late = np.array(sorted(self.more), np.uint64)

    def found(self, text: str) -> np.ndarray:
        """Features that the text has, each once: index of the n-gram times LEVELS, plus the level."""
        out = [np.zeros(0, np.int64)]
        for g in grams(text):
            i = self.slot[(g >> self.shift).astype(np.int64)]
            hit = np.flatnonzero(i >= 0)
            i, g = i[hit], g[hit]
            same = self.hashes[i] == g
            out.append(i[same])
            rest = g[~same]
            if len(rest) and len(self.late):
                at = np.minimum(np.searchsorted(self.late, rest), len(self.late) - 1)
                out.append(np.array([self.more[h] for h in rest[self.late[at] == rest].tolist()], np.int64))
        return levels(*np.unique(np.concatenate(out), return_counts=True), len(text))

    def score(self, text: str | None) -> float:
        z = self.intercept + (float(self.weights[self.found(text)].sum()) if text else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def levels(index: np.ndarray, count: np.ndarray, chars: int) -> np.ndarray:
    at = index.astype(np.int64) * LEVELS
    return np.concatenate([at, *(at[count * per >= chars] + k for k, per in enumerate(PER_CHARS, 1))])


def _own(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *grams(text)]), return_counts=True)


def _common(texts: list[str], least: int) -> np.ndarray:
    """N-grams of at least `least` of the texts: those with a shared counter below it are left out first."""
    counter = np.zeros(1 << 24, np.uint16)
    for t in texts:
        counter[np.unique(_own(t)[0] >> np.uint64(40)).astype(np.int64)] += 1
    u, df = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for start in range(0, len(texts), 100):
        more = [g[counter[(g >> np.uint64(40)).astype(np.int64)] >= least] for g in (_own(t)[0] for t in texts[start : start + 100])]
        both, where = np.unique(np.concatenate([u, *more]), return_inverse=True)
        u, df = both, np.bincount(where, np.concatenate([df, np.ones(len(where) - len(u))]), minlength=len(both))
    return u[df >= least]


def fit(sample: list[tuple[str, int]], rounds: int = 600, l2: float = 1e-4) -> Model:
    """The model of a sample. Without both labels in it, every score is 0 (or 1, if all are toxic)."""
    y = np.array([v for _, v in sample], np.float64)
    if len(set(y)) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 40.0 if len(y) and y[0] else -40.0)
    n = np.array([(y == v).sum() for v in (0, 1)], np.float64)
    every = _common([t for t, v in sample if v], LEAST_TEXTS)  # an n-gram of fewer toxic texts can't count for toxicity
    df = np.zeros((2, len(every), LEVELS))
    for text, v in sample:
        g, c = _own(text)
        at = np.minimum(np.searchsorted(every, g), max(len(every) - 1, 0))
        same = every[at] == g if len(every) else np.zeros(len(g), bool)
        at, c = at[same], c[same]
        df[v, at] += np.stack([c > 0, *(c * per >= len(text) for per in PER_CHARS)], 1)
    share = (df + 1) / (n[:, None, None] + 2)
    z = np.abs(share[1] - share[0]) / np.sqrt(sum(share[v] * (1 - share[v]) / n[v] for v in (0, 1)))
    z[df.sum(0) < LEAST_TEXTS] = 0
    best = z.max(1)
    good = np.flatnonzero(best >= LEAST_Z)
    good = np.sort(good[np.argsort(-best[good], kind="stable")[:MOST_FEATURES]])
    kept = (z[good] >= LEAST_Z).ravel()
    of = [(df[v][good].ravel() + 1) * kept for v in (0, 1)]
    ratio = np.zeros(len(kept))
    ratio[kept] = np.log((of[1][kept] / n[1]) / (of[0][kept] / n[0]))
    model = Model(every[good], ratio, 0.0)
    per = [model.found(t) for t, _ in sample]
    doc, col = np.repeat(np.arange(len(per)), [len(p) for p in per]), np.concatenate(per)
    x = ratio[col]
    w, b, rate = np.zeros(len(ratio)), 0.0, 4.0 / (np.bincount(doc, x * x, minlength=len(y)).max() + 1)
    balance = np.where(y == 1, TOXIC_WEIGHT / n[1], (1 - TOXIC_WEIGHT) / n[0])
    mw, mb = np.zeros_like(w), 0.0
    for _ in range(rounds):  # gradient descent with momentum
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, x * w[col], minlength=len(y)) + b, -40, 40)))
        e = (p - y) * balance
        mw = 0.95 * mw - rate * (np.bincount(col, x * e[doc], minlength=len(w)) + l2 * w / len(y))
        mb = 0.95 * mb - rate * e.sum()
        w, b = w + mw, b + mb
    return Model(every[good], w * ratio, float(b))


def toxicity_scores(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 of every whole text; null is scored as empty. The model's size is bounded.

    A column of docs that is called like `into` is replaced; all others pass unchanged, and so do repeated rows.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.hashes, model.weights, model.intercept))

    @F.arrow_udf("double")
    @lean()
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Model(*shared.value)
        for batch in batches:
            yield pa.array([m.score(t) for t in batch.to_pylist()], pa.float64())

    return docs.withColumn(into, run(F.col(text)))


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; repeated rows get equal scores, an empty table an empty result."""
    model = fit(labelled_texts(docs, labels, "toxic", MOST_LABELLED, MOST_CHARS))
    scored = toxicity_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """rated() over all documents and labels: a row for each, null texts and repeated rows included."""
    return rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
