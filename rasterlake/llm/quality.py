"""Quality by the votes of the nearest labelled documents in a latent-semantic space.

A text's terms are the shapes of its words (letters, capitals, digits and marks, runs made one), the ends of words, and
marks of repetition. TF-IDF of the terms of a labelled sample is reduced by singular value decomposition; every document
is folded into that space, all its cosines with the sample come from one exact matrix product a block, and the nearest
vote by similarity.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import CACHES, bounded_batches, fresh, held_out, lean, table
from rasterlake.llm.labelled import labelled_texts

#: Bounds of the labelled sample (rows, characters in all): what is broadcast is their vectors, a few MB at any input.
MOST_LABELLED, MOST_CHARS = 4000, 48_000_000
#: Hashed terms, dimensions, voters, and the power of the cosine that a vote weighs.
TERMS, DIMENSIONS, NEAREST, POWER = 4096, 48, 15, 8
THRESHOLD = 0.3

_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_lower, _upper, _digit = (re.compile(x) for x in (r"[^\W\d_A-ZÀ-ÖØ-Þ]+", r"[A-ZÀ-ÖØ-Þ]+", r"\d+"))
_same = re.compile(r"([^\w\s])\1+")


def _shape(word: str) -> str:
    core = word.rstrip(".,")
    if core.isalpha() and len(word) - len(core) < 2 and (core.islower() or len(core) > 1 and core[0].isupper() and core[1:].islower()):
        return ("a" if core.islower() else "Aa") + word[len(core) :]
    s = _lower.sub("a", word)
    s = _upper.sub(lambda m: "A" if len(m[0]) == 1 else "AA", s)
    return _same.sub(r"\1\1", _digit.sub("0", s))[:12]


class _Shapes(dict):
    """Term numbers of words' shapes and ends as one number, remembered for short words."""

    def __missing__(self, word: str) -> int:
        found = zlib.crc32(b"s" + _shape(word).encode()) % TERMS * TERMS + zlib.crc32(b"e" + word[-2:].encode("utf-8", "replace")) % TERMS
        if len(self) >= 200_000:
            self.clear()
        if len(word) <= 24:
            self[word] = found
        return found


_shapes = _Shapes()
CACHES["quality"] = _shapes.clear
_TERM = {k: zlib.crc32(k.encode()) % TERMS for k in ("again", "line again", "few", "kinds 0", "kinds 1", "kinds 2", "kinds 3", "kinds 4")}


def terms(text: str | None) -> np.ndarray:
    """Dampened counts of a text's hashed terms."""
    words = _words(text or "")
    counts = np.zeros(TERMS, np.float32)
    if not words:
        return counts
    kinds = Counter(words)
    both = np.fromiter(map(_shapes.__getitem__, kinds), np.int64, len(kinds))
    n = np.fromiter(kinds.values(), np.float64, len(kinds)) / len(words)
    counts += np.bincount(both // TERMS, n, minlength=TERMS) + 0.5 * np.bincount(both % TERMS, n, minlength=TERMS)
    # shares above those of running text: repeated neighbours, lines and words
    counts[_TERM["again"]] += 2 * sum(map(eq, words, words[1:])) / len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    counts[_TERM["line again"]] += 1 - len(set(lines)) / max(1, len(lines))
    most = max(kinds.values()) / len(words) if len(words) >= 20 else 0.0
    counts[_TERM[f"kinds {min(4, int(most * 8))}"]] += 0.3
    if len(words) < 30:
        counts[_TERM["few"]] += 0.3
    return np.sqrt(counts)


class Voters:
    """Labelled documents in the latent space. Arrays: idf, basis (terms x dimensions), unit vectors, labels."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray) -> None:
        self.idf, self.basis, self.vectors, self.labels = idf, basis, vectors, labels

    def fold(self, texts: list[str | None]) -> np.ndarray:
        x = np.stack([terms(t) for t in texts]) * self.idf if texts else np.zeros((0, TERMS), np.float32)
        v = x @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def vote(self, texts: list[str | None]) -> np.ndarray:
        """Scores from 0 to 1; texts without a word, and all texts where there are no voters, score 0."""
        out = np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if t and _words(t)]
        if not some or not len(self.labels):
            return out
        cosines = self.fold([texts[i] for i in some]) @ self.vectors.T
        k = min(NEAREST, len(self.labels))
        # the nearest, ties to the voters that come first
        near = np.argsort(-cosines, axis=1, kind="stable")[:, :k] if cosines.shape[1] <= 64 else _nearest(cosines, k)
        w = np.maximum(np.take_along_axis(cosines, near, 1).astype(np.float64), 1e-6) ** POWER
        out[some] = np.clip((w * self.labels[near]).sum(1) / w.sum(1), 0, 1)
        return out


def _nearest(cosines: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row, ties at the end of them to the first columns."""
    least = -np.partition(-cosines, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(cosines), k), np.int64)
    for r, row in enumerate(cosines):
        above = np.flatnonzero(row > least[r])
        out[r] = np.concatenate([above, np.flatnonzero(row == least[r])])[:k]
    return out


def fit(sample: list[tuple[str, int]]) -> Voters:
    """Voters of a labelled sample; none if it is empty."""
    x = np.stack([terms(t) for t, _ in sample]) if sample else np.zeros((0, TERMS), np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 0.2
    x = x * idf
    # right singular vectors from the smaller product, by subspace iteration from a fixed start
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((TERMS, DIMENSIONS + 16)).astype(np.float32))[0]
    for _ in range(6):
        q = np.linalg.qr(x.T @ (x @ q))[0] if len(x) else q
    small = x @ q
    turn = np.linalg.svd(small, full_matrices=False)[2] if len(x) else np.eye(q.shape[1], dtype=np.float32)
    basis = (q @ turn.T)[:, :DIMENSIONS].astype(np.float32)
    made = Voters(idf, basis, np.zeros((0, basis.shape[1]), np.float32), np.array([v for _, v in sample], np.float64))
    v = x @ basis
    made.vectors = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    return made


def quality_scores(docs: DataFrame, voters: Voters, text: str = "text", into: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 of every whole text; rows pass one by one, so repeated rows score alike.

    Null and empty texts score 0. A column of docs that is called like `into` is replaced; all others pass unchanged.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((voters.idf, voters.basis, voters.vectors, voters.labels))

    @F.arrow_udf("double")
    @lean("quality")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = Voters(*shared.value)
        for batch in batches:
            yield pa.array(v.vote(batch.to_pylist()), pa.float64())

    return docs.withColumn(into, run(F.col(text)))


def fitted(docs: DataFrame, labels: DataFrame) -> Voters:
    return fit(labelled_texts(docs, labels, "quality", MOST_LABELLED, MOST_CHARS))


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Null and empty texts score 0; an empty table gives no rows."""
    scored = quality_scores(docs.select("doc_id", "text"), fitted(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, all_docs: DataFrame | None = None) -> DataFrame:
    """The rows of docs whose text scores at least THRESHOLD, unchanged; voters are fitted on all_docs, or else docs."""
    (score,) = fresh(docs, "score")
    scored = quality_scores(docs, fitted(all_docs if all_docs is not None else docs, labels), into=score)
    return scored.where(F.col(score) >= THRESHOLD).drop(score)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """rated() over all documents and labels: a row for each, null texts and repeated rows included."""
    return rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
