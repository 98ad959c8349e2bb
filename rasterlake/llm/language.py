"""Language of a text by a bidirectional gated recurrent network over its bytes.

The network is trained in numpy by backpropagation through time. It labels every byte's position from the states of a
forward and a backward unit; the mean of a document's label probabilities over all positions is its prediction. Whole
texts are read, cut into windows that run side by side as one batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.llm.common import bounded_batches, held_out, lean, table

#: Units a direction; bytes a window; windows computed at once.
UNITS, WINDOW, AT_ONCE = 8, 128, 1024
#: Bounds of the sample that the network is fitted on: documents a language, and documents in all (if there are many
#: languages, each has fewer, one at least). The sample's rows are snippets of SNIPPET characters, WINDOWS a document.
MOST_A_LANGUAGE, MOST_LABELLED, WINDOWS, SNIPPET = 300, 4800, 8, 48
UNKNOWN = "und"
#: A byte that pads the last window of a text; its positions don't count.
PAD = 0

_letter = regex.compile(r"\p{L}").search


@dataclass
class Network:
    """names: languages. embed (2, 256, 3H): what a byte adds to update gate, reset gate and candidate of a direction.
    inner (2, H, 3H), bias (2, 3H): the recurrent part. Gates are 0.5 + 0.5 * tanh, a logistic curve. out (2H, L), out_bias (L): labels from both states."""

    names: list[str]
    embed: np.ndarray
    inner: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.inner, self.bias, self.out, self.out_bias]

    def states(self, x: np.ndarray, keep: bool = False):
        """States (T, 2, B, H) of windows x (T, B); [t, 1] is the backward unit's at position T-1-t."""
        steps, batch = x.shape
        h = np.zeros((2, batch, UNITS), np.float32)
        all_h = np.empty((steps, 2, batch, UNITS), np.float32)
        kept = []
        table = self.embed + self.bias[:, None, :] * np.repeat([1.0, 1.0, 0.0], UNITS).astype(np.float32)
        inner_bias = self.bias[:, None, 2 * UNITS :]
        a = np.empty((2, batch, 3 * UNITS), np.float32)
        for t in range(steps):
            np.take(table[0], x[t], 0, out=a[0], mode="clip")
            np.take(table[1], x[steps - 1 - t], 0, out=a[1], mode="clip")
            m = np.matmul(h, self.inner)
            gates = a[..., : 2 * UNITS] + m[..., : 2 * UNITS]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[..., :UNITS], gates[..., UNITS:]
            own = m[..., 2 * UNITS :] + inner_bias
            n = own * r
            n += a[..., 2 * UNITS :]
            np.tanh(n, out=n)
            new = h - n
            new *= z
            new += n
            if keep:
                kept.append((h, z, r, n, own))
            h = new
            all_h[t] = h
        return (all_h, kept) if keep else all_h

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(T, B, L) label probabilities of every position."""
        s = self.states(x)
        steps, _, batch, _ = s.shape
        logits = s[:, 0].reshape(-1, UNITS) @ self.out[:UNITS] + s[::-1, 1].reshape(-1, UNITS) @ self.out[UNITS:] + self.out_bias
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits.reshape(steps, batch, -1)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over all positions of windows x (T, B) with labels y (B), and its gradients, back through time."""
        s, kept = self.states(x, keep=True)
        steps, _, batch, _ = s.shape
        fwd, bwd = s[:, 0].reshape(-1, UNITS), s[::-1, 1].reshape(-1, UNITS)
        logits = fwd @ self.out[:UNITS] + bwd @ self.out[UNITS:] + self.out_bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        real = (x.reshape(-1) != PAD).astype(np.float32)
        count = max(1.0, real.sum())
        label = np.tile(y, steps)
        loss = float(-(np.log(p[np.arange(len(p)), label] + 1e-9) * real).sum() / count)
        p[np.arange(len(p)), label] -= 1
        p *= (real / count)[:, None]
        d_out = np.concatenate([fwd.T @ p, bwd.T @ p])
        d_bias_out = p.sum(0)
        d_s = np.empty_like(s)
        d_s[:, 0] = (p @ self.out[:UNITS].T).reshape(steps, batch, UNITS)
        d_s[:, 1] = (p @ self.out[UNITS:].T).reshape(steps, batch, UNITS)[::-1]
        d_embed, d_inner, d_bias = (np.zeros_like(w) for w in (self.embed, self.inner, self.bias))
        dh = np.zeros((2, batch, UNITS), np.float32)
        d_a = np.empty((steps, 2, batch, 3 * UNITS), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, n, own = kept[t]
            dh = dh + d_s[t]
            dn = dh * (1 - z) * (1 - n * n)
            d_own = dn * r
            gate = np.concatenate([dh * (h - n) * z * (1 - z), dn * own * r * (1 - r)], -1) * 2  # twice z(1-z): the slope of 0.5 + 0.5 tanh
            d_a[t] = np.concatenate([gate, dn], -1)
            d_m = np.concatenate([gate, d_own], -1)
            d_inner += np.matmul(h.transpose(0, 2, 1), d_m)
            d_bias += d_m.sum(1)
            dh = dh * z + np.matmul(d_m, self.inner.transpose(0, 2, 1))
        for k, order in ((0, x), (1, x[::-1])):
            flat, rows = order.reshape(-1), d_a[:, k].reshape(-1, 3 * UNITS)
            for j in range(3 * UNITS):
                d_embed[k, :, j] = np.bincount(flat, rows[:, j], minlength=256)
        return loss, [d_embed, d_inner, d_bias, d_out, d_bias_out]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its pooled probability for each text. Null, or without a letter: `und`, 0. Memory is bounded."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        sums = np.zeros((len(texts), len(self.names)))
        lengths = np.zeros(len(texts))
        parts: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        waiting = 0

        def flush() -> None:
            nonlocal waiting
            if waiting:
                windows, own = np.concatenate(parts), np.concatenate(owners)
                for k in range(0, len(windows), AT_ONCE):
                    x = np.ascontiguousarray(windows[k : k + AT_ONCE].T)
                    p = (self.probabilities(x) * (x != PAD)[..., None]).sum(0)
                    np.add.at(sums, own[k : k + AT_ONCE], p)
                parts.clear()
                owners.clear()
                waiting = 0

        for i, text in enumerate(texts):
            if not text or not _letter(text) or not self.names:
                continue
            for cut in _windows(text):
                parts.append(cut)
                owners.append(np.full(len(cut), i))
                lengths[i] += np.count_nonzero(cut)
                waiting += len(cut)
                if waiting >= AT_ONCE:
                    flush()
        flush()
        for i in np.flatnonzero(lengths):
            p = sums[i] / lengths[i]
            best = int(p.argmax())
            names[i], scores[i] = self.names[best], float(min(1.0, p[best]))
        return names, scores


def _windows(text: str) -> Iterator[np.ndarray]:
    """All bytes of a text in windows of WINDOW, the last one padded; at most AT_ONCE windows an array."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    step = WINDOW * AT_ONCE
    for k in range(0, len(data), step):
        piece = data[k : k + step]
        whole = np.zeros(-(-len(piece) // WINDOW) * WINDOW, np.uint8)
        whole[: len(piece)] = piece
        yield whole.reshape(-1, WINDOW)


def fit(sample: list[tuple[str, str]], epochs: int = 10, batch: int = 64, rate: float = 0.02, length: int = SNIPPET) -> Network:
    """A network fitted to (snippet, language) pairs, the same at every run. Without pairs it knows no language."""
    names = sorted({v for _, v in sample})
    rng = np.random.default_rng(11)
    u, n = UNITS, len(names)
    scale = np.repeat([0.5, 0.5, 1.0], u).astype(np.float32)
    net = Network(
        names, (rng.standard_normal((2, 256, 3 * u)) * 0.3).astype(np.float32) * scale, (rng.standard_normal((2, u, 3 * u)) * 0.3).astype(np.float32) * scale,
        np.zeros((2, 3 * u), np.float32), (rng.standard_normal((2 * u, max(n, 1))) * 0.3).astype(np.float32), np.zeros(max(n, 1), np.float32),
    )
    net.bias[:, :u] = 0.5  # states last at first
    x, y = [], []
    for text, name in sample:
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        w = np.zeros(length, np.uint8)
        w[: len(data[:length])] = data[:length]
        x.append(w)
        y.append(names.index(name))
    if n < 2:
        return net
    x, y = np.stack(x), np.array(y)
    m, v = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    step, total = 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            _, g = net.gradients(np.ascontiguousarray(x[own].T), y[own])
            step += 1
            norm = np.sqrt(sum(float((a * a).sum()) for a in g))
            r = rate * (1 - step / (total + 1))
            for w, a, mm, vv in zip(net.weights(), g, m, v):
                a = a * min(1.0, 1.0 / (norm + 1e-9))
                mm += 0.1 * (a - mm)
                vv += 0.001 * (a * a - vv)
                w -= (r * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def language_snippets(docs: DataFrame, most: int = MOST_A_LANGUAGE, length: int = SNIPPET, in_all: int = MOST_LABELLED) -> list[tuple[str, str]]:
    """(snippet, lang): WINDOWS snippets, from anywhere in the text, of up to `most` documents of each language there is.

    Where `most` documents of every language would be more than `in_all`, each has its equal share of that, one at least.
    Held-out documents, null languages and null or empty texts don't count; null ids aren't held out. The documents are
    the first in the order of a hash of their id, whatever the partitions; each partition passes on `most` ids a
    language at most, and only the snippets reach the driver.
    """
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out()).select("doc_id", F.col("lang").cast("string").alias("name"))
    most = max(1, min(most, in_all // max(1, known.select("name").distinct().count())))
    order = Window.partitionBy("name").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).drop("nth").distinct()
    n = F.greatest(F.length("text") - length + 1, F.lit(1))
    cuts = [F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit(k)), n) + 1).cast("int"), F.lit(length)) for k in range(WINDOWS)]
    own = docs.where(F.length("text") > 0).select("doc_id", "text", F.col("lang").cast("string").alias("name"))
    # in_all ids at most, or one a language: texts aren't shuffled to meet them, and rows of equal ids count once
    rows = own.join(F.broadcast(ids), ["doc_id", "name"]).dropDuplicates(["doc_id", "name"]).select("name", F.array(*cuts).alias("cuts")).collect()
    return sorted((c, r["name"]) for r in rows for c in r["cuts"])


def predicted_languages(docs: DataFrame, net: Network, text: str = "text", into: str = "language") -> DataFrame:
    """docs with a struct of lang_pred and score of each whole text; null, or without a letter: `und` and 0.

    The network's size grows only with the number of languages. A column of docs that is called like `into` is replaced;
    all others pass unchanged, and so do repeated rows.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((net.names, *net.weights()))

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    @lean()
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        n = Network(*shared.value)
        for batch in batches:
            names, scores = n.predict(batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return docs.withColumn(into, run(F.col(text)))


def rated(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; repeated rows get equal answers, an empty table no rows."""
    net = fit(language_snippets(docs.select("doc_id", "text", "lang")))
    out = predicted_languages(docs.select("doc_id", "text"), net)
    return out.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score")


def op10_language(spark, sf_dir: str) -> DataFrame:
    """rated() over all documents: a row for each, null texts and repeated rows included."""
    return rated(table(spark, sf_dir, "documents"))
