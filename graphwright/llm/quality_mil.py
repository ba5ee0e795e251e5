"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages of 64 words. A passage is encoded from hashed words, hashed word
shapes and character-class shares; a tanh layer gives its representation h. Attention weights are
softmax(w . (tanh(V h) * sigmoid(U h))) over the bag, and the score is the logistic value of the weighted
representation. Everything is learned from document labels alone with Adam on the driver, on a
bounded sample (SAMPLE_ROWS documents); Spark samples, and scores all documents in Arrow batches.

Cases: null or empty texts are a bag with one empty passage and get a score; repeated rows score
alike; null doc_ids count as not held out; without labels of both kinds every score is the share of
label 1 (0.5 without any label); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import in_fold, labelled_sample
from .textbatch import Words, mix, pieces

PASSAGE_WORDS = 64
WORD_BUCKETS, SHAPE_BUCKETS = 96, 64
HIDDEN, GATE = 24, 12
SAMPLE_ROWS = 5_000
HELD_OUT_FOLD = 2
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#*$%&|<>", "!?", ".,;:")
_class_of = np.full(256, len(CLASSES), dtype=np.uint8)
for _k, _chars in enumerate(CLASSES):
    _class_of[np.frombuffer(_chars.encode(), np.uint8)] = _k
FEATURES = WORD_BUCKETS + SHAPE_BUCKETS + len(CLASSES) + 4


def passage_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (float32), and for each text the number of its first passage, with the end."""
    w = Words(column)
    counts = np.maximum(1, -(-w.counts // PASSAGE_WORDS))
    edges = np.concatenate(([0], np.cumsum(counts)))
    owner = w.owners()
    passage = edges[owner] + (np.arange(len(w)) - w.docs[owner]) // PASSAGE_WORDS
    n = int(edges[-1])
    x = np.zeros((n, FEATURES), dtype=np.float32)
    if not len(w):
        return x, edges
    hashes, lengths = w.hashes(), w.ends - w.starts
    kinds = _class_of[w.bytes]
    inner = np.zeros((len(CLASSES), len(w)), dtype=np.int32)
    for k in range(len(CLASSES)):
        total = np.zeros(len(kinds) + 1, dtype=np.int32)
        np.cumsum(kinds == k, out=total[1:])
        inner[k] = total[w.ends] - total[w.starts]
    shape = np.minimum(lengths, 15).astype(np.uint64)
    for k in range(len(CLASSES)):
        shape = shape * np.uint64(4) + np.minimum(inner[k], 3).astype(np.uint64)
    size = np.maximum(1, np.bincount(passage, minlength=n)).astype(np.float32)
    words = np.bincount(passage * WORD_BUCKETS + (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=n * WORD_BUCKETS).reshape(n, -1)
    shapes = np.bincount(passage * SHAPE_BUCKETS + (mix(shape) % np.uint64(SHAPE_BUCKETS)).astype(np.int64), minlength=n * SHAPE_BUCKETS).reshape(n, -1)
    x[:, :WORD_BUCKETS] = np.sqrt(words / size[:, None])
    x[:, WORD_BUCKETS : WORD_BUCKETS + SHAPE_BUCKETS] = np.sqrt(shapes / size[:, None])
    chars = np.maximum(1, np.bincount(passage, weights=lengths, minlength=n))
    at = WORD_BUCKETS + SHAPE_BUCKETS
    for k in range(len(CLASSES)):
        x[:, at + k] = 2 * np.sqrt(np.bincount(passage, weights=inner[k], minlength=n) / chars)
    at += len(CLASSES)
    for step in (1, 2):
        same = np.zeros(len(w), dtype=bool)
        same[step:] = (hashes[step:] == hashes[:-step]) & (passage[step:] == passage[:-step])
        x[:, at + step - 1] = 2 * np.bincount(passage, weights=same, minlength=n) / size
    x[:, at + 2] = chars / size / 10
    x[:, at + 3] = size / PASSAGE_WORDS
    return x, edges


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


class GatedAttention:
    """Parameters and both passes; bags are given as passages and the edges between bags."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"We": init(FEATURES, HIDDEN), "be": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "w": init(GATE, 1)[:, 0], "c": init(HIDDEN, 1)[:, 0], "b": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        p, starts = self.p, edges[:-1]
        h = np.tanh(x @ p["We"] + p["be"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        bag = np.repeat(np.arange(len(starts)), np.diff(edges))
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return _sigmoid(z @ p["c"] + p["b"]), {"h": h, "t": t, "s": s, "a": a, "z": z, "bag": bag}

    def gradients(self, x: np.ndarray, edges: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        score, k = self.forward(x, edges)
        h, t, s, a, bag = (k[n] for n in ("h", "t", "s", "a", "bag"))
        d = ((score - y) / len(y)).astype(np.float32)
        dz = d[:, None] * p["c"]
        da = (dz[bag] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, edges[:-1])[bag])
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh = a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T
        dx = dh * (1 - h * h)
        return {"We": x.T @ dx, "be": dx.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": k["z"].T @ d, "b": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, edges: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 0.004, decay: float = 1e-4, seed: int = 6) -> None:
        r = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(g) for k, g in self.p.items()}, {k: np.zeros_like(g) for k, g in self.p.items()}, 0
        epochs = max(8, min(epochs, 60_000 // max(1, len(y))))
        while step < 200 or epochs > 0:
            order = r.permutation(len(y))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                at = np.concatenate([np.arange(edges[j], edges[j + 1]) for j in own])
                g = self.gradients(x[at], np.concatenate(([0], np.cumsum(edges[own + 1] - edges[own]))), y[own])
                step += 1
                for k in self.p:
                    grad = g[k] + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            epochs -= 1


def fit_classifier(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> GatedAttention | float:
    """A model from at most sample_rows labelled documents outside the held-out fold; a constant if there are not both labels.

    Features are computed on the executors; the driver gets at most sample_rows documents' passages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            x, edges = passage_features(piece.column(1))
            bags = [x[edges[i] : edges[i + 1]].astype(np.float16).tobytes() for i in range(piece.num_rows)]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(bags, pa.binary()), piece.column(2)], names=["doc_id", "bag", "quality"])

    sample = labelled_sample(documents, labels, sample_rows, in_fold(F.col("doc_id"), HELD_OUT_FOLD))
    rows = sorted(sample.mapInArrow(run, "doc_id long, bag binary, quality int").toLocalIterator(), key=lambda r: (r["doc_id"], bytes(r["bag"])))
    y = np.array([r["quality"] for r in rows], dtype=np.float32)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    bags = [np.frombuffer(bytes(r["bag"]), dtype=np.float16).reshape(-1, FEATURES) for r in rows]
    model = GatedAttention()
    model.fit(np.concatenate(bags).astype(np.float32), np.concatenate(([0], np.cumsum([len(b) for b in bags]))), y)
    return model


def score_documents(documents: DataFrame, model: GatedAttention | float, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and n_passages for every row."""
    rows = documents.select("doc_id", "text", in_fold(F.col("doc_id"), HELD_OUT_FOLD).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            x, edges = passage_features(piece.column(1))
            score = np.full(piece.num_rows, model) if isinstance(model, float) else model.forward(x, edges)[0].astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(np.diff(edges))],
                names=["doc_id", "held_out", "score", "predicted", "n_passages"],
            )

    return rows.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, n_passages long")


def classify(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    return score_documents(documents, fit_classifier(documents, labels, sample_rows))
