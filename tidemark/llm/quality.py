"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of at most PASSAGE bytes, cut between words (a longer word between code points). Each
passage is encoded from its own byte classes, words and lines, an attention gate learned from document labels weighs
the passages, and the weighted sum is scored. Nothing else of a document is seen, so a bad passage must win its weight.

Defined results: null and empty texts are a bag with one empty passage; very long texts are read whole, all their
passages at once; ties and repeated rows: equal texts get equal scores; a training set without both labels (an empty
one, too) gives every text the share of label 1 (0.5 without rows); an empty table gives no rows; columns beside
doc_id and text are not looked at, and come through `keep_good` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, training_rows

PASSAGE = 512
#: The sample that is learned from: so many documents, and so many bytes of text, at most.
MAX_TRAIN_DOCS, MAX_TRAIN_BYTES = 6000, 48 << 20
KEEP_AT = 0.3
BUCKETS, HELD_BUCKET = 5, 0

_CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" ",
    b"\n",
    b"|",
    b".,;:",
    b"!?",
    b"#$%&*@^~`+=<>/\\_{}[]",
    b"'\"()-",
    bytes(range(0x80, 0xC0)),
    bytes(range(0xC0, 0x100)),
)
_N = len(_CLASSES) + 1
_CLASS_OF = np.full(256, _N - 1, dtype=np.int64)
for _k, _members in enumerate(_CLASSES):
    _CLASS_OF[list(_members)] = _k
#: Shares of byte classes, then word length, shares of repeated lines and of distinct words, log length and filler.
N_FEATURES = _N + 5
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\r\f\v")] = True


def passages(raw: bytes) -> list[bytes]:
    """The whole text in pieces of at most PASSAGE bytes; a piece ends after white space, or else at a code point."""
    if len(raw) <= PASSAGE:
        return [raw]
    spaces = np.nonzero(_SPACE[np.frombuffer(raw, dtype=np.uint8)])[0] + 1
    out, at = [], 0
    while len(raw) - at > PASSAGE:
        k = int(np.searchsorted(spaces, at + PASSAGE, side="right"))
        to = int(spaces[k - 1]) if k else 0
        if to <= at:
            to = at + PASSAGE
            while to > at + 1 and raw[to] & 0xC0 == 0x80:
                to -= 1
        out.append(raw[at:to])
        at = to
    return [*out, raw[at:]]


def encode(text: str) -> np.ndarray:
    """One feature row for each passage of the whole text."""
    parts = passages(text.encode("utf-8", "replace"))
    n = len(parts)
    sizes = np.array([len(p) for p in parts])
    codes = _CLASS_OF[np.frombuffer(b"".join(parts), dtype=np.uint8)]
    counts = np.bincount(np.repeat(np.arange(n) * _N, sizes) + codes, minlength=n * _N).reshape(n, _N).astype(np.float64)
    total = np.maximum(sizes, 1)[:, None].astype(np.float64)
    out = np.zeros((n, N_FEATURES))
    out[:, :_N] = counts / total
    out[:, _N] = np.log1p(total[:, 0] / (counts[:, 3] + counts[:, 4] + 1.0)) / 3.0
    for k, part in enumerate(parts):
        lines, words = part.split(b"\n"), part.split()
        out[k, _N + 1] = 1.0 - len(set(lines)) / len(lines)
        out[k, _N + 2] = len(set(words)) / max(1, len(words))
        out[k, _N + 3] = np.log1p(len(part)) / 6.0
        out[k, _N + 4] = min(1.0, len(words) / (1.0 + len(set(words))) / 10.0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class AttentionMil:
    """h = tanh(xW); a = softmax over the bag of w.(tanh(hV) * sigmoid(hU)); score = sigmoid(c.sum(a h) + b)."""

    def __init__(self, width: int = 16, gate: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0.0, 1.0 / np.sqrt(s[0]), s)
        self.p = {
            "W": draw(N_FEATURES, width),
            "B": np.zeros(width),
            "V": draw(width, gate),
            "U": draw(width, gate),
            "w": draw(gate),
            "c": draw(width),
            "b": np.zeros(1),
        }
        self.mean, self.scale, self.prior = np.zeros(N_FEATURES), np.ones(N_FEATURES), None

    def _forward(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> dict:
        p = self.p
        h = np.tanh(x @ p["W"] + p["B"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["b"])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, rounds: int = 400, rate: float = 0.02) -> AttentionMil:
        y = np.asarray(labels, dtype=np.float64)
        if not len(y) or y.min() == y.max():
            self.prior = float(y.mean()) if len(y) else 0.5
            return self
        x = np.concatenate(bags)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        sizes = np.array([len(b) for b in bags])
        starts, bag = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(bags)), sizes)
        p, m1, m2 = self.p, {}, {}
        for k in p:
            m1[k], m2[k] = np.zeros_like(p[k]), np.zeros_like(p[k])
        for step in range(1, rounds + 1):
            f = self._forward(x, starts, bag)
            d = (f["y"] - y) / len(y)
            dz = d[:, None] * p["c"]
            dot = (dz[bag] * f["h"]).sum(axis=1)
            de = f["a"] * (dot - np.add.reduceat(f["a"] * dot, starts)[bag])
            dt = de[:, None] * p["w"] * f["s"] * (1.0 - f["t"] ** 2)
            ds = de[:, None] * p["w"] * f["t"] * f["s"] * (1.0 - f["s"])
            dh = (f["a"][:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T) * (1.0 - f["h"] ** 2)
            grads = {
                "W": x.T @ dh + 1e-5 * p["W"],
                "B": dh.sum(axis=0),
                "V": f["h"].T @ dt,
                "U": f["h"].T @ ds,
                "w": (f["t"] * f["s"]).T @ de,
                "c": f["z"].T @ d + 1e-5 * p["c"],
                "b": np.array([d.sum()]),
            }
            for k, g in grads.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        bags = [encode(t or "") for t in texts]
        sizes = np.array([len(b) for b in bags])
        starts, bag = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(bags)), sizes)
        return self._forward((np.concatenate(bags) - self.mean) / self.scale, starts, bag)["y"]


def _features(frames):
    for frame in frames:
        bags = [encode(t) for t in frame["text"]]
        yield pd.DataFrame({"y": frame["y"], "bag": [b.ravel().astype(np.float32) for b in bags]})


def fit(documents: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, max_train_bytes: int = MAX_TRAIN_BYTES) -> AttentionMil:
    """Learn from a bounded sample of labelled documents outside the held-out bucket.

    Passage features, not texts, come to the driver: about a sixth of a byte for each byte of the sample's texts.
    Every passage of a sampled document counts.
    """
    sample = training_rows(documents, labels, "quality", BUCKETS, HELD_BUCKET, max_train_docs, max_train_bytes)
    rows = sample.mapInPandas(_features, "y int, bag array<float>").toPandas()
    order = sorted(range(len(rows)), key=lambda i: (int(rows["y"][i]), bytes(np.asarray(rows["bag"][i]).data)))
    bags = [np.asarray(rows["bag"][i], dtype=np.float64).reshape(-1, N_FEATURES) for i in order]
    return AttentionMil().fit(bags, np.array([rows["y"][i] for i in order]))


def scorer(model: AttentionMil):
    """A column function: text -> probability of quality 1. Small blocks of texts bound the memory."""

    @F.pandas_udf("double")
    def quality_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = texts.tolist()
            yield pd.Series(np.concatenate([model.score(values[i : i + 64]) for i in range(0, len(values), 64)] or [np.zeros(0)]))
        release()

    return quality_score


def score_documents(documents: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """(doc_id, score) of every row."""
    model = fit(documents, labels, max_train_docs)
    return documents.select("doc_id", scorer(model)(F.col("text")).alias("score"))


def keep_good(documents: DataFrame, labels: DataFrame, least: float = KEEP_AT) -> DataFrame:
    """The rows that score at least `least`, with their own columns only."""
    return documents.where(scorer(fit(documents, labels))(F.col("text")) >= least)
