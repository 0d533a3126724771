"""Sequence taggers: a convolution over token features beside injected token vectors, a bidirectional LSTM, a softmax.

The vectors are the rows of an embedding table in one model and the class scores of a token classifier in the other; both
come with the sequences, so one network serves both. Training is plain numpy over a bounded sample; there is no dropout.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Column order of tag scores.
TAGS = "SOIEB"
Sequence = tuple[np.ndarray, np.ndarray, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Weights, by name, of a network for `features` and `vectors` numbers a token."""

    def __init__(self, features: int, vectors: int, channels: int = 16, units: int = 16, seed: int = 0):
        rng = np.random.default_rng(seed)
        shapes = {"conv": (3 * features, channels), "out": (2 * units, len(TAGS))}
        for side in ("ahead", "back"):
            shapes |= {f"{side}_in": (channels + vectors, 4 * units), f"{side}_state": (units, 4 * units)}
        self.units, self.channels = units, channels
        self.w = {k: rng.normal(0, (2 / sum(s)) ** 0.5, s) for k, s in shapes.items()}
        self.w |= {f"{k}_bias": np.zeros(self.w[k].shape[1]) for k in ("conv", "ahead_in", "back_in", "out")}
        self._mean = {k: np.zeros_like(v) for k, v in self.w.items()}

    def _lstm(self, side: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        n, u = x.shape[0], self.units
        z = x @ self.w[f"{side}_in"] + self.w[f"{side}_in_bias"]
        h, c = np.zeros((n, u)), np.zeros((n, u))
        out, steps = np.zeros((*x.shape[:2], u)), []
        for t in range(x.shape[1]):
            a = z[:, t] + h @ self.w[f"{side}_state"]
            gates, g = _sigmoid(a[:, : 3 * u]), np.tanh(a[:, 3 * u :])
            i, f, o = gates[:, :u], gates[:, u : 2 * u], gates[:, 2 * u :]
            steps.append((h, c, i, f, o, g))
            c = f * c + i * g
            h = o * np.tanh(c)
            out[:, t] = h
        return out, steps

    def _lstm_back(self, side: str, x: np.ndarray, steps: list, d: np.ndarray, grad: dict) -> np.ndarray:
        state = self.w[f"{side}_state"]
        dz = np.zeros((*x.shape[:2], 4 * self.units))
        dh, dc = np.zeros_like(d[:, 0]), np.zeros_like(d[:, 0])
        grad[f"{side}_state"] = np.zeros_like(state)
        for t in reversed(range(x.shape[1])):
            h, c, i, f, o, g = steps[t]
            up = d[:, t] + dh
            end = np.tanh(f * c + i * g)
            dc = dc + up * o * (1 - end**2)
            dz[:, t] = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), up * end * o * (1 - o), dc * i * (1 - g**2)], 1)
            grad[f"{side}_state"] += h.T @ dz[:, t]
            dh, dc = dz[:, t] @ state.T, dc * f
        grad[f"{side}_in"] = np.einsum("bti,btj->ij", x, dz)
        grad[f"{side}_in_bias"] = dz.sum((0, 1))
        return dz @ self.w[f"{side}_in"].T

    def forward(self, features: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Tag scores [sequence, token, tag] of sequences of one length, and what the way back needs."""
        padded = np.pad(features, ((0, 0), (1, 1), (0, 0)))
        near = np.concatenate([padded[:, :-2], padded[:, 1:-1], padded[:, 2:]], 2)
        seen = np.maximum(near @ self.w["conv"] + self.w["conv_bias"], 0)
        x = np.concatenate([seen, vectors], 2)
        ahead, a = self._lstm("ahead", x)
        back, b = self._lstm("back", x[:, ::-1])
        h = np.concatenate([ahead, back[:, ::-1]], 2)
        s = h @ self.w["out"] + self.w["out_bias"]
        e = np.exp(s - s.max(2, keepdims=True))
        return e / e.sum(2, keepdims=True), (near, seen, x, a, b, h)

    def gradient(self, features: np.ndarray, vectors: np.ndarray, tags: np.ndarray) -> tuple[dict, float, float]:
        """The gradient of the mean cross entropy, that entropy, and the share of right tags."""
        p, (near, seen, x, a, b, h) = self.forward(features, vectors)
        right = np.take_along_axis(p, tags[..., None], 2)
        d = (p - np.eye(len(TAGS))[tags]) / tags.size
        grad = {"out": np.einsum("bti,btj->ij", h, d), "out_bias": d.sum((0, 1))}
        dh = d @ self.w["out"].T
        dx = self._lstm_back("ahead", x, a, dh[:, :, : self.units], grad)
        dx = dx + self._lstm_back("back", x[:, ::-1], b, dh[:, ::-1, self.units :], grad)[:, ::-1]
        ds = dx[:, :, : self.channels] * (seen > 0)
        grad |= {"conv": np.einsum("bti,btj->ij", near, ds), "conv_bias": ds.sum((0, 1))}
        return grad, float(-np.log(np.maximum(right, 1e-12)).mean()), float((p.argmax(2) == tags).mean())

    def step(self, grad: dict, rate: float) -> None:
        """One step of RMSprop."""
        for k, g in grad.items():
            self._mean[k] = 0.9 * self._mean[k] + 0.1 * g * g
            self.w[k] -= rate * g / (np.sqrt(self._mean[k]) + 1e-7)

    def tags(self, features: list[np.ndarray], vectors: list[np.ndarray]) -> list[str]:
        """The likeliest tags of sequences of any lengths, those of one length together."""
        out = [""] * len(features)
        for numbers in by_length(features).values():
            p, _ = self.forward(np.stack([features[i] for i in numbers]), np.stack([vectors[i] for i in numbers]))
            for i, best in zip(numbers, p.argmax(2), strict=True):
                out[i] = "".join(TAGS[k] for k in best)
        return out


def by_length(sequences: list[np.ndarray]) -> dict[int, list[int]]:
    """The numbers of the sequences of each length but zero."""
    out: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(sequences):
        if len(s):
            out[len(s)].append(i)
    return dict(out)


def train(model: Tagger, rows: list[Sequence], epochs: int, batch: int | None = None, rate: float = 0.01, seed: int = 0) -> list[tuple[int, float, float]]:
    """Epoch, loss and accuracy over tokens. A batch is all sequences of one length, or `batch` of them with the lengths in
    a new random order each epoch; sequences of one token are left out."""
    rng, history = np.random.default_rng(seed), []
    lengths = {n: k for n, k in sorted(by_length([r[0] for r in rows]).items()) if n > 1}
    for epoch in range(epochs):
        order = list(lengths) if batch is None else rng.permutation(list(lengths)).tolist()
        total, loss, right = 0, 0.0, 0.0
        for n in order:
            numbers = lengths[n] if batch is None else rng.permutation(lengths[n]).tolist()
            for at in range(0, len(numbers), batch or len(numbers)):
                part = numbers[at : at + (batch or len(numbers))]
                grad, some, share = model.gradient(*(np.stack([rows[i][c] for i in part]) for c in range(3)))
                model.step(grad, rate)
                total, loss, right = total + n * len(part), loss + some * n * len(part), right + share * n * len(part)
        history.append((epoch, loss / max(total, 1), right / max(total, 1)))
    return history


def matrix(values: pa.Array) -> np.ndarray:
    """A token list of number lists as a matrix."""
    return np.array(values.as_py() or [], np.float64)


def tag(model: Tagger, sequences: DataFrame, key: str) -> DataFrame:
    """key and tags of each row of `sequences` (key, features, vectors: one list of numbers for each token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, v = ([matrix(x) for x in b.column(c)] for c in ("features", "vectors"))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(model.tags(f, v), pa.string())], [key, "tags"])

    return sequences.select(key, "features", "vectors").mapInArrow(run, f"{key} {sequences.schema[key].dataType.simpleString()}, tags string")
