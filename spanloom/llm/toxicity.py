"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as a word vector (frequent and telling words have their own, others share one) joined to a character
vector, the element-wise maximum over vectors of its byte n-grams with end marks. The network reads overlapping windows
of the whole text; a text's score is that of its worst window, in training (multiple-instance learning) as in use.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import BLOCK_BYTES, LOWER, WORD, arrow_limits, crc_mod, fresh, mix, run_hashes, string_buffer, text_column, tidy, words_of

WINDOW, STRIDE = 48, 24
#: Sizes of the word vector, the character vector, the recurrent state of one direction, and the n-gram table.
DW, DC, H, GRAMS = 6, 6, 8, 1 << 15
_SIZES = (3, 4)
#: Windows that go through the network at a time.
_LANES = 4096


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Words:
    """The words of one block: distinct ones with their n-gram ids, and the texts as runs of word numbers."""

    hashes: np.ndarray  # of distinct words
    grams: np.ndarray  # n-gram ids of all distinct words, word by word
    first: np.ndarray  # where each word's n-grams begin
    ids: np.ndarray  # distinct-word number of each word
    piece: np.ndarray  # piece of each word


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    low = LOWER[data]
    piece, s, e = words_of(data, offsets, WORD)
    hashes, at, ids = np.unique(run_hashes(low, s, e), return_index=True, return_inverse=True)
    s, e = s[at], e[at]
    # distinct words laid out one after the other, each between two marks
    size = e - s + 2
    begin = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else np.zeros(0, np.int64)
    total = int(size.sum())
    text = np.full(total, 1, np.uint64)
    inner = np.ones(total, bool)
    inner[begin], inner[begin + size - 1] = False, False
    source = np.repeat(s - begin - 1, size) + np.arange(total)
    text[inner] = low[source[inner]]
    owner = np.repeat(np.arange(len(size)), size)
    grams, owners = [], []
    for n in _SIZES:
        if total < n:
            continue
        h = np.zeros(total - n + 1, np.uint64)
        for i in range(n):
            h = h * np.uint64(257) + text[i : total - n + 1 + i]
        same = owner[: total - n + 1] == owner[n - 1 :]
        grams.append((mix(h[same] + np.uint64(n << 40)) % np.uint64(GRAMS)).astype(np.int64))
        owners.append(owner[: total - n + 1][same])
    grams, owners = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (grams, owners))
    order = np.argsort(owners, kind="stable")
    return Words(hashes, grams[order], np.searchsorted(owners[order], np.arange(len(size))), ids.reshape(-1), piece)


def windows_of(piece: np.ndarray, n_pieces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, length) of all overlapping windows: every STRIDE words, the last one ending with the piece."""
    count = np.bincount(piece, minlength=n_pieces)
    base = np.concatenate(([0], np.cumsum(count)[:-1])) if n_pieces else np.zeros(0, np.int64)
    n = np.where(count > WINDOW, -(-(count - WINDOW) // STRIDE) + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(n_pieces), n)
    k = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])) if n_pieces else n, n)
    start = np.minimum(k * STRIDE, np.maximum(count[owner] - WINDOW, 0))
    return owner, base[owner] + start, np.minimum(count[owner], WINDOW)


def window_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole texts as (document of each piece, bytes, piece offsets), at most about `limit` bytes at a time, so that the
    windows of all pieces are those of the whole texts: a text of over `limit` bytes is cut where a window begins, and each
    piece reads on to the end of the windows that begin in it."""
    raw, off = string_buffer(column)
    size = np.diff(off)
    short = np.flatnonzero(size <= limit)
    for group in np.split(short, np.flatnonzero(np.diff(np.cumsum(size[short]) // limit)) + 1) if len(short) else []:
        data = np.concatenate([raw[off[i] : off[i + 1]] for i in group])
        yield group, data, np.concatenate(([0], np.cumsum(size[group])))
    for i in np.flatnonzero(size > limit):
        data = raw[off[i] : off[i + 1]]
        _, s, e = words_of(data, np.array([0, len(data)]))
        a = 0
        while True:
            fit = np.searchsorted(s, s[a] + limit) - a if len(s) else 0  # words that begin within `limit` bytes
            b = a + max(fit // STRIDE, 1) * STRIDE  # windows that begin at words a to b - 1
            last = b + WINDOW >= len(s)
            stop = len(s) if last else b + WINDOW - STRIDE
            part = data[s[a] : e[stop - 1]] if len(s) else data[:0]
            yield np.array([i]), part, np.array([0, len(part)], np.int64)
            if last:
                break
            a = b


class Network:
    """Parameters of fixed size; `vocab` are sorted hashes of the words with vectors of their own."""

    def __init__(self, vocab: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.vocab = vocab
        d = DW + DC

        def init(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        self.p = {"word": (0.1 * init(len(vocab) + 1, DW) * np.sqrt(len(vocab) + 1)).astype(np.float32), "char": (0.1 * rng.normal(0, 1, (GRAMS, DC))).astype(np.float32), "att_w": init(2 * H, H), "att_v": init(H), "out": init(2 * H), "bias": np.zeros(1, np.float32)}
        for side in ("f", "b"):
            self.p |= {f"x{side}": init(d, 3 * H), f"h{side}": init(H, 3 * H), f"c{side}": np.zeros(3 * H, np.float32)}

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocab):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        return np.where(self.vocab[at] == hashes, at + 1, 0)

    def inputs(self, w: Words) -> np.ndarray:
        """The input vector of each distinct word."""
        chars = np.maximum.reduceat(self.p["char"][w.grams], w.first, axis=0) if len(w.first) else np.zeros((0, DC), np.float32)
        return np.concatenate([self.p["word"][self.word_ids(w.hashes)], chars], axis=1)

    def run(self, proj: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """Logits of windows (rows of ids into the projected inputs)."""
        n, t = ids.shape
        states = np.zeros((n, t, 2 * H), np.float32)
        for k, side in enumerate(("f", "b")):
            h = np.zeros((n, H), np.float32)
            u = self.p[f"h{side}"]
            for i in range(t) if side == "f" else range(t - 1, -1, -1):
                x = proj[side][ids[:, i]]
                gate = sigmoid(x[:, : 2 * H] + h @ u[:, : 2 * H])
                z, r = gate[:, :H], gate[:, H:]
                c = np.tanh(x[:, 2 * H :] + (r * h) @ u[:, 2 * H :])
                new = h + z * (c - h)
                if mask is not None:
                    new = np.where(mask[:, i, None], new, h)
                if keep is not None:
                    keep.append((h, z, r, c))
                h = new
                states[:, i, k * H : (k + 1) * H] = h
        inner = np.tanh(states @ self.p["att_w"])
        e = inner @ self.p["att_v"]
        if mask is not None:
            e = np.where(mask, e, -np.inf)
        a = np.exp(e - e.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        pooled = np.einsum("nt,ntd->nd", a, states)
        if keep is not None:
            keep.append((states, inner, a, pooled))
        return pooled @ self.p["out"] + self.p["bias"][0]

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {s: x @ self.p[f"x{s}"] + self.p[f"c{s}"] for s in ("f", "b")}

    def logits(self, w: Words, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        proj = self.project(self.inputs(w))
        out = np.zeros(len(starts), np.float32)
        for whole in (True, False):
            pick = np.flatnonzero((lengths == WINDOW) == whole)
            pick = pick[np.argsort(lengths[pick], kind="stable")]
            for i in range(0, len(pick), _LANES):
                rows = pick[i : i + _LANES]
                ids, mask = gather(w, starts[rows], lengths[rows])
                out[rows] = self.run(proj, ids, None if whole else mask)
        return out

    def scores(self, column: pa.Array, limit: int = BLOCK_BYTES) -> np.ndarray:
        """The score of each text, all its windows read, whatever the `limit` of a block; 0 for a text without words."""
        best = np.full(len(column), -np.inf)
        for docs, data, off in window_blocks(column, limit):
            w = read_words(data, off)
            owner, starts, lengths = windows_of(w.piece, len(docs))
            if len(starts):
                np.maximum.at(best, docs[owner], self.logits(w, starts, lengths))
        return np.where(np.isfinite(best), sigmoid(best), 0.0)

    def backward(self, w: Words, ids: np.ndarray, mask: np.ndarray, dlogit: np.ndarray, x: np.ndarray, keep: list) -> dict[str, np.ndarray]:
        """Gradients of the parameters for windows that `run` has read with `keep`."""
        n, t = ids.shape
        g: dict[str, np.ndarray] = {}
        states, inner, a, pooled = keep.pop()
        g["out"], g["bias"] = pooled.T @ dlogit, np.array([dlogit.sum()], np.float32)
        dpool = np.outer(dlogit, self.p["out"])
        da = np.einsum("nd,ntd->nt", dpool, states)
        de = a * (da - (a * da).sum(1, keepdims=True))
        dinner = de[:, :, None] * self.p["att_v"] * (1 - inner * inner)
        g["att_v"] = np.einsum("nt,nth->h", de, inner)
        g["att_w"] = states.reshape(-1, 2 * H).T @ dinner.reshape(-1, H)
        dstates = a[:, :, None] * dpool[:, None, :] + dinner @ self.p["att_w"].T
        dx = np.zeros_like(x)
        for k, side in reversed(list(enumerate(("f", "b")))):
            u = self.p[f"h{side}"]
            gu, gx, gc = np.zeros_like(u), np.zeros_like(self.p[f"x{side}"]), np.zeros(3 * H, np.float32)
            dh = np.zeros((n, H), np.float32)
            for i in range(t - 1, -1, -1) if side == "f" else range(t):
                h, z, r, c = keep.pop()
                dh = dh + dstates[:, i, k * H : (k + 1) * H]
                m = mask[:, i, None].astype(np.float32)
                dn = dh * m
                dc = dn * z * (1 - c * c)
                drh = dc @ u[:, 2 * H :].T
                dgate = np.concatenate([dn * (c - h) * z * (1 - z), drh * h * r * (1 - r)], axis=1)
                pre = np.concatenate([dgate, dc], axis=1)
                xs = x[ids[:, i]]
                gu[:, : 2 * H] += h.T @ dgate
                gu[:, 2 * H :] += (r * h).T @ dc
                gx += xs.T @ pre
                gc += pre.sum(0)
                np.add.at(dx, ids[:, i], pre @ self.p[f"x{side}"].T)
                dh = dh * (1 - m) + dn * (1 - z) + drh * r + dgate @ u[:, : 2 * H].T
            g |= {f"h{side}": gu, f"x{side}": gx, f"c{side}": gc}
        used = np.unique(ids)
        g["word"] = np.zeros_like(self.p["word"])
        np.add.at(g["word"], self.word_ids(w.hashes[used]), dx[used, :DW])
        g["char"] = np.zeros_like(self.p["char"])
        ends = np.append(w.first[1:], len(w.grams))
        for k in used:
            own = w.grams[w.first[k] : ends[k]]
            if len(own):
                top = self.p["char"][own].argmax(0)
                np.add.at(g["char"], (own[top], np.arange(DC)), dx[k, DW:])
        return g


def gather(w: Words, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of windows, and which of them are words of the window."""
    step = np.arange(int(lengths.max()))
    mask = step < lengths[:, None]
    return w.ids[np.where(mask, starts[:, None] + step, starts[:, None])], mask


def _odds(groups: np.ndarray, keys: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how many documents hold each, and its log odds of toxic against other documents."""
    pairs = np.unique(np.stack([keys.astype(np.uint64), groups.astype(np.uint64)], axis=1), axis=0)
    names, inverse = np.unique(pairs[:, 0], return_inverse=True)
    toxic = label[pairs[:, 1].astype(np.int64)]
    a, b = np.bincount(inverse, toxic), np.bincount(inverse, 1 - toxic)
    return names, a + b, np.log((a + 0.5) / (label.sum() + 1)) - np.log((b + 0.5) / ((1 - label).sum() + 1))


def fit_toxicity(texts: list[str], label: np.ndarray, words: int = 4000, epochs: int = 6, batch: int = 32, seed: int = 5, prevalence: float | None = None) -> Network:
    """Adam on the logistic loss of each text's worst window, both labels weighing the same; with a prevalence, scores
    are then moved from equal odds to the odds that it stands for. The first component of word and n-gram vectors starts as
    the log odds with which they tell toxic texts, so that a few passes are enough."""
    data = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)
    w = read_words(np.frombuffer(b"".join(data), np.uint8), off)
    label = label.astype(np.float64)
    if not len(w.ids) or not 0 < label.sum() < len(label):
        net = Network(np.zeros(0, np.uint64), seed)
        net.p["out"][:] = 0
        net.p["bias"][0] = 4.0 if len(label) and label.all() else -4.0
        return net
    numbers, freq, odds = _odds(w.piece, w.ids, label)
    weight = np.abs(odds) * np.sqrt(freq) + 1e-3 * freq
    chosen = np.sort(numbers[np.argsort(-weight, kind="stable")[:words]].astype(np.int64))
    net = Network(w.hashes[chosen], seed)
    net.p["word"][1:, 0] = np.clip(odds[np.searchsorted(numbers, chosen.astype(np.uint64))], -2, 4) / 2
    ends = np.append(w.first[1:], len(w.grams))
    seen = np.unique(np.stack([w.piece, w.ids], axis=1), axis=0)
    reps = (ends - w.first)[seen[:, 1]]
    flat = np.repeat(w.first[seen[:, 1]] - np.concatenate(([0], np.cumsum(reps)[:-1])), reps) + np.arange(reps.sum())
    grams, n, odds = _odds(np.repeat(seen[:, 0], reps), w.grams[flat], label)
    net.p["char"][grams.astype(np.int64), 0] = np.clip(np.where(n >= 2, odds, np.minimum(odds, 0)), -2, 4) / 2
    owner, starts, lengths = windows_of(w.piece, len(texts))
    by_text = np.searchsorted(owner, np.arange(len(texts) + 1))
    m1, m2, step = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    rng = np.random.default_rng(seed)
    some = np.flatnonzero(np.diff(by_text))
    rate = 0.01
    for _ in range(epochs):
        logits = net.logits(w, starts, lengths)
        # the worst window of each text, and one more window of each clean text
        rows, target = [], []
        for d in some:
            own = np.arange(by_text[d], by_text[d + 1])
            rows.append(own[logits[own].argmax()])
            target.append(label[d])
            if not label[d] and len(own) > 1:
                rows.append(rng.choice(own))
                target.append(0.0)
        rows, target = np.array(rows), np.array(target)
        balance = np.where(target == 1, 0.5 / max(target.sum(), 1), 0.5 / max((1 - target).sum(), 1)) * len(target)
        mixed = rng.permutation(len(rows))
        for i in range(0, len(rows), batch):
            part = mixed[i : i + batch]
            sub, ids, mask = _subset(w, starts[rows[part]], lengths[rows[part]])
            x = net.inputs(sub)
            keep: list = []
            out = net.run(net.project(x), ids, mask, keep)
            dlogit = ((sigmoid(out) - target[part]) * balance[part] / len(part)).astype(np.float32)
            grads = net.backward(sub, ids, mask, dlogit, x, keep)
            step += 1
            for k, gr in grads.items():
                gr = np.clip(gr, -1, 1)
                m1[k] += 0.1 * (gr - m1[k])
                m2[k] += 0.01 * (gr * gr - m2[k])
                net.p[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        rate *= 0.8
    if prevalence is not None and 0 < prevalence < 1:
        net.p["bias"] += np.float32(np.log(prevalence / (1 - prevalence)))
    return net


def _subset(w: Words, starts: np.ndarray, lengths: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """The distinct words of some windows, and the windows as numbers into them."""
    ids, mask = gather(w, starts, lengths)
    used, inverse = np.unique(ids, return_inverse=True)
    ends = np.append(w.first[1:], len(w.grams))
    size = (ends - w.first)[used]
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    flat = np.repeat(w.first[used] - begin, size) + np.arange(size.sum())
    return Words(w.hashes[used], w.grams[flat], begin, w.ids[:0], w.piece[:0]), inverse.reshape(ids.shape), mask


def train_toxicity(documents: DataFrame, labels: DataFrame, sample: int = 600, sample_bytes: int = 1 << 16, folds: int = 5, held_out: int = 0, **how) -> Network:
    """Fit on at most `sample` toxic and `sample` other labelled texts outside the held-out fold, chosen by a hash of
    doc_id, one text of each id. Texts of over `sample_bytes` bytes are no training texts; so the driver gets 2 * sample *
    sample_bytes bytes at most. A text that is labelled twice is toxic if either label says so."""
    known = labels.where((crc_mod("doc_id", folds) != held_out) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    order = F.xxhash64("doc_id")
    ids = known.where("toxic = 1").orderBy(order, "doc_id").limit(sample).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(sample))
    rows = documents.select("doc_id", text_column().alias("text")).where(F.octet_length("text") <= sample_bytes).join(F.broadcast(ids), "doc_id")  # at most 2 * sample ids
    got = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).toPandas().sort_values("doc_id")
    return fit_toxicity(list(got["text"]), got["toxic"].to_numpy(np.float64), prevalence=share, **how)


def score_toxicity(documents: DataFrame, network: Network, column: str = "toxicity_score") -> DataFrame:
    """documents with the score, 0 to 1, over all windows of the whole text (null: empty) in `column`. All other columns
    stay; one of that name is replaced. One map, no shuffle."""
    spark = documents.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(network)  # of fixed size
    rest = documents.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(shared.value.scores(b.column(b.num_columns - 1)))], [*b.schema.names[:-1], column])

    return rest.withColumn(fresh(rest.columns, "whole_text"), text_column()).mapInArrow(tidy(run), rest.schema.add(column, "double"))


def classify_toxicity(documents: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, **how) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `documents`.

    Null texts and texts without words score 0; a null doc_id is in no fold; repeated rows are scored each; without
    labels of both kinds every text with words has one score, low unless all labels are toxic.
    """
    scored = score_toxicity(documents.select("doc_id", "text"), train_toxicity(documents, labels, folds=folds, held_out=held_out, **how))
    return scored.select("doc_id", (crc_mod("doc_id", folds) == held_out).alias("held_out"), F.col("toxicity_score").alias("score"), F.when(F.col("toxicity_score") >= 0.5, 1).otherwise(0).alias("predicted"))
