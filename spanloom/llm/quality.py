"""Quality scores by positive-unlabelled learning.

A small network over surface statistics of the whole text is fitted to the non-negative unbiased risk of Kiryo et al.
(2017): trusted positives, unlabelled text, and a class prior that is estimated from the two samples alone (best-bin
estimation, Garg et al. 2021). Labels of negatives are never used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import BLOCK_BYTES, WORD, arrow_limits, crc_mod, fresh, lower_table, mix, run_hashes, text_blocks, text_column, tidy, words_of

#: Byte classes: (class, bytes); bytes of no class are class 0, other control bytes.
_CLASSES = [(1, b" "), (2, b"\n\t\r"), (3, bytes(range(97, 123))), (4, bytes(range(65, 91))), (5, b"0123456789"), (6, b"."), (7, b","), (8, b"!?"), (9, b"|"), (10, b"#$%&*@^~=+_"), (11, b"\"'()[]{}-:;`"), (12, b"<>/\\"), (13, bytes(range(0xC0, 0x100))), (14, bytes(range(0x80, 0xC0)))]
K = 15
CLASS = np.zeros(256, np.uint8)
for _k, _b in _CLASSES:
    CLASS[list(_b)] = _k
#: Word runs whose repetition within a block is counted.
_RUNS = (1, 2, 4)
WIDTH = K + K * K + len(_RUNS) + 3


def text_features(column: pa.Array, limit: int = BLOCK_BYTES) -> np.ndarray:
    """One row of statistics for each text: shares of byte classes and of their pairs, repeated words and word runs,
    word and text length. All bytes count. A text of over `limit` bytes is read in pieces, and its last byte, its last words and the
    runs it has had are carried from piece to piece, so that its row is that of the whole text."""
    n = len(column)
    uni, pair = np.zeros((n, K)), np.zeros((n, K * K))
    again, seen = np.zeros((n, len(_RUNS))), np.zeros((n, len(_RUNS)))
    n_words, n_bytes, stutter = np.zeros(n), np.zeros(n), np.zeros(n)
    lower = lower_table()
    open_doc, last_class, last_words = -1, 0, np.zeros(0, np.uint64)  # of the text that the last piece is of
    had = [np.zeros(0, np.uint64) for _ in _RUNS]
    for docs, data, off in text_blocks(column, limit):
        size = np.diff(off)
        np.add.at(n_bytes, docs, size)
        m = len(docs)
        goes_on = docs[0] == open_doc
        piece = np.repeat(np.arange(m), size)
        c = CLASS[data].astype(np.int64)
        np.add.at(uni, docs, np.bincount(piece * K + c, minlength=m * K).reshape(m, K))
        if len(c) > 1:
            two = (piece[:-1] * (K * K) + c[:-1] * K + c[1:])[piece[:-1] == piece[1:]]
            np.add.at(pair, docs, np.bincount(two, minlength=m * K * K).reshape(m, K * K))
        if goes_on and len(c):
            pair[docs[0], last_class * K + c[0]] += 1
        w, s, e = words_of(data, off, WORD)
        h = run_hashes(lower[data], s, e)
        np.add.at(n_words, docs, np.bincount(w, minlength=m))
        old = len(last_words) if goes_on else 0  # words of earlier pieces: no run ends in them
        if old:
            h, w = np.concatenate([last_words, h]), np.concatenate([np.zeros(old, w.dtype), w])
        next_had = [np.zeros(0, np.uint64) for _ in _RUNS]
        for j, k in enumerate(_RUNS):
            if len(h) >= k:
                run = h[k - 1 :].copy()
                for i in range(1, k):
                    run = mix(run) + h[k - 1 - i : len(h) - i]
                at = w[k - 1 :]
                keep = (w[: len(w) - k + 1] == at) & (np.arange(len(at)) + k > old)
                run, at = run[keep], at[keep]
                distinct = np.unique(mix(run) ^ mix(at.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
                total, new = np.bincount(at, minlength=m), np.bincount(at[distinct], minlength=m)
                if goes_on:
                    new[0] -= np.isin(run[distinct][at[distinct] == 0], had[j]).sum()
                np.add.at(seen, (docs, j), total)
                np.add.at(again, (docs, j), total - new)
                next_had[j] = np.unique(run[at == m - 1])
            if goes_on and m == 1:
                next_had[j] = np.union1d(had[j], next_had[j])
        if len(h) > 1:
            doubled = (h[1:] == h[:-1]) & (w[1:] == w[:-1]) & (np.arange(1, len(h)) >= old)
            np.add.at(stutter, docs, np.bincount(w[1:][doubled], minlength=m))
        had, last_words = next_had, h[w == m - 1][-(max(_RUNS) - 1) :]
        open_doc, last_class = docs[-1], int(c[-1]) if len(c) else 0
    some, ws = np.maximum(n_bytes, 1)[:, None], np.maximum(n_words, 1)
    return np.concatenate([np.sqrt(uni / some), np.sqrt(pair / some), again / np.maximum(seen, 1), (stutter / ws)[:, None], np.log1p(n_bytes / ws)[:, None] / 4, np.log1p(n_words)[:, None] / 10], axis=1).astype(np.float32)


@dataclass
class Model:
    """Standardisation and a network of one hidden layer; its size is fixed."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x).astype(np.float64), -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Best-bin estimate of the share of positives in the unlabelled sample, from scores of held-back rows: the least
    ratio of the two tail shares, each with its confidence radius."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    tops = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), tops, side="left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), tops, side="left") / len(unlabelled)
    radius = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    bound = (u + radius * 0.5) / np.maximum(p, 1e-9)
    i = int(np.argmin(np.where(p > radius, bound, np.inf)))
    return float(np.clip(u[i] / max(p[i], 1e-9), 0.05, 0.95))


def _train(p: np.ndarray, u: np.ndarray, prior: float, loss: str, seed: int, epochs: int, hidden: int = 24) -> Model:
    """Adam on the non-negative risk. loss "pu", or "pn", which tells the two samples apart (for the prior alone)."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([p, u])
    mean, scale = both.mean(0), both.std(0) + 0.02
    p, u = (np.clip((v - mean) / scale, -6, 6) for v in (p, u))
    d = p.shape[1]
    theta = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m1, m2, t = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta], 0
    batch = 256
    steps = max(1, max(len(p), len(u)) // batch)
    for _ in range(epochs):
        for _ in range(steps):
            x = np.concatenate([p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]])
            hid = np.tanh(x @ theta[0] + theta[1])
            g = hid @ theta[2] + theta[3][0]
            s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            # d/dg of the sigmoid losses l(g) = 1 - s and l(-g) = s, and of the logistic ones
            slope = s * (1 - s)
            dg = np.zeros_like(g)
            if loss == "pn":
                dg[:batch], dg[batch:] = (s[:batch] - 1) / batch, s[batch:] / batch
            else:
                negative = s[batch:].mean() - prior * s[:batch].mean()
                if negative >= 0:
                    dg[:batch] = (-prior * slope[:batch] - prior * slope[:batch]) / batch
                    dg[batch:] = slope[batch:] / batch
                else:
                    dg[:batch], dg[batch:] = prior * slope[:batch] / batch, -slope[batch:] / batch
            dh = np.outer(dg, theta[2]) * (1 - hid * hid)
            grads = [x.T @ dh + 1e-3 * theta[0], dh.sum(0), hid.T @ dg + 1e-3 * theta[2], np.array([dg.sum()])]
            t += 1
            for i, gr in enumerate(grads):
                m1[i] = 0.9 * m1[i] + 0.1 * gr
                m2[i] = 0.999 * m2[i] + 0.001 * gr * gr
                theta[i] -= 0.003 * (m1[i] / (1 - 0.9**t)) / (np.sqrt(m2[i] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, theta[0].astype(np.float32), theta[1].astype(np.float32), theta[2].astype(np.float32), float(theta[3][0]), prior)


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7, epochs: int = 30) -> Model:
    """The prior from a first network on two thirds of either sample, then the risk minimiser on all rows.

    Without positives or without unlabelled rows every score is 1/2.
    """
    if not len(positive) or not len(unlabelled):
        z = np.zeros
        return Model(z(WIDTH), np.ones(WIDTH), z((WIDTH, 1), np.float32), z(1, np.float32), z(1, np.float32), 0.0, 0.5)
    cut = [np.arange(len(x)) % 3 == 2 for x in (positive, unlabelled)]
    first = _train(positive[~cut[0]], unlabelled[~cut[1]], 0.5, "pn", seed, max(4, epochs // 4)) if min(len(positive), len(unlabelled)) >= 6 else None
    prior = estimate_prior(first.raw(positive[cut[0]]), first.raw(unlabelled[cut[1]])) if first else 0.5
    return _train(positive, unlabelled, prior, "pu", seed + 1, epochs)


def fit_quality(documents: DataFrame, labels: DataFrame, sample: int = 3000, folds: int = 3, held_out: int = 1) -> Model:
    """Fit on at most `sample` trusted positives and `sample` unlabelled texts, both outside the held-out fold and chosen
    by a hash of doc_id, one text of each id. The sample bounds what reaches the driver: one row of statistics each."""
    arrow_limits(documents.sparkSession)
    outside = (crc_mod("doc_id", folds) != held_out) & F.col("doc_id").isNotNull()
    p = labels.where(outside & (F.col("quality") == 1)).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("kind", F.lit(1))
    u = documents.where(outside).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample).withColumn("kind", F.lit(0))
    ids = F.broadcast(p.unionByName(u))  # at most 2 * sample rows, each with an id of its own kind
    rows = documents.select("doc_id", text_column().alias("text")).join(ids, "doc_id").select("doc_id", "kind", "text")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = text_features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("kind"), pa.array(x.astype("<f4").tobytes()[i * 4 * WIDTH : (i + 1) * 4 * WIDTH] for i in range(len(x)))], ["doc_id", "kind", "x"])

    got = rows.mapInArrow(tidy(featurise), "doc_id long, kind int, x binary")
    # of the rows that share an id one counts, the one with the least statistics: no more than the sample is collected
    got = got.groupBy("doc_id", "kind").agg(F.min("x").alias("x")).toPandas().sort_values(["kind", "doc_id"])
    parts = [np.frombuffer(b"".join(got.x[got.kind == k]), "<f4").reshape(-1, WIDTH) for k in (1, 0)]
    return fit_pu(*parts)


def score_quality(documents: DataFrame, model: Model, column: str = "quality_score") -> DataFrame:
    """documents with the score, 0 to 1, of the whole text (null: empty) in `column`. All other columns stay; one of that
    name is replaced. One map, no shuffle."""
    spark: SparkSession = documents.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size
    rest = documents.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = pa.array(shared.value.score(text_features(b.column(b.num_columns - 1))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], score], [*b.schema.names[:-1], column])

    return rest.withColumn(fresh(rest.columns, "whole_text"), text_column()).mapInArrow(tidy(run), rest.schema.add(column, "double"))


def classify_quality(documents: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `documents`.

    Null texts count as empty, as do texts without words; a null doc_id is in no fold; repeated rows are scored each;
    labels that occur twice count once; without usable labels every score is 1/2 and predicted 1.
    """
    scored = score_quality(documents.select("doc_id", "text"), fit_quality(documents, labels, folds=folds, held_out=held_out, **bounds))
    return scored.select("doc_id", (crc_mod("doc_id", folds) == held_out).alias("held_out"), F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= 0.5, 1).otherwise(0).alias("predicted"))
