"""Statistics of features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed_information(joint: Column, a: Column, b: Column, total: Column) -> Column:
    """Mutual information of two binary events in nats from the counts of both, of either, and of all; negative where
    they meet less often than by chance."""
    cells = [(joint, a, b), (a - joint, a, total - b), (b - joint, total - a, b), (total - a - b + joint, total - a, total - b)]
    parts = [F.when(o > 0, o / total * F.ln(o * total / (x * y))).otherwise(0.0) for o, x, y in cells]
    info = parts[0] + parts[1] + parts[2] + parts[3]
    return F.when(joint * total < a * b, -info).otherwise(info)


def confusion(score: Column, truth: Column, threshold: float = 0.5) -> list[Column]:
    """Aggregates tp, fp, fn, tn, f1 and accuracy of a score over a threshold against 0/1 truth."""
    yes = score > threshold
    tp, fp, fn, tn = (F.count_if(x) for x in (yes & (truth == 1), yes & (truth == 0), ~yes & (truth == 1), ~yes & (truth == 0)))
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), F.round(2 * tp / (2 * tp + fp + fn), 6).alias("f1"), F.round((tp + tn) / (tp + fp + fn + tn), 6).alias("accuracy")]
