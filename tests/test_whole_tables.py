"""Queries that once read only a part of their table."""

from __future__ import annotations

import hashlib

from spanloom.plans.all import QUERIES


def test_srt_3_returns_every_unambiguous_word(spark, tmp_path):
    rows = [(i, " ".join(f"w{j}" for j in range(i * 100, i * 100 + 130))) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen: dict = {}
    for i, text in rows:
        for w in text.split():
            seen.setdefault(w, set()).add(i % 2)
    want = sorted(((w, min(t)) for w, t in seen.items() if len(t) == 1), key=lambda x: (hashlib.md5(x[0].encode()).hexdigest(), x[0]))
    assert len(want) > 500
    assert [tuple(r) for r in QUERIES["srt_3"](spark, str(tmp_path)).collect()] == want


def test_ml_9_reads_whole_texts_and_nulls(spark, tmp_path):
    texts = ["a" * 64 + "b", "a" * 64 + "c", None, "", "short é"]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.turn: r.score for r in QUERIES["ml_9"](spark, str(tmp_path)).collect()}
    assert got == {i: sum(map(ord, t or "")) % 101 / 100.0 for i, t in enumerate(texts)} and got[0] != got[1]
