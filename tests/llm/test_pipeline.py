"""The pipeline against plain versions of its stages, and on odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from spanloom.llm.packing import cut
from spanloom.llm.quality import fit_quality

from .test_near_copies import plain_groups
from .test_text_operators import infix_distance, plain_statistics

pipeline = pytest.importorskip("corpus_pipeline")
public = pytest.importorskip("public_tokenizers")

COLUMNS = "doc_id long, text string, quality_score double, tid string, whole_text int, row int, n_chars int"


def sentence(rng, n=60):
    words = [("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))) for _ in range(n)]
    return ". ".join(" ".join(words[i : i + 12]).capitalize() for i in range(0, n, 12)) + "."


def tables(spark, folder):
    """Documents with good and bad texts, near copies, shared lines, leaks and odd rows; labels; benchmark items."""
    rng = random.Random(12)
    items = [" ".join("".join(rng.choice("klmnopqrst") for _ in range(5)) for _ in range(rng.randint(14, 30))) for _ in range(6)]
    shared = "A notice of more than forty characters that many documents carry"
    good = [sentence(rng) for _ in range(60)]
    texts = list(good)
    for i in range(12):  # near copies of five-word Jaccard above 0.8
        w = good[i].split(" ")
        w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += [f"{t}\n{shared}" for t in (sentence(rng) for _ in range(8))]
    texts += [f"{sentence(rng)} {items[i]} {sentence(rng, 12)}" for i in range(6)]
    texts += ["BUY!! $$$ %%% NOW!! " * rng.randint(5, 20) + str(i) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (None, good[20]), (502, good[30]), (3, good[3]), (3, good[3]), (4, sentence(rng)), (503, sentence(rng) * 40)]
    docs = spark.createDataFrame([(i, t, 1.5, "x", k, k, len(t or "")) for k, (i, t) in enumerate(rows)], COLUMNS)
    docs.write.parquet(f"{folder}/documents.parquet")
    bad = range(86, 146)
    spark.createDataFrame([(i, int(i not in bad), 0) for i in range(146) if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def plain_run(rows, items, model):
    """The numbers of the rows that the first four stages keep, with their texts."""
    x = np.array([plain_statistics(t or "") for _, t in rows], np.float32)
    kept = [k for k in range(len(rows)) if model.score(x)[k] >= 0.5]
    docs = {k: rows[k] for k in kept}
    count: dict = {}
    for i, t in docs.values():
        for line in set((t or "").lower().split("\n")):
            if i is not None and len(line.strip()) >= 40:
                count.setdefault(line.strip(), set()).add(i)
    rest = {}
    for k, (i, t) in docs.items():
        lines = (t or "").split("\n")
        rest[k] = (i, "\n".join(x for x in lines if i is None or len(count.get(x.strip().lower(), ())) < 5 or max(count[x.strip().lower()]) == i))
    ids = [k for k in rest if rest[k][0] is not None]
    groups: dict = {}
    for k, g in zip(ids, plain_groups([rest[k][1] for k in ids]), strict=True):
        groups.setdefault(g, []).append(k)
    stay = [k for k in rest if rest[k][0] is None]
    for g in groups.values():
        low = min(rest[k][0] for k in g)
        stay.append(min(k for k in g if rest[k][0] == low))
    return {k: rest[k] for k in stay if not any(infix_distance(x.split(), rest[k][1].lower().replace(".", "").split()) <= int(0.2 * len(x.split())) for x in items)}


def test_pipeline_against_a_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    folder = str(tmp_path)
    rows, items = tables(spark, folder)
    model = fit_quality(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    want = plain_run(rows, items, model)
    assert 40 < len(want) < 90
    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    packed = sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in pipeline.run(spark, folder).collect())
    whole = []
    for i, t in want.values():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for k, (at, n) in enumerate(cut(len(ids), 2048)):
            whole.append((str(i), k, n, zlib.crc32(ids[at : at + n].tobytes())))
    assert packed == sorted(whole)


def test_stages_on_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    none = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < -5")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, none, folder).count() == 0
    assert pipeline.STAGES[-1][1](spark, none, folder).count() == 0
