"""Chat, WARC, nearest neighbours, and the pipeline on small tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import ann, chat, warc
from spanloom.llm.common import lookup, scratch_path


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|\\>im_end a\n%"), st.text(alphabet="<%|\nab"))
def test_escapes_are_reversible(text, role):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    assert chat.unescape_role(chat.escape_role(role)) == role
    whole = "".join(x for x, _ in chat.segments(role, text))
    assert list(chat.parse(whole)) == [(role, text)]


def test_chat_report(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo <|im_end|>"), (2, 0, "assistant", "first"), (2, 1, "user", None), (3, None, None, "x"), (None, 0, "user", "q")]
    rows += [(7, i, "user" if i % 2 == 0 else "assistant", "t" * 50) for i in range(200)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    got = {r.conv_id: r for r in chat.chat_report(chat.format_fragments(df, max_chars=500)).collect()}
    assert set(got) == {1, 2, 3, 7, None}
    for c, r in got.items():
        own = sorted([x for x in rows if x[0] == c], key=lambda x: (x[1] is not None, x[1] or 0))
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        learned = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert (got[1].order_faults, got[1].complete) == (0, True)
    assert got[2].order_faults == 1 and not got[2].complete and got[7].order_faults == 0
    assert chat.chat_report(chat.format_fragments(df.where("conv_id = 99"))).count() == 0


def test_warc_round_trip(spark):
    html = ["<p>one é</p>", "<p>one é</p>", None, "", "x" * 300_000, "body\r\n\r\nwith breaks", "<p>one é</p>"]
    rows = [(i, f"http://a.example/{i} \r\nx" if i else None, h, 5) for i, h in enumerate(html)] + [(None, "u", "alone", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset int")
    folder = scratch_path(spark, "test-warc")
    index = warc.write_archives(pages, folder, roll=1000)
    got = {r.page_id: r for r in warc.read_records(index, folder).collect()}
    assert len(got) == len(rows)
    for i, _, h, _ in rows:
        data = (h or "").encode()
        same = [j for j, _, x, _ in rows if (x or "") == (h or "") and j is not None]
        first = max(same) if same else None
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), warc.payload_digest(data))
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == first or not same else ("revisit", first))
        assert got[i].payload == (data if got[i].record_type == "response" else b"")
    some = warc.read_records(index.where("page_id in (4, 5)"), folder).collect()
    assert {r.page_id for r in some} == {4, 5}
    assert warc.archive_pages(pages.where("page_id > 99")).count() == 0


def test_warc_tasks_follow_archive_bytes_and_repeated_ids(spark):
    pages = spark.createDataFrame([(i % 150, "u", f"{i % 40}" * 400, i) for i in range(400)], "page_id long, url string, html string, refers_to int")
    folder = scratch_path(spark, "test-warc")
    index = warc.write_archives(pages, folder)
    got = warc.read_records(index, folder, task_bytes=500)
    assert got.rdd.getNumPartitions() > 20 and got.count() == 400
    first = {}
    for i in range(400):
        first[i % 40] = max(first.get(i % 40, -1), i % 150)
    want = [(i % 150, None if first[i % 40] == i % 150 else first[i % 40]) for i in range(400)]
    assert sorted(str((r.page_id, r.refers_to)) for r in got.collect()) == sorted(map(str, want))


def test_lookup_spreads_common_keys(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "k long, v long")
    table = rows.groupBy("k").agg({"v": "max", "*": "count"}).toDF("k", "top", "n")
    for share in (1, 10, 10_000):
        got = lookup(rows, table, ["k"], "n", share)
        assert got.columns == ["k", "v", "top"] and got.count() == 300
        assert {r.k: r.top for r in got.collect()} == {r.k: r.top for r in table.collect()}


def test_ranges_are_joined():
    assert warc.coalesce_ranges([(0, 10), (10, 5), (40, 5), (1000, 1)], gap=30, span=100) == [(0, 45, [(0, 10), (10, 5), (40, 5)]), (1000, 1001, [(1000, 1)])]


def test_nearest_reaches_its_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[5:400] = x[5]  # many copies
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(5000, None, 0), (5100, [0.0] * 16, 0), (5200, [float("nan")] + [1.0] * 15, 0), (5300, [None] + [1.0] * 15, 0), (5400, [1.0] * 3, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got: dict = {}
    for r in ann.nearest(df, block_rows=700, sample=1000).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 100))
    hits = 0
    for q, rows_ in got.items():
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        rows_.sort()
        assert [r for r, _, _ in rows_] == list(range(1, 11))
        assert all(abs(s - d[v]) < 1e-12 for _, v, s in rows_)
        hits += len({v for _, v, _ in rows_} & set(order))
    assert hits >= 0.9 * 10 * len(got)
    assert [v for _, v, _ in got[100]] == [v for v in range(5, 16)][:10]
    assert ann.nearest(df.where("vec_id = 0")).count() == 0
    assert ann.nearest(df.where("vec_id < 0")).count() == 0
    assert ann.nearest(df.where("vec_id < 5")).count() == 4


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        path = str(tmp_path / str(len(sizes)))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    packed = pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
