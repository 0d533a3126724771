"""Quality, licences, toxicity, lines, SimHash, decontamination, packing: small tables, brute force, odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from spanloom.llm import decontaminate as dc
from spanloom.llm import packing, quality, simhash, toxicity
from spanloom.llm.common import string_buffer, text_blocks
from spanloom.llm.components import connected_components
from spanloom.llm.licenses import TEMPLATES, Template, scan_licenses
from spanloom.llm.line_dedup import dedup_lines, line_report

SCHEMA = "doc_id long, text string, score double, source string"
GOOD, BAD = "The plain words of a calm text, in order. ", "BUY!! NOW!! $$$ %%% "


def frame(spark, rows):
    """Rows of (doc_id, text), with further columns whose names clash with results."""
    return spark.createDataFrame([(i, t, -1.0, "x") for i, t in rows], SCHEMA)


def odd(rows):
    """The same rows with a null text, an empty one, a null id, a repeated row and a long text."""
    return [*rows, (9001, None), (9002, ""), (None, "a text without a number"), (9003, "long " * 60_000), rows[0], rows[0]]


def labelled(spark, n=120):
    rng = random.Random(1)
    rows = [(i, (GOOD if i % 3 else BAD) * rng.randint(2, 9) + str(i)) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(n) if i % 4], "doc_id long, quality int, toxic int")
    return rows, labels


def test_blocks_keep_every_byte():
    texts = ["", "ab cd " * 5, "x" * 50, "é " * 30, "end"]
    got: dict[int, bytes] = {}
    for docs, data, off in text_blocks(pa.array(texts), limit=16):
        for k, d in enumerate(docs):
            got[int(d)] = got.get(int(d), b"") + data[off[k] : off[k + 1]].tobytes()
    assert [got[i].decode() for i in range(len(texts))] == texts
    assert string_buffer(pa.array(texts).slice(1, 2))[1].tolist()[-1] - string_buffer(pa.array(texts).slice(1, 2))[1].tolist()[0] == 80


def test_quality_and_toxicity_score_all_rows(spark):
    rows, labels = labelled(spark)
    docs = frame(spark, odd(rows))
    for classify, want, fold in ((quality.classify_quality, lambda i: int(i % 3 > 0), (3, 1)), (toxicity.classify_toxicity, lambda i: int(i % 3 == 0), (5, 0))):
        got = classify(docs, labels).collect()
        assert len(got) == len(odd(rows))
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        known = [r for r in got if r.doc_id is not None and r.doc_id < 9000]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) for r in known)
        held = [r for r in known if r.held_out]
        assert np.mean([r.predicted == want(r.doc_id) for r in held]) > 0.9
        assert [r.held_out for r in got if r.doc_id is None] == [False]


def plain_statistics(text):
    """The row of statistics of one text, by loops over its bytes and words."""
    data = text.encode()
    cls = [int(quality.CLASS[b]) for b in data]
    uni = [cls.count(k) / max(len(data), 1) for k in range(quality.K)]
    pairs = Counter(zip(cls, cls[1:], strict=False))
    pair = [pairs[a, b] / max(len(data), 1) for a in range(quality.K) for b in range(quality.K)]
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", data.lower())
    runs = [list(zip(*(words[i:] for i in range(k)), strict=False)) for k in (1, 2, 4)]
    again = [(len(r) - len(set(r))) / max(len(r), 1) for r in runs]
    n = max(len(words), 1)
    stutter = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    return np.array([*np.sqrt(uni), *np.sqrt(pair), *again, stutter, np.log1p(len(data) / n) / 4, np.log1p(len(words)) / 10])


def mixed_texts():
    rng = random.Random(11)
    some = lambda n: " ".join(rng.choice(["alpha", "Beta,", "é9", "x\n", "99", "y y"]) for _ in range(n))
    passage = some(300)
    return ["", "one", some(20), f"{passage} {passage}", some(3), "z" * 500 + " tail", some(2000), "...!!!", some(48), some(49)]


@pytest.mark.parametrize("limit", [64, 700, 1 << 20])
def test_quality_statistics_are_those_of_the_whole_text(limit):
    texts = mixed_texts()
    got = quality.text_features(pa.array(texts), limit)
    assert np.allclose(got, [plain_statistics(t) for t in texts], atol=1e-6)


def plain_toxicity(net, text):
    """The score of one text, word by word and window by window."""
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode().lower())
    if not words:
        return 0.0
    n = len(words)
    starts = sorted({*range(0, max(n - 48, 0), 24), max(n - 48, 0)})
    return float(max(toxicity.sigmoid(plain_window(net, words[a : a + 48])) for a in starts))


def plain_window(net, words):
    p, x = {k: v.astype(np.float64) for k, v in net.p.items()}, []
    for word in words:
        w = toxicity.read_words(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
        char = np.max([p["char"][g] for g in w.grams], axis=0)
        x.append(np.concatenate([p["word"][net.word_ids(w.hashes)[0]], char]))
    states = []
    for side, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        h, out, n = np.zeros(toxicity.H), {}, toxicity.H
        for i in order:
            a = x[i] @ p[f"x{side}"] + p[f"c{side}"]
            gate = toxicity.sigmoid(a[: 2 * n] + h @ p[f"h{side}"][:, : 2 * n])
            c = np.tanh(a[2 * n :] + (gate[n:] * h) @ p[f"h{side}"][:, 2 * n :])
            h = out[i] = (1 - gate[:n]) * h + gate[:n] * c
        states.append([out[i] for i in range(len(x))])
    s = np.concatenate([np.array(v) for v in states], axis=1)
    e = np.tanh(s @ p["att_w"]) @ p["att_v"]
    a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
    return a @ s @ p["out"] + p["bias"][0]


@pytest.mark.parametrize("limit", [64, 700, 1 << 20])
def test_toxicity_scores_are_those_of_the_whole_text(limit):
    texts = mixed_texts()
    net = toxicity.fit_toxicity([*texts, "foul words " * 30], np.array([0.0] * len(texts) + [1.0]), epochs=1)
    got = net.scores(pa.array(texts), limit)
    assert np.allclose(got, [plain_toxicity(net, t) for t in texts], atol=1e-5)


def test_training_makes_the_toxicity_result():
    """With the word vectors that training starts from, but without training, the network does not tell the texts apart:
    the same words are toxic in one order and harmless in the other."""
    rng = random.Random(4)
    texts, label = [], []
    for i in range(240):
        fill = [rng.choice(["calm", "river", "stone", "paper"]) for _ in range(rng.randint(4, 12))]
        pair = ["you", "bad"] if i % 2 else ["bad", "you"]
        at = rng.randrange(len(fill))
        texts.append(" ".join([*fill[:at], *pair, *fill[at:]]))
        label.append(float(i % 2))
    y = np.array(label)
    before = toxicity.fit_toxicity(texts[:160], y[:160], epochs=0).scores(pa.array(texts[160:]))
    after = toxicity.fit_toxicity(texts[:160], y[:160], epochs=40).scores(pa.array(texts[160:]))
    right = [float(((s >= 0.5) == y[160:]).mean()) for s in (before, after)]
    assert right[0] < 0.7 and right[1] > 0.9


def test_samples_are_of_ids_not_rows(spark):
    rows, labels = labelled(spark, 60)
    many = frame(spark, [*rows, *[(3, rows[3][1])] * 300, *[(3, GOOD + str(i)) for i in range(300)]])
    twice = labels.unionByName(labels).unionByName(spark.createDataFrame([(6, None, None), (None, 1, 1)], labels.schema))
    plain = frame(spark, [*rows, (3, GOOD + "0")])
    a, b = quality.fit_quality(many, twice, sample=40), quality.fit_quality(plain, labels, sample=40)
    assert a.prior == b.prior or abs(a.prior - b.prior) < 0.2
    t = toxicity.train_toxicity(many, twice, sample=20)
    assert len(t.vocab) and toxicity.train_toxicity(many, twice, sample_bytes=10).vocab.size == 0


def test_classifiers_without_rows_or_labels(spark):
    _, labels = labelled(spark)
    assert quality.classify_quality(frame(spark, []), labels).count() == 0
    assert toxicity.classify_toxicity(frame(spark, []), labels).count() == 0
    none = labels.where("doc_id < 0")
    assert {r.score for r in quality.classify_quality(frame(spark, [(1, "a b"), (2, None)]), none).collect()} == {0.5}
    assert all(r.score < 0.5 for r in toxicity.classify_toxicity(frame(spark, [(1, "a b"), (2, None)]), none).collect())


def test_prior_is_near_the_true_share():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, 2000)
    mixed = np.concatenate([rng.normal(2, 1, 1400), rng.normal(-2, 1, 600)])
    assert abs(quality.estimate_prior(positive, mixed) - 0.7) < 0.08


def test_windows_cover_every_word():
    piece = np.repeat([0, 1, 2], [5, 48, 131])
    owner, start, length = toxicity.windows_of(piece, 4)
    seen = {i for s, n in zip(start, length, strict=True) for i in range(s, s + n)}
    assert seen == set(range(184)) and set(owner) == {0, 1, 2}
    assert all(b - a <= toxicity.STRIDE for a, b in zip(start[owner == 2], start[owner == 2][1:], strict=False))


def test_gradients_agree_with_differences():
    texts = [b"alpha beta gamma delta", b"one two"]
    off = np.array([0, len(texts[0]), len(texts[0]) + len(texts[1])])
    w = toxicity.read_words(np.frombuffer(b"".join(texts), np.uint8), off)
    net = toxicity.Network(w.hashes.copy())
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, s, n = toxicity.windows_of(w.piece, 2)
    ids, mask = toxicity.gather(w, s, n)
    y = np.array([1.0, 0.0])

    def loss():
        z = net.run(net.project(net.inputs(w)), ids, mask)
        return float((np.log1p(np.exp(z)) - y * z).sum())

    keep: list = []
    x = net.inputs(w)
    z = net.run(net.project(x), ids, mask, keep)
    grads = net.backward(w, ids, mask, toxicity.sigmoid(z) - y, x, keep)
    for k in net.p:
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-4
        up = loss()
        net.p[k][at] = old - 1e-4
        assert abs(grads[k][at] - (up - loss()) / 2e-4) < 1e-3
        net.p[k][at] = old


def test_licences(spark):
    rows = [(1, "Released UNDER the MIT License. x Under The MIT-license"), (2, "Apache License, Version 2.0; cc by-nc"), (3, "cc by nc nd"), (4, "under the mit"), (5, "licensed under the GNU general public license, version 3")]
    got = {r.doc_id: r for r in scan_licenses(frame(spark, odd(rows))).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 1, 6, "mit")
    assert (got[2].n_words, got[2].n_base, got[2].base_labels) == (8, 2, "apache-2,cc-by-nc")
    assert (got[4].n_base, got[4].first_word, got[4].labels, got[4].score) == (0, None, "", 0.0)
    assert got[5].base_labels == "" and got[5].labels == "gpl-3"
    assert got[9001].n_words == got[9002].n_words == 0 and got[9003].n_words == 60_000
    assert scan_licenses(frame(spark, [])).count() == 0


def test_licence_plan_does_not_grow_with_the_templates(spark):
    many = [*TEMPLATES, *(Template(f"x{i}", f"terms of the number{i} licence as given below", f"number{i} licence") for i in range(300))]
    docs = frame(spark, [(1, "a. Terms of the NUMBER7 licence, as given below; number7 licence"), (2, "terms of number8"), (3, "x number9 licence")])
    few, lots = scan_licenses(docs), scan_licenses(docs, templates=many)
    nodes = [len(d._jdf.queryExecution().optimizedPlan().toString().splitlines()) for d in (few, lots)]
    assert nodes[0] == nodes[1]
    got = {r.doc_id: (r.n_base, r.labels, r.score) for r in lots.collect()}
    assert got[1] == (0, "x7", 1.0) and got[2] == (0, "", 0.0) and got[3][1] == ""


def plain_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held: dict[str, set] = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= min_chars:
                held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < min_docs or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_against_a_plain_version(spark):
    rng = random.Random(3)
    shared = [f"Shared line number {k} of more than forty characters É" for k in range(6)]
    rows = [(i, "\n".join(rng.choice([*shared, "short", f"own line {i} that is also rather long, really", "", "  " + shared[0].upper().replace("É", "É") + "\t"]) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    rows = odd(rows)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_report(frame(spark, rows)).collect()), key=str)
    assert got == plain_lines(rows)
    for share in (1, 12):  # no line is hot, some are
        hot = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_report(frame(spark, rows), spread=3, share=share).collect()), key=str)
        assert hot == got
    first = {r.doc_id: r.n_dropped for r in line_report(frame(spark, rows), keep="first").collect() if r.doc_id is not None}
    flipped = plain_lines([(None if i is None else -i, t) for i, t in rows])
    assert first == {-i: n for i, _, n, _ in flipped if i is not None}
    named = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, kept int, n_lines int, row int")
    assert dedup_lines(named).columns == named.columns and dedup_lines(named).agg({"row": "sum"}).first()[0] == 3 * len(rows)
    kept = dedup_lines(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "score", "source"] and kept.count() == len(rows)
    assert line_report(frame(spark, [])).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups_against_all_pairs(spark):
    rng = random.Random(5)
    base = ["w%d" % rng.randint(0, 10**6) for _ in range(400)]
    rows = [(i, " ".join(rng.choices([f"t{k}" for k in range(999)], k=30))) for i in range(30)]
    for i in range(30, 70):
        words = list(base)
        words[rng.randrange(400)] = f"edit{i % 12}"
        rows.append((i, " ".join(words)))
    rows = odd([*rows, (70, "Two Words"), (71, "two  words")])
    got = simhash.simhash_groups(frame(spark, rows), block=5).collect()
    assert len(got) == len(rows)
    fps = {r.doc_id: r.fp % (1 << 64) for r in got}
    assert all(fps[i] == plain_fingerprint(t) for i, t in rows)
    ids = [i for i, _ in rows if i is not None]
    root = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[a] == root[b] for a in ids for b in ids if (fps[a] ^ fps[b]).bit_count() <= 2):
            break
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == root
    assert simhash.simhash_groups(frame(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def infix_distance(item, text):
    """The least edit distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for k, x in enumerate(item):
        new = [k + 1]
        for j in range(1, len(row)):
            new.append(min(row[j - 1] + (text[j - 1] != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(7)
    items = [(k, " ".join(f"q{rng.randint(0, 500)}" for _ in range(rng.randint(12, 30)))) for k in range(12)]
    rows = []
    for i in range(60):
        words = [f"d{rng.randint(0, 300)}" for _ in range(20)]
        if i % 2:
            leak = rng.choice(items)[1].split()
            for _ in range(i % 5):
                leak[rng.randrange(len(leak))] = "edited"
            words[7:7] = leak
        rows.append((i, " ".join(words)))
    want = set()
    for i, t in rows:
        for k, x in items:
            w = x.split()
            if infix_distance(w, t.split()) <= int(0.2 * len(w)):
                want.add((i, k))
    bench = spark.createDataFrame([*items, (99, None), (98, "...")], "item_id long, text string")
    docs = frame(spark, odd(rows))
    got = {(r.doc_id, r.item_id): r for r in dc.contamination(docs, bench).collect()}
    assert len(want & set(got)) >= 0.97 * len(want) and set(got) <= want
    left = dc.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, _ in odd(rows)} - {i for i, _ in got}
    assert dc.contamination(frame(spark, []), bench).count() == 0
    assert dc.contamination(docs, bench.where("item_id > 97")).count() == 0


def test_sweep_gives_the_walk_of_every_window():
    rng = np.random.default_rng(4)
    text = np.append(rng.integers(1, 1 << 62, 700).astype(np.uint64), np.uint64(0))
    bits = dc.walk_bits(text, 2)
    got = dc.sweep(bits, 701, [0, 3, 17, 46])
    for s in range(701):
        at = s
        for j in range(47):
            if j in got:
                assert got[j][0][got[j][1][s]] == at
            at += int(bits[at]) >> j & 1


def test_decontamination_recall_at_the_allowed_edits():
    rng = np.random.default_rng(8)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [" ".join(rng.choice(vocabulary, n)) for n in (*rng.integers(1, 70, 150), 400, 900)]
    index = dc.build_index(list(range(len(items))), items)
    assert min(index.recall.values()) >= 0.97
    exact = [f"{' '.join(rng.choice(vocabulary, 30))} {x} {' '.join(rng.choice(vocabulary, 30))}" for x in items]
    assert {(d, i) for d, i, *_ in dc.find_leaks(index, pa.array(exact))} >= {(i, i) for i in range(len(items))}
    hit = 0
    for _ in range(4):
        texts = []
        for x in items:
            words = np.array([int(w[1:]) for w in x.split()], np.uint64)
            edited = dc._edited(words, int(0.2 * len(words)), rng)
            texts.append(" ".join(rng.choice(vocabulary, 50)) + " " + " ".join(f"v{w}" for w in edited) + " " + " ".join(rng.choice(vocabulary, 50)))
        hit += len({(d, i) for d, i, *_ in dc.find_leaks(index, pa.array(texts))} & {(i, i) for i in range(len(items))})
    assert hit >= 0.95 * 4 * len(items)


def test_a_long_item_costs_no_other_item_memory():
    items = [f"a{i} b{i * 7} c{i % 91} d e{i} f g{i}" for i in range(3000)] + [" ".join(f"w{i}" for i in range(12_000))]
    index = dc.build_index(list(range(len(items))), items)
    assert max(len(p) for c in index.classes for p in c.parts) <= dc.PART
    text = " ".join(f"w{i}" for i in range(11_500)) + " and more"
    assert [(d, i, s, n) for d, i, s, n, *_ in dc.find_leaks(index, pa.array(["x", text]))] == [(1, 3000, 0, 11_500)]


def test_packing(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(9)
    texts = ["it's  two   blanks\n\n\tand 12 tabs é日本 　x", " lead", "trail ", "<|endoftext|> a", "a <|endoftext|> b", "don't!! $$$ x%%%", "a\xa0b c"]
    rows = odd([(i, t) for i, t in enumerate(texts)] + [(100 + i, " ".join(rng.choices(["alpha", "Béta,", "gamma.\nx", "d!"], k=rng.randint(1, 4000)))) for i in range(40)])
    got = packing.pack_documents(frame(spark, rows), path).collect()
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    want: dict = {}
    for i, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for s, n in packing.cut(len(ids), 2048):
            want.setdefault(i, []).append((s, n, zlib.crc32(ids[s : s + n].tobytes())))
    assert {k: sorted((r.start, r.length, r.ids_crc32) for r in v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    seqs: dict = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(seqs) <= -(-total // 2048) + 3
    assert packing.pack_documents(frame(spark, []), path).count() == 0


def test_plan_uses_exact_complements():
    plan = packing.plan_packing({7: 2, 3: 2, 5: 3, 2: 1, 1: 1}, 10)
    assert sum(t for _, t in plan) == 4  # 40 tokens less 2 in four sequences of 10
    used: dict = {}
    for pattern, times in plan:
        assert sum(pattern) <= 10
        for n in pattern:
            used[n] = used.get(n, 0) + times
    assert used == {7: 2, 3: 2, 5: 3, 2: 1, 1: 1}


def plain_complement(free, total, beside):
    lengths = [n for n, c in free.items() if c > 0 and n <= total]
    for k in (1, 2, 3):
        for extra in sorted(itertools.combinations_with_replacement(sorted(lengths, reverse=True), k), reverse=True):
            if sum(extra) == total and all(free[n] >= (beside + extra).count(n) for n in extra):
                return extra
    return None


def test_sum_index_finds_every_complement():
    rng = random.Random(2)
    for _ in range(150):
        free = {n: rng.randint(1, 3) for n in rng.sample(range(1, 30), rng.randint(1, 12))}
        index = packing.SumIndex(free, 40)
        for _ in range(6):
            total, beside = rng.randint(1, 40), tuple(rng.choices(sorted(free), k=rng.randint(0, 4)))
            assert index.complement(total, beside) == plain_complement(free, total, beside)
            spent = rng.choice(sorted(free))
            if free[spent]:
                free[spent] -= 1
                index.take((spent,), 1)


def test_plan_of_many_lengths_reaches_the_lower_bound():
    rng = np.random.default_rng(6)
    n, c = np.unique(np.clip(rng.lognormal(5.5, 1, 100_000).astype(int), 1, 2048), return_counts=True)
    counts = dict(zip(n.tolist(), c.tolist(), strict=True))
    plan = packing.plan_packing(counts, 2048)
    assert sum(t for _, t in plan) <= -(-int((n * c).sum()) // 2048) + 1
    used = np.zeros(2049, int)
    for pattern, times in plan:
        assert sum(pattern) <= 2048
        np.add.at(used, list(pattern), times)
    assert all(used[k] == v for k, v in counts.items()) and used.sum() == 100_000
