"""Near copies against a plain version on planted edits."""

from __future__ import annotations

import random
from math import comb

import numpy as np
import pytest

from spanloom.llm import near_copies as module
from spanloom.llm.near_copies import BITS, RADII, RADIUS, WORDS, bucket_links, fingerprint_links, near_copies, set_fingerprints, shingle_sets, sifted, table_count


def plain_set(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def plain_groups(texts, similarity=0.8):
    """The smallest index reachable from each text over pairs of the Jaccard similarity."""
    sets = [plain_set(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if group[i] != group[j] and (not union or len(sets[i] & sets[j]) >= similarity * union):
                lo, hi = sorted((group[i], group[j]))
                group = [lo if g == hi else g for g in group]
    return group


def planted(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = ["", None, " \n", "one two", "One  two", "one two three"]
    for _ in range(60):
        base = [word() for _ in range(rng.choice([40, 100, 300, 900]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(max(1, int(len(base) * rng.choice([0.005, 0.01, 0.02, 0.03])))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return texts


def test_near_copies_match_the_plain_groups(spark):
    texts = planted()
    df = spark.createDataFrame([*enumerate(texts), (None, texts[10])], "doc_id long, text string")
    of: dict = {}
    for r in near_copies(df).collect():
        of.setdefault(r.root, []).append(r.doc_id)
    got = {d: min(g) for g in of.values() for d in g}
    want = plain_groups(texts)
    assert len(set(want)) < 0.6 * len(texts) and [got[i] for i in range(len(texts))] == want
    assert near_copies(df.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("block", [4_000_000, 5_000])
def test_loose_group_is_compared_throughout(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK", block)
    rng = random.Random(9)
    base = [str(rng.randrange(10**6)) for _ in range(120)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            copy[rng.randrange(len(copy))] = str(rng.randrange(10**6))
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of: dict = {}
    for r in near_copies(df).collect():
        of.setdefault(r.root, []).append(r.doc_id)
    got = {d: min(g) for g in of.values() for d in g}
    assert [got[i] for i in range(len(texts))] == plain_groups(texts)


def test_pipeline_stage_drops_copies_of_jaccard_above_threshold(spark):
    import corpus_pipeline

    texts = planted(4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == sorted(set(plain_groups(texts)))


def test_pipeline_stage_drops_rows_not_ids(spark):
    import corpus_pipeline

    rng = random.Random(5)
    a, b, c = (" ".join(str(rng.randrange(10**6)) for _ in range(60)) for _ in range(3))
    rows = [(1, a, "z"), (1, a, "y"), (1, a, "y"), (2, a, "x"), (2, b, "w"), (3, c, "v"), (None, a, "u"), (None, a, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, df, "").collect()), key=str)
    assert got == sorted([(1, a, "y"), (2, b, "w"), (3, c, "v"), (None, a, "u"), (None, a, "u")], key=str)


def chance_of_bit(common, a, b):
    """The probability that a fingerprint bit differs between sets of `common` shared hashes, a and b others."""
    p, out = lambda n, k: comb(n, k) / 2**n, 0.0
    for k in range(common + 1):
        left = sum(p(a, i) for i in range(a + 1) if 2 * (k + i) > common + a)
        right = sum(p(b, i) for i in range(b + 1) if 2 * (k + i) > common + b)
        out += p(common, k) * (left * (1 - right) + right * (1 - left))
    return out


def test_the_radius_loses_less_than_one_pair_in_a_million():
    worst = max(chance_of_bit(c, a, u - a) for c in range(4, 130) for u in [c // 4] for a in range(u + 1))
    missed = sum(comb(64, k) * worst**k * (1 - worst) ** (64 - k) for k in range(RADIUS + 1, 65))
    assert missed < 1e-6, (worst, missed)


def test_set_fingerprints_match_plain_counts():
    import pyarrow as pa

    texts = pa.array(["", "one two", " ".join(map(str, range(300))), "a b c d e f a b c d e"])
    owner, h = shingle_sets(texts)
    got = set_fingerprints(owner, h, len(texts)).view("u8")
    for i in range(len(texts)):
        own = [int(x) for x in h[owner == i]]
        assert int(got[i]) == sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in own) > len(own))


def flipped(rng, fp, n):
    """The fingerprints, each with n other bits flipped."""
    bits = np.zeros((len(fp), BITS), np.uint8)
    for row in bits:
        row[rng.permutation(BITS)[:n]] = 1
    return fp ^ np.packbits(bits, axis=1, bitorder="little").view("<u8")


def plain_near(fp):
    """Which fingerprints are within all radii."""
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little").astype(int)
    return np.logical_and.reduce([(bits[:, None, :b] != bits[None, :, :b]).sum(2) <= r for b, r in RADII.items()])


def plain_roots(m, a, b):
    root = list(range(m))
    for x, y in zip(a, b, strict=True):
        lo, hi = sorted((root[x], root[y]))
        root = [lo if r == hi else r for r in root]
    return root


@pytest.mark.parametrize("large", [4096, 30])
def test_bucket_links_match_plain_distances(monkeypatch, large):
    monkeypatch.setattr(module, "LARGE", large)
    rng = np.random.default_rng(2)
    for m in (0, 1, 2, 63, 64, 65, 200):
        base = rng.integers(0, 1 << 64, (m // 5 + 1, WORDS), np.uint64)
        fp = flipped(rng, base[rng.integers(0, len(base), m)], 38)  # 76 of 256 bits between two, less the common ones
        near = plain_near(fp) if m else np.zeros((0, 0), bool)
        assert m < 60 or near.sum() > 2 * m
        a, b = bucket_links(fp)
        assert len(a) < max(m, 1) and plain_roots(m, a, b) == plain_roots(m, *np.nonzero(near))


def test_fingerprints_alone_form_the_blocks(spark):
    """Rows that have nothing but fingerprints are linked by them, over buckets of equal bits."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 64, (300, WORDS), np.uint64)
    fp = np.concatenate((base, flipped(rng, base, 39), flipped(rng, base[:100], 110))).view(np.int64)
    nodes = spark.createDataFrame([(i, 100, *map(int, x)) for i, x in enumerate(fp)], "sid long, n long, " + ", ".join(f"f{w} long" for w in range(WORDS)))
    for count in (1, 30_000):  # one bucket, and 27 tables keyed by five bits and more
        got = {(min(r), max(r)) for r in fingerprint_links(nodes, count).collect()}
        assert got == {(i, i + 300) for i in range(300)}


def test_many_buckets_find_the_plain_groups(spark, monkeypatch):
    monkeypatch.setattr(module, "BUCKET", 8)
    texts = planted(6)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of: dict = {}
    for r in near_copies(df).collect():
        of.setdefault(r.root, []).append(r.doc_id)
    got = {d: min(g) for g in of.values() for d in g}
    assert [got[i] for i in range(len(texts))] == plain_groups(texts)


def test_tables_miss_few_pairs_of_any_size():
    assert max(chance_of_bit(c, a, c // 4 - a) for c in range(5, 60) for a in range(c // 4 + 1)) < module.CHANCE
    assert max(chance_of_bit(4, a, 1 - a) for a in (0, 1)) <= module.CHANCE_SMALL
    assert table_count(0, 0.2) == 1
    rng = np.random.default_rng(8)
    tables = table_count(4, module.CHANCE)
    missed = (1 - sum(comb(BITS, d) * module.CHANCE**d * (1 - module.CHANCE) ** (BITS - d) * (comb(BITS - d, 4) / comb(BITS, 4)) for d in range(BITS + 1))) ** tables
    apart = rng.random((2000, BITS)) < module.CHANCE
    hits = sum(~apart[:, rng.permutation(BITS)[:4]].any(1) for _ in range(tables))
    assert missed < 7e-5 and (hits == 0).sum() <= 2


def test_further_words_are_fingerprints_of_scrambled_hashes():
    import pyarrow as pa

    texts = pa.array(["", "one two", " ".join(map(str, range(70_000))), "a b c d e f"])
    owner, h = shingle_sets(texts)
    words = [set_fingerprints(owner, h, len(texts), w).view("u8") for w in range(WORDS)]
    assert all(w[0] == 0 for w in words) and len({int(w[2]) for w in words}) == WORDS
    own = h[owner == 2]
    assert int(words[0][2]) == sum(1 << b for b in range(64) if 2 * int(((own >> np.uint64(b)) & np.uint64(1)).sum()) > len(own))


def test_sifted_keeps_every_row_that_a_join_finds(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "id % 7 as word", "id * 3 as held").unionByName(spark.sql("select cast(null as long) as doc_id, 1L as word, 2L as held"))
    for n in (0, 1, 400):
        keys = spark.range(n).selectExpr("id * 10 as doc_id")
        got = sifted(rows, keys, ["doc_id"], "maybe")
        assert got.columns == ["doc_id", "word", "held", "maybe"] and got.count() == 5001
        assert got.where("not maybe").join(keys, "doc_id").count() == 0
        assert got.where("maybe").join(keys, "doc_id").count() == n and got.where("maybe").count() < n + 1500
