"""Near copies by SimHash at the wide radius that a Jaccard similarity of word shingles needs: buckets of equal
fingerprint bits, bit-sliced comparison in them, connected groups, and whole shingle sets that decide within a group.

Sets of Jaccard 0.8 differ in 15 % of their fingerprint bits, too far for 64 bits to tell them from unlike ones and for
the equal quarters of a small radius. So fingerprints have 256 bits, and a bucket is formed by some bits picked at random,
as many as keep buckets small, over as many tables as let a pair of similarity 0.8 miss all of them with a probability of
at most MISS. A small table is one bucket, compared throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import LOWER, arrow_limits, fresh, lookup, materialize, mix, run_hashes, text_blocks, text_column, tidy, words_of
from spanloom.llm.components import connected_components
from spanloom.llm.simhash import _exceeds, members_of

#: 64-bit words of a fingerprint, and all its bits.
WORDS = 4
BITS = 64 * WORDS
_FP = [f"f{w}" for w in range(WORDS)]
#: The most that one bit's chance to differ is at Jaccard 0.8: for sets of 4 and 5 shingles, and for all larger ones.
SMALL, CHANCE_SMALL, CHANCE = 5, 0.1875, 0.1612
#: A pair of Jaccard 0.8 meets in no table with at most this probability.
MISS = 7e-5
#: Fingerprints of a table that are one bucket, more or less.
BUCKET = 1024
#: Shingles of one group that one task compares; larger groups are compared block by block.
BLOCK = 4_000_000
#: Cells (a query against 64 members) that are compared at a time, and members from which groups are grown one by one.
CELLS, LARGE = 1 << 14, 4096


def _differing(bits: int, chance: float) -> np.ndarray:
    """The probabilities of 0, 1, ... differing bits."""
    return np.array([comb(bits, d) * chance**d * (1 - chance) ** (bits - d) for d in range(bits + 1)])


#: After so many bits: the most that may differ. A pair of Jaccard 0.8 exceeds one with a probability below 1e-6.
RADII = {b: int(np.flatnonzero(_differing(b, CHANCE_SMALL)[::-1].cumsum()[::-1] < 1e-6)[0]) - 1 for b in range(64, BITS + 1, 32)}
#: The radius of the first 64 bits.
RADIUS = RADII[64]
#: True for all bytes but ASCII blanks.
_DARK = ~np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def shingle_sets(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct runs of `width` words of whole texts, sorted; words are cut at ASCII blanks, A-Z in
    lower case. A text of fewer words is one run, one without words has none."""
    texts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for docs, data, off in text_blocks(column):
        w, s, e = words_of(data, off, _DARK)
        texts.append(docs[w])
        hashes.append(run_hashes(LOWER[data], s, e))
    owner, h = np.concatenate(texts), np.concatenate(hashes)
    first = np.searchsorted(owner, np.arange(len(column) + 1))
    count = np.diff(first)
    whose, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for k in range(1, width + 1):
        at = first[:-1][count == k] if k < width else np.flatnonzero(owner[: max(len(h) - width + 1, 0)] == owner[width - 1 :])
        run = np.full(len(at), k, np.uint64)
        for i in range(k):
            run = mix(run) + h[at + i]
        whose.append(owner[at])
        found.append(mix(run))
    owner, h = np.concatenate(whose), np.concatenate(found)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[new], h[new]


def _set_ids(owner: np.ndarray, h: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, size) of the set of each text; 0, 0 of an empty one."""
    first = np.searchsorted(owner, np.arange(texts + 1))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h), dtype=np.uint64)))
    n = np.diff(first)
    return np.where(n > 0, mix(total[first[1:]] - total[first[:-1]]), np.uint64(0)).view(np.int64), n


def set_fingerprints(owner: np.ndarray, h: np.ndarray, texts: int, word: int = 0) -> np.ndarray:
    """One word of the SimHash of the set of each text: a bit is 1 if set in over half of the hashes, which are scrambled
    anew for each further word; 0 of an empty set."""
    n = np.bincount(owner, minlength=texts)
    out = np.zeros(texts, np.uint64)
    if len(h):
        h = mix(h ^ np.uint64(0x9E3779B97F4A7C15 * word % (1 << 64))) if word else h
        at = np.arange(len(h)) - (np.cumsum(n) - n)[owner]
        parts = np.flatnonzero(at % 65535 == 0)  # sums of 16-bit lanes do not overflow
        full = np.flatnonzero(n)
        whole = np.searchsorted(owner[parts], full)
        for shift in range(16):
            lanes = np.add.reduceat((h >> np.uint64(shift)) & np.uint64(0x0001000100010001), parts)
            for lane in range(0, 64, 16):
                ones = np.add.reduceat((lanes >> np.uint64(lane)) & np.uint64(0xFFFF), whole)
                out[full] |= (2 * ones > n[full].astype(np.uint64)).astype(np.uint64) << np.uint64(lane + shift)
    return out.view(np.int64)


def signatures(documents: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, tid (a hash of the text), sid (a hash of its set of shingles), n (the set's size), f0, f1, ... (the words of
    its SimHash) of each row."""
    arrow_limits(documents.sparkSession)
    names = ["doc_id", "tid", "sid", "n", *_FP]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, h = shingle_sets(b.column("text"), width)
            sid, n = _set_ids(owner, h, b.num_rows)
            fp = [pa.array(set_fingerprints(owner, h, b.num_rows, w)) for w in range(WORDS)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tid"), pa.array(sid), pa.array(n.astype(np.int64)), *fp], names)

    text = text_column()
    return documents.select("doc_id", F.xxhash64(text).alias("tid"), text.alias("text")).mapInArrow(tidy(run), ", ".join(f"{x} long" for x in names))


def table_count(bits: int, chance: float) -> int:
    """Tables, each keyed by `bits` of the fingerprint's bits, so that a pair whose bits differ with this chance meets in
    none of them with at most MISS."""
    weight = _differing(BITS, chance)
    apart = np.array([1 - comb(BITS - d, bits) / comb(BITS, bits) for d in range(BITS + 1)])
    tables, missed = 1, apart.copy()
    while bits and (weight * missed).sum() > MISS:
        tables, missed = tables + 1, missed * apart
    return tables


def key_bits(nodes: int) -> int:
    """Bits of a key: buckets of about BUCKET fingerprints; beyond a quarter of a million, more in each, as further tables
    cost more than their comparison."""
    k = log2(max(nodes, 1) / BUCKET)
    return max(0, ceil(k if k <= 8 else 8 + 0.65 * (k - 8)))


def _planes(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of fingerprints (uint64[member, word]) as uint8[bit, member], and as planes uint64[bit, row] with member j
    in bit j % 64 of row j // 64."""
    bits = np.ascontiguousarray(np.unpackbits(np.ascontiguousarray(fp, "<u8").view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little").T)
    padded = np.zeros((len(bits), -(-len(fp) // 64) * 64), np.uint8)
    padded[:, : len(fp)] = bits
    return bits, np.packbits(padded, axis=1, bitorder="little").view("<u8")


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry and sum of three bits each."""
    u = a ^ b
    return (a & b) | (u & c), u ^ c


def _near(bits: np.ndarray, planes: np.ndarray, q: np.ndarray, w: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of each cell, query q against the members `left` of row w, those within RADII, as bits of a word. Distances are
    counted by a tree of carry-save adders over eight planes at a time; cells where all are too far are abandoned."""
    out = np.zeros(len(q), np.uint64)
    cell = np.arange(len(q))
    depth = max(RADII.values()).bit_length()
    c = [np.zeros(len(q), np.uint64) for _ in range(depth)]
    over = np.zeros(len(q), np.uint64)
    for at in range(0, BITS, 8):
        x = [planes[i][w] ^ (np.uint64(0) - bits[i].astype(np.uint64))[q] for i in range(at, at + 8)]
        two, c[0] = _add(c[0], x[0], x[1])
        twos, c[0] = _add(c[0], x[2], x[3])
        four, c[1] = _add(c[1], two, twos)
        two, c[0] = _add(c[0], x[4], x[5])
        twos, c[0] = _add(c[0], x[6], x[7])
        fours, c[1] = _add(c[1], two, twos)
        carry, c[2] = _add(c[2], four, fours)
        for k in range(3, depth):
            c[k], carry = c[k] ^ carry, c[k] & carry
        over |= carry
        if at + 8 in RADII:
            left = left & ~(over | _exceeds(c, RADII[at + 8]))
            go = left != 0
            if at + 8 == BITS:
                out[cell] = left
            elif not go.any():
                break
            elif not go.all():
                cell, q, w, left, over, c = cell[go], q[go], w[go], left[go], over[go], [x[go] for x in c]
    return out


def _pairs_of(q: np.ndarray, w: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) of all bits set."""
    cell = members_of(hit)
    return q[cell // 64], w[cell // 64] * 64 + cell % 64


def _stars(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of m members that each reaches over the links (a, b)."""
    root = np.arange(m)
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (further := root[root] != root).any():
            root[further] = root[root[further]]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _grown(fp: np.ndarray) -> np.ndarray:
    """Which members the first one reaches; each one reached is compared with those not reached yet."""
    reached = np.zeros(len(fp), bool)
    reached[0] = True
    front = np.zeros(1, np.int64)
    while len(front) and not reached.all():
        rest = np.flatnonzero(~reached)
        rows = -(-len(rest) // 64)
        now, front = np.split(front, [max(1, min(len(front), CELLS // rows))])
        bits, planes = _planes(np.concatenate((fp[rest], np.zeros((rows * 64 - len(rest), fp.shape[1]), np.uint64), fp[now])))
        q, w = np.repeat(np.arange(len(now)) + rows * 64, rows), np.tile(np.arange(rows), len(now))
        alive = np.full(rows, ~np.uint64(0))
        if len(rest) % 64:
            alive[-1] = (np.uint64(1) << np.uint64(len(rest) % 64)) - np.uint64(1)
        hit = np.bitwise_or.reduce(_near(bits, planes, q, w, alive[w]).reshape(len(now), rows), axis=0)
        new = rest[members_of(hit)]
        reached[new] = True
        front = np.concatenate((front, new))
    return reached


def bucket_links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between members of one bucket (uint64[member, word]) that span every group within RADII, one for each member
    but the group's first."""
    pool, found = np.arange(len(fp)), []
    while len(pool) > LARGE:  # large groups of copies first, in a time that grows with rows
        reached = _grown(fp[pool])
        group, pool = pool[reached], pool[~reached]
        found.append((np.full(len(group) - 1, group[0]), group[1:]))
        if len(group) * 16 < len(pool):
            break
    m = len(pool)
    if m > 1:
        bits, planes = _planes(fp[pool])
        rows = planes.shape[1]
        many = rows - np.arange(m) // 64  # rows of later members
        ends = np.cumsum(many)
        last = ~np.uint64(0) if m % 64 == 0 else (np.uint64(1) << np.uint64(m % 64)) - np.uint64(1)
        root, at = np.arange(m), 0
        while at < m:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - many[at] + CELLS, "right")))
            q = np.repeat(np.arange(at, to), many[at:to])
            w = np.arange(len(q)) - np.repeat(ends[at:to] - many[at:to] - (ends[at] - many[at]), many[at:to]) + q // 64
            left = np.where(w == rows - 1, last, ~np.uint64(0))
            own = w == q // 64
            left[own] &= ~((np.uint64(2) << (q[own] % 64).astype(np.uint64)) - np.uint64(1))
            a, b = _pairs_of(q, w, _near(bits, planes, q, w, left))
            if len(a):
                root = _stars(m, np.concatenate((np.arange(m), a)), np.concatenate((root, b)))
            at = to
        later = np.flatnonzero(root != np.arange(m))
        found.append((pool[root[later]], pool[later]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(a for a, _ in found)]), np.concatenate([none, *(b for _, b in found)])


def fingerprint_links(nodes: DataFrame, count: int) -> DataFrame:
    """Links (a, b) among the sets sid of `count` nodes with n and fingerprints f0, f1, ...: of each bucket of fingerprints
    that agree in a table's picked bits, enough to span its groups within RADII. Sets without shingles are in none."""
    k = key_bits(count)
    tables, small = table_count(k, CHANCE), table_count(k, CHANCE_SMALL)
    rng = np.random.default_rng(17)
    picks = [np.sort(rng.permutation(BITS)[:k]) for _ in range(max(tables, small))]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = _bits_of(b)
            key = np.empty((b.num_rows, len(picks)), np.int64)
            for t, pick in enumerate(picks):
                key[:, t] = (bits[:, pick].astype(np.int64) << np.arange(k)).sum(1) + (t << k)
            held = np.arange(len(picks)) < np.where(b.column("n").to_numpy() <= SMALL, small, tables)[:, None]
            ends = np.concatenate(([0], np.cumsum(held.sum(1)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("sid"), *(b.column(f) for f in _FP), pa.ListArray.from_arrays(pa.array(ends), pa.array(key[held]))], ["sid", *_FP, "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: pa.Table, end: bool) -> tuple[pa.RecordBatch, pa.Table]:
            key, sid = rows.column("key").to_numpy(), rows.column("sid").to_numpy()
            fp = np.stack([rows.column(f).to_numpy() for f in _FP], 1).view(np.uint64)
            at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            a, b = [], []
            for s, e in zip(at, [*at[1:], *([len(key)] if end else [])], strict=False):  # the last one may go on
                if e - s > 1:
                    x, y = bucket_links(fp[s:e])
                    a.append(sid[s:e][x])
                    b.append(sid[s:e][y])
            none = np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x])) for x in (a, b)], ["a", "b"]), rows.slice(at[-1])

        held, need = [], CELLS
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(x.num_rows for x in held) >= need:
                out, rest = links(pa.concat_tables(held), False)
                yield out
                held, need = [rest], 2 * rest.num_rows + CELLS
        if sum(x.num_rows for x in held):
            yield links(pa.concat_tables(held), True)[0]

    fp = ", ".join(f"{f} long" for f in _FP)
    arrow_limits(nodes.sparkSession)
    keyed = nodes.where("n > 0").select("sid", "n", *_FP).mapInArrow(tidy(keys), f"sid long, {fp}, keys array<long>")
    keyed = keyed.select(F.explode("keys").alias("key"), "sid", *_FP).repartition("key").sortWithinPartitions("key", "sid")  # stars with few centres
    return keyed.mapInArrow(tidy(run), "a long, b long")


def _bits_of(batch: pa.RecordBatch) -> np.ndarray:
    """uint8[row, bit] of the fingerprints."""
    fp = np.stack([batch.column(f).to_numpy() for f in _FP], 1).astype("<i8")
    return np.unpackbits(fp.view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")


def _sets(documents: DataFrame, width: int) -> DataFrame:
    """sid, shingles (sorted hashes) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, h = shingle_sets(b.column("text"), width)
            sid, _ = _set_ids(owner, h, b.num_rows)
            ends = np.searchsorted(owner, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(sid), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], ["sid", "shingles"])

    return documents.select(text_column().alias("text")).mapInArrow(tidy(run), "sid long, shingles array<long>")


def _set_links(placed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of at least the Jaccard similarity among the members sid, of n shingles, of each group root, thinned to
    a forest for each two parts.

    Groups of more than BLOCK shingles are split by a hash into parts, and each pair of parts is compared by itself. Each
    member that nothing is linked to yet is compared with all others left so, and then what was linked with all that are
    not connected to it: a large group of copies costs rows, not pairs, and no pair is left out.
    """
    size = placed.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts"))
    member = placed.join(size, "root").withColumn("mine", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    tasks = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = tasks.select("root", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "sid")

    def run(table: pa.Table) -> pa.Table:
        mine, sid = table.column("mine").to_numpy(), table.column("sid").to_numpy()
        lists = table.column("shingles").combine_chunks()
        _, codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        size = lists.value_lengths().to_numpy().astype(np.int64)
        starts = np.cumsum(size) - size
        whole = table.column("p")[0] == table.column("q")[0]
        flag = np.zeros(len(codes), np.int32)
        group, found = np.arange(len(sid)), []

        def link(i: int, others: np.ndarray) -> np.ndarray:
            """Those of the others that are similar to i, connected with it from now on."""
            near = others[np.minimum(size[others], size[i]) >= similarity * np.maximum(size[others], size[i])]
            if not len(near):
                return near
            n = size[near]
            begin = np.cumsum(n) - n
            own = codes[starts[i] : starts[i] + size[i]]
            flag[own] = 1
            common = np.add.reduceat(flag[codes[np.repeat(starts[near] - begin, n) + np.arange(n.sum())]], begin)
            flag[own] = 0
            near = near[common >= similarity * (size[i] + n - common)]
            for j in near:
                if group[i] != group[j]:
                    group[group == group[j]] = group[i]
                    found.append((sid[i], sid[j]))
            return near

        waits, first = np.ones(len(sid), bool), np.ones(len(sid), bool)
        for i in range(len(sid)):
            if waits[i]:
                waits[i] = False
                linked = link(i, np.flatnonzero(waits))
                waits[linked] = first[linked] = False
        hub = np.bincount(group).argmax()
        rest = min(np.flatnonzero(~first), np.flatnonzero(group != hub), key=len)
        for i in rest:
            link(i, np.flatnonzero((group != group[i]) & (whole | (mine != mine[i]))))
        return pa.table([pa.array([int(x[k]) for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return tasks.join(sets, "sid").groupBy("root", "p", "q").applyInArrow(run, "a long, b long")


def sifted(rows: DataFrame, keys: DataFrame, columns: list[str], name: str) -> DataFrame:
    """rows with a further column `name`: false only where the row's values of the columns are no row of `keys`, and true
    for about one in nine others, so that a join need not shuffle all texts. Bits of hashes (eight for each key, 2 MB of
    them at most) are broadcast."""
    words = 1 << min(18, max(0, ceil(log2(max(keys.count(), 1) / 8))))
    word, held = fresh(rows.columns, "word"), fresh(rows.columns, "held")
    place = F.xxhash64(*columns)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    at = F.pmod(F.shiftright(place, 6), F.lit(words)).alias(word)
    table = keys.select(at, bit.alias(held)).groupBy(word).agg(F.bit_or(held).alias(held))
    marked = rows.withColumn(word, at).join(F.broadcast(table), word, "left")
    return marked.select(*rows.columns, F.coalesce(F.col(held).bitwiseAND(bit) != 0, F.lit(False)).alias(name))


def near_copies(documents: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, tid, sid, root of each row that has a doc_id: rows of one root are reachable over pairs whose shingle sets
    have a Jaccard similarity of at least `similarity` (0.8 or more), among the groups that fingerprints within RADII form.

    Texts with one set are one node. Texts without words are copies of each other.
    """
    if similarity < 0.8:
        raise ValueError("radii and tables are those of a similarity of 0.8")
    documents = documents.where("doc_id is not null")
    rows = materialize(signatures(documents, width), "signatures")
    nodes = rows.groupBy("sid").agg(F.min(F.struct("doc_id", "tid")).alias("least"), *(F.first(x).alias(x) for x in ("n", *_FP)), F.count("*").alias("rows"))
    nodes = materialize(nodes, "nodes")
    groups = materialize(connected_components(fingerprint_links(nodes, nodes.count())), "near-classes")
    placed = materialize(nodes.join(groups, F.col("sid") == F.col("node")).select("root", "sid", "n", "least"), "placed")
    needed = materialize(placed.select("least.doc_id", "least.tid"), "needed")
    bodies = documents.select("doc_id", F.xxhash64(text_column()).alias("tid"), "text")
    bodies = sifted(bodies, needed, ["doc_id", "tid"], "maybe").where("maybe").join(needed, ["doc_id", "tid"], "left_semi")
    sets = materialize(_sets(bodies, width).dropDuplicates(["sid"]), "sets")
    roots = connected_components(materialize(_set_links(placed.drop("least"), sets, similarity), "near-links"))
    whole = nodes.select("sid", "rows").join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "rows", F.coalesce("root", "sid").alias("root"))
    return lookup(rows, materialize(whole, "near-roots"), ["sid"], "rows").select("doc_id", "tid", "sid", "root")
