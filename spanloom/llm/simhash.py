"""Near-duplicate documents by SimHash fingerprints, compared in bit-sliced form.

Distinct fingerprints meet where they agree in two of four 16-bit quarters, which any two within three bits do. Within
such a bucket the fingerprints are stored as vertical bit planes, and one fingerprint's distances to all of them are
counted at once with carry-save counters, a bit plane at a time; a block is left when all in it exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import arrow_limits, lookup, materialize, text_column, tidy
from spanloom.llm.components import connected_components

_SEED = 42
#: Shingle hashes that are unpacked to bits at a time.
_CHUNK = 1 << 15
#: Bits of each byte value, and where each of eight bytes' counts begin.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_SHIFT = np.arange(0, 2048, 256)
_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]
#: Members of one bucket that one task compares; larger buckets are compared block by block.
BLOCK = 4096


def fingerprint(text: str, width: int = 3) -> int:
    """The fingerprint of a whole text, 0 where it has no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, _SEED) for s in shingles), np.uint64)
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i : i + _CHUNK]
        octets = part.astype("<u8").view(np.uint8).reshape(-1, 8) + _SHIFT
        count += (np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row; null texts count as empty."""
    arrow_limits(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return documents.select("doc_id", text_column().alias("text")).mapInArrow(tidy(run), "doc_id long, fp long")


def _planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes of rows of up to 64 fingerprints each: uint64[bit, row], member j in bit j."""
    rows, members = fp.shape
    out = np.zeros((64, rows), np.uint64)
    for j in range(members):
        bits = np.unpackbits(fp[:, j].astype("<u8").view(np.uint8).reshape(rows, 8), axis=1, bitorder="little")
        out |= bits.T.astype(np.uint64) << np.uint64(j)
    return out


def bit_planes(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of any number of fingerprints, 64 in a row, and the members of each row as bits of a word."""
    pad = (-len(fp)) % 64
    rows = np.concatenate([fp, np.zeros(pad, np.uint64)]).reshape(-1, 64)
    alive = np.full(len(rows), ~np.uint64(0))
    if pad:
        alive[-1] = (np.uint64(1) << np.uint64(64 - pad)) - np.uint64(1)
    return _planes(rows), alive


def members_of(hit: np.ndarray) -> np.ndarray:
    """The numbers of the members whose bits are set."""
    rows = np.flatnonzero(hit)
    at, bit = np.nonzero(np.unpackbits(hit[rows].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return rows[at] * 64 + bit


def within(planes: np.ndarray, query: np.ndarray, radius: int, alive: np.ndarray) -> np.ndarray:
    """Per row, the members (bits of a word) at most `radius` bits from that row's query, by carry-save counters:
    counters[k] holds bit k of all distances so far. Rows where all have exceeded the radius are abandoned."""
    n_counters = max(1, radius.bit_length())
    rows = np.arange(planes.shape[1])
    counters = [np.zeros(len(rows), np.uint64) for _ in range(n_counters)]
    over = np.zeros(len(rows), np.uint64)
    out = np.zeros(len(rows), np.uint64)
    full = alive.copy()
    for bit in range(64):
        flip = np.uint64(0) - ((query >> np.uint64(bit)) & np.uint64(1))
        carry = planes[bit][rows] ^ flip if len(rows) < planes.shape[1] else planes[bit] ^ flip
        for k in range(n_counters):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if bit % 8 == 7:
            left = ~(over | _exceeds(counters, radius)) & full
            go = left != 0
            if bit == 63:
                out[rows] = left
            elif not go.all():
                if not go.any():
                    return out
                rows, query, full, over = rows[go], query[go], full[go], over[go]
                counters = [c[go] for c in counters]
    return out


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the counters' number is over radius, compared from the highest bit."""
    more, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            more, equal = more | (equal & counters[k]), equal & ~counters[k]
    return more


def _links(buckets: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All links within each of many buckets, buckets of one size class together."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    small: dict[int, list[np.ndarray]] = {}
    for b in buckets:
        if len(b) <= 64:
            small.setdefault(1 << (len(b) - 1).bit_length(), []).append(b)
        else:
            found.append(block_links(b, b, radius))
    for size, group in small.items():
        for at in range(0, len(group), 8192):
            part = group[at : at + 8192]
            fp = np.zeros((len(part), size), np.uint64)
            n = np.array([len(b) for b in part])
            for i, b in enumerate(part):
                fp[i, : len(b)] = b
            planes = _planes(fp)
            for j in range(size - 1):
                later = np.where(n > j + 1, (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1), np.uint64(0)) if size < 64 else np.where(n == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))
                later = later & ~((np.uint64(2) << np.uint64(j)) - np.uint64(1))
                hit = within(planes, fp[:, j].copy(), radius, later)
                for r in np.flatnonzero(hit):
                    others = np.flatnonzero(np.unpackbits(hit[r : r + 1].astype("<u8").view(np.uint8), bitorder="little"))
                    found.append((np.full(len(others), fp[r, j]), fp[r, others]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def block_links(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two blocks of one bucket, thinned to a spanning forest of the two blocks' links."""
    planes, alive = bit_planes(right)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(y, y)
        return x

    for q in left:
        for j in members_of(within(planes, np.full(len(alive), q), radius, alive)):
            a, b = find(int(q)), find(int(right[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
    pairs = [(x, find(x)) for x in list(root)]
    pairs = [(x, y) for x, y in pairs if x != y]
    return np.array([x for x, _ in pairs], np.uint64), np.array([y for _, y in pairs], np.uint64)


def fingerprint_links(distinct: DataFrame, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """Links (a, b) among distinct fingerprints fp that span every group within `radius` (3 at most) bits.

    Two such fingerprints differ in bits of two quarters at most when radius is 2, and so meet in a bucket. Buckets of
    more than `block` members are split by a hash into parts, and each pair of parts is compared by itself.
    """
    if not 0 <= radius <= 2:
        raise ValueError("four quarters, two of them equal, find all pairs within 2 bits")
    keys = F.array(*[F.struct(F.lit(t).alias("t"), (F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) * 65536 + F.shiftrightunsigned("fp", 16 * j).bitwiseAND(0xFFFF)).alias("key")) for t, (i, j) in enumerate(_PAIRS)])
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    size = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    member = keyed.join(size, ["t", "key"])
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tasks = (
        member.withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("t", "key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "fp")
    )
    tasks = tasks.repartition("t", "key", "p", "q").sortWithinPartitions("t", "key", "p", "q", "mine", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray):
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        rest = None
        for got in _with_last(batches):
            cols = [got.column(i).to_numpy(zero_copy_only=False) for i in range(6)] if got is not None else None
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)] if rest is not None and cols is not None else cols if cols is not None else rest
            if cols is None or not len(cols[0]):
                continue
            new = np.ones(len(cols[0]), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:4]])
            at = np.flatnonzero(new)
            done = len(new) if got is None else at[-1]  # the last group may go on in the next batch
            fp, side, p, q = cols[5].view(np.uint64), cols[4], cols[2], cols[3]
            whole = []
            for s, e in zip(at, [*at[1:], len(new)], strict=True):
                if s >= done:
                    break
                if p[s] == q[s]:
                    whole.append(fp[s:e])
                else:
                    a = fp[s:e][side[s:e] == p[s]]
                    b = fp[s:e][side[s:e] == q[s]]
                    yield out(*block_links(a, b, radius))
            yield out(*_links(whole, radius))
            rest = [c[done:] for c in cols]

    return tasks.mapInArrow(tidy(run), "a long, b long")


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, and then None."""
    yield from batches
    yield None


def simhash_groups(documents: DataFrame, width: int = 3, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """doc_id, fp, component_id of each row: the smallest doc_id reachable over links of at most `radius` bits.

    Rows of one fingerprint are one node, so copies cost one row. Null texts and texts without words have fingerprint
    0; a null doc_id is never the smallest unless all of its group are null; an empty table gives no rows.
    """
    docs = materialize(fingerprints(documents, width), "fingerprints")
    nodes = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = connected_components(fingerprint_links(nodes.select("fp"), radius, block))
    linked = roots.join(nodes.drop("n"), F.col("node") == F.col("fp"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = materialize(linked.join(smallest, "root").select("fp", F.col("least").alias("linked")), "components")
    whole = nodes.join(linked, "fp", "left").select("fp", "n", F.coalesce("linked", "first").alias("component_id"))
    return lookup(docs, materialize(whole, "component-ids"), ["fp"], "n").select("doc_id", "fp", "component_id")
