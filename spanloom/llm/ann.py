"""Approximate nearest neighbours by a hash-prefix forest.

The index is a table of row blocks. A block holds its vectors and, for each tree, the sorted array of their long hash
strings with the rows in that order. A query descends in every tree to its longest prefix match, then ascends in all
trees at once, a bit at a time, until enough distinct candidates share a prefix of that length with it; these are ranked
by exact distance. Blocks answer independently and their best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import arrow_limits, materialize, tidy

#: Bits of a hash string, trees, rows of a block at most, and queries that travel to the blocks at a time.
BITS, TREES, BLOCK_ROWS, QUERY_BLOCK = 64, 16, 8192, 16_384
_CHUNK = 256


@dataclass
class Forest:
    """Hash functions, fitted on a bounded sample; `share` of a block is ranked exactly."""

    center: np.ndarray
    planes: np.ndarray  # [tree, bit, dimension]
    cuts: np.ndarray  # [tree, bit]
    share: float

    @property
    def dim(self) -> int:
        return len(self.center)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """The hash string of each vector in each tree, as uint64[tree, row]; the first bit is the highest."""
        weight = np.uint64(1) << np.arange(BITS - 1, -1, -1).astype(np.uint64)
        return np.stack([((x - self.center) @ p.T > c).astype(np.uint64) @ weight for p, c in zip(self.planes, self.cuts, strict=True)])


def sort_trees(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per tree the sorted hash strings and the rows in that order."""
    order = np.argsort(strings, axis=1, kind="stable")
    return np.take_along_axis(strings, order, axis=1), order.astype(np.int32)


def prefix_ranges(keys: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where, in each sorted array, the strings that share the first x bits with each query lie: [tree, query, x]."""
    x = np.arange(BITS + 1)
    low = np.where(x < BITS, ~np.uint64(0) >> np.minimum(x, BITS - 1).astype(np.uint64), np.uint64(0))
    lo, hi = (np.empty((len(keys), query.shape[1], BITS + 1), np.int32) for _ in range(2))
    for t, k in enumerate(keys):
        q = query[t][:, None]
        lo[t], hi[t] = np.searchsorted(k, q & ~low, "left"), np.searchsorted(k, q | low, "right")
    return lo, hi


def candidates(lo: np.ndarray, hi: np.ndarray, order: np.ndarray, need: int, rows: int) -> np.ndarray:
    """Candidates of one query (lo, hi: [tree, x]): all that share, in some tree, the longest prefix length at which at
    least `need` distinct rows do. Length 0 has all rows, so that this always ends."""
    total = (hi - lo).sum(0)
    x = int(np.flatnonzero(total >= min(need, total[0]))[-1])
    while True:
        mark = np.zeros(rows, bool)
        for t in range(len(order)):
            mark[order[t, lo[t, x] : hi[t, x]]] = True
        found = np.flatnonzero(mark)
        if len(found) >= need or x == 0:
            return found
        x -= 1


def search_block(forest: Forest, x: np.ndarray, ids: np.ndarray, keys: np.ndarray, order: np.ndarray, q: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row, distance) of the k nearest candidates of each query in one block."""
    need = min(len(x), max(int(np.ceil(forest.share * len(x))), 8 * k))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(q), _CHUNK):
        lo, hi = prefix_ranges(keys, forest.strings(q[a : a + _CHUNK]))
        for i in range(lo.shape[1]):
            c = candidates(lo[:, i], hi[:, i], order, need, len(x))
            c = c[ids[c] != query_ids[a + i]]
            d = np.sqrt(np.square(x[c] - q[a + i]).sum(1))
            if len(c) > k:
                near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                c, d = c[near], d[near]
            best = np.lexsort((ids[c], d))[:k]
            out.append((np.full(len(best), a + i), c[best], d[best]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def fit_forest(sample: np.ndarray, recall: float, k: int, trees: int = TREES, seed: int = 3) -> Forest:
    """Random hyperplanes with the sample's medians as cuts. The share to rank is the least, of a few, that reaches the
    recall within the sample, whose neighbours are further off than those in the whole table."""
    rng = np.random.default_rng(seed)
    center = sample.mean(0)
    planes = rng.normal(size=(trees, BITS, sample.shape[1]))
    cuts = np.stack([np.median((sample - center) @ p.T, axis=0) for p in planes])
    forest = Forest(center, planes, cuts, 1.0)
    rows = sample[:4096]
    if len(rows) <= 8 * k:
        return forest
    keys, order = sort_trees(forest.strings(rows))
    ids = np.arange(len(rows))
    queries = ids[:: max(1, len(ids) // 100)]
    forest.share = 1.0
    truth = search_block(forest, rows, ids, keys, order, rows[queries], queries, k)
    want = set(zip(truth[0].tolist(), truth[1].tolist(), strict=True))
    for share in (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8):
        forest.share = share
        got = search_block(forest, rows, ids, keys, order, rows[queries], queries, k)
        if len(want & set(zip(got[0].tolist(), got[1].tolist(), strict=True))) >= recall * len(want):
            return forest
    forest.share = 1.0
    return forest


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and x (doubles) of the rows that take part: no null, zero, empty, or non-finite vectors or components, no
    null vec_id; of vectors of several lengths those of the commonest, the longest of such."""
    x = F.col("embedding").cast("array<double>")
    fine = vectors.select("vec_id", x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    fine = fine.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0))
    top = fine.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return fine.where(F.size("x") == (top.d if top else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def build_blocks(vectors: DataFrame, forest: Forest, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The index, written to the shared folder: ids, vectors, and the trees' sorted strings and orders of each block.
    Every row is in one block; rows stay where they are read."""
    spark = vectors.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(forest)  # of fixed size
    names = ["n", "ids", "x", "keys", "rows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(ids: list, xs: list) -> pa.RecordBatch:
            x = np.concatenate(xs)
            keys, order = sort_trees(shared.value.strings(x))
            raw = [np.concatenate(ids).astype("<i8"), x.astype("<f8"), keys.astype("<u8"), order.astype("<i4")]
            return pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in raw)], names)

        ids: list[np.ndarray] = []
        xs: list[np.ndarray] = []
        n = 0
        for b in batches:
            for a in range(0, b.num_rows, block_rows):
                part = b.slice(a, block_rows)
                if n and n + part.num_rows > block_rows:
                    yield block(ids, xs)
                    ids, xs, n = [], [], 0
                ids.append(part.column("vec_id").to_numpy())
                xs.append(_matrix(part.column("x")))
                n += part.num_rows
        if n:
            yield block(ids, xs)

    return materialize(vectors.mapInArrow(tidy(run), "n long, ids binary, x binary, keys binary, rows binary"), "forest")


def query_blocks(vectors: DataFrame, every: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries, (ids, vectors) of at most `size` at a time, streamed through the driver."""
    ids: list[int] = []
    xs: list[list[float]] = []
    for row in vectors.where(F.col("vec_id") % every == 0).toLocalIterator():
        ids.append(row.vec_id)
        xs.append(row.x)
        if len(ids) == size:
            yield np.array(ids, np.int64), np.array(xs, np.float64)
            ids, xs = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(xs, np.float64)


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, recall: float = 0.97, sample: int = 8192, block_rows: int = BLOCK_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every` its k nearest rows found, by
    Euclidean distance in double precision, nearest first, ties to the smaller vec_id.

    The forest is fitted on at most `sample` rows, chosen by a hash of vec_id. Queries go to all blocks in groups of
    `query_block`, each broadcast by itself. Rows of the query's own vec_id are no candidates; rows that repeat a vec_id
    otherwise count each, as candidates and as queries; which rows take part at all: see valid_vectors.
    """
    spark = vectors.sparkSession
    arrow_limits(spark)
    schema = "query_id long, copy int, vec_id long, score double"
    names = ["query_id", "copy", "vec_id", "score"]
    fine = valid_vectors(vectors)
    picked = fine.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()  # at most `sample` rows
    found = spark.createDataFrame([], schema)
    if picked:
        forest = fit_forest(np.array([r.x for r in picked], np.float64), recall, k)
        blocks = build_blocks(fine, forest, block_rows)
        for ids, q in query_blocks(fine, every, query_block):
            order = np.argsort(ids, kind="stable")
            ids, q = ids[order], q[order]
            copy = np.arange(len(ids)) - np.searchsorted(ids, ids)  # rows that repeat a query's vec_id
            shared = spark.sparkContext.broadcast((forest, ids, copy, q))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                forest, ids, copy, q = shared.value
                for b in batches:
                    for i in range(b.num_rows):
                        n = b.column("n")[i].as_py()
                        rows, x, keys, place = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in (("ids", "<i8"), ("x", "<f8"), ("keys", "<u8"), ("rows", "<i4")))
                        hit = search_block(forest, x.reshape(n, -1), rows, keys.reshape(-1, n), place.reshape(-1, n), q, ids, k)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[hit[0]]), pa.array(copy[hit[0]], pa.int32()), pa.array(rows[hit[1]]), pa.array(hit[2])], names)

            found = found.unionByName(blocks.mapInArrow(tidy(run), schema))
    best = Window.partitionBy("query_id", "copy").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
