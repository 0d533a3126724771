"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step handles; a piece is longer only when a single word is.
BLOCK_BYTES = 1 << 20
#: Rows and bytes of one Arrow batch, so that a Python worker's memory is bounded whatever the texts' lengths.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on a local master without one (tests) a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/spanloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet to the shared folder and read it back: lineage ends there, lost executors recompute
    nothing before it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], n: str, share: int = 1000) -> DataFrame:
    """rows joined with the one row that table has for each of their keys; column n of table, which is left out, is how
    many rows have that key. Keys of more than one in `share` rows, fewer than `share` keys, are broadcast, so that no
    task gets all rows of such a key; the others are joined by a shuffle. rows is read twice: it should be written."""
    total = table.agg(F.sum(n)).first()[0] or 0
    often = F.broadcast(table.where(F.col(n) > total / share).drop(n))  # fewer than `share` rows
    rare = table.where(F.col(n) <= total / share).drop(n)
    return rows.join(often, keys).unionByName(rows.join(often.select(*keys), keys, "left_anti").join(rare, keys))


def arrow_limits(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def tidy(run):
    """A map over Arrow batches that gives freed memory back when its task ends: Python workers are used again by later
    stages, and would keep what the largest batch took."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def fresh(columns: list[str], name: str) -> str:
    """The name, with underscores in front for as long as some column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_column(name: str = "text"):
    """The text as a string, empty where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(name: str, n: int):
    """crc32 of the column's decimal text, modulo n; -1 where it is null."""
    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(n)), F.lit(-1))


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and its n + 1 offsets."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole texts as (document index of each piece, bytes, piece offsets), at most about `limit` bytes at a time.

    Only a text of over `limit` bytes is cut into pieces, behind an ASCII space or newline; every byte is in one piece.
    """
    raw, off = string_buffer(column)
    docs: list[int] = []
    cuts: list[tuple[int, int]] = []
    size = 0

    def flush():
        data = np.concatenate([raw[s:e] for s, e in cuts]) if cuts else np.zeros(0, np.uint8)
        return np.array(docs, np.int64), data, np.concatenate(([0], np.cumsum([e - s for s, e in cuts]))).astype(np.int64)

    for i in range(len(column)):
        s, end = int(off[i]), int(off[i + 1])
        while True:
            e = end
            if e - s > limit:
                near = raw[s + limit : end]
                gap = np.flatnonzero((near[: 1 << 16] == 32) | (near[: 1 << 16] == 10))
                if not len(gap):
                    gap = np.flatnonzero((near == 32) | (near == 10))
                e = s + limit + int(gap[0]) + 1 if len(gap) else end
            if size and size + e - s > limit:
                yield flush()
                docs, cuts, size = [], [], 0
            docs.append(i)
            cuts.append((s, e))
            size += e - s
            if e == end:
                break
            s = e
    if docs:
        yield flush()


#: Multiplier of the polynomial word hash and its inverse modulo 2**64.
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    if len(_powers.get(key, ())) < n:
        out = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        out[0] = 1
        _powers[key] = np.multiply.accumulate(out)
    return _powers[key][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run data[start:end]; it depends on the run's bytes alone."""
    if not len(data):
        return np.zeros(len(starts), np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_R, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_R_INV, len(data) + 1)[starts])


def word_table() -> np.ndarray:
    """True for the bytes of words: digits, ASCII letters of either case, and all bytes of non-ASCII characters."""
    t = np.zeros(256, bool)
    for a, b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        t[a : b + 1] = True
    return t


def lower_table() -> np.ndarray:
    """Maps the bytes A-Z to a-z."""
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


WORD, LOWER = word_table(), lower_table()


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, end) of each maximal run of word bytes; runs never cross pieces."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = table[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return np.searchsorted(offsets, starts, side="right") - 1, starts, stops
