"""Best-fit packing of token sequences by exact-complement hashing over length counts.

Lengths are at most the sequence length, so the whole corpus is a histogram of fixed size: patterns of lengths are
chosen on it with their multiplicities. Pieces are then numbered within their length by a distributed count, and each
number is looked up in the patterns. Nothing that grows with the corpus meets in one task.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import arrow_limits, fresh, materialize, text_column, tidy

#: Words and punctuated words whose ids a worker remembers; the first seen stay, which holds the frequent ones.
CACHE = 200_000
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BEFORE_WORD = re.compile(r"(?<=\S)(?= \S)")
#: Marks that the byte-level pattern never joins to a letter before them.
_MARKS = "!#$%&*+,-./:;<=>?@^_|~()[]{}\"`\\"
#: The public byte-level pattern.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _Memory(dict):
    """Ids of what has been asked for, up to CACHE entries; the rest is made anew each time."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        out = self.make(key)
        if len(self) < CACHE:
            self[key] = out
        return out


class TextEncoder:
    """Ids of texts as little-endian 32-bit numbers, by the byte-level tokenizer at `path`.

    A text is cut before each single space between two characters that are no spaces: the byte-level pattern always
    begins a token there and no merge crosses it, so the ids of the chunks joined are the ids of the text. In the same
    way a chunk of letters and then marks is its letters and its marks. Chunks of Latin letters and ASCII go through
    the vocabulary read as merge ranks, which is several times faster and gives the same ids; all others, whole texts
    that hold an added token (such as an end-of-text mark, which is one id), and all of a tokenizer that is not plain
    byte-level go through the tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        added = [t["content"] for t in spec["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        pre = spec["pre_tokenizer"] or {}
        self.plain = spec["normalizer"] is None and spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if self.plain:
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
            special = {t["content"] for t in spec["added_tokens"]}
            ranks = {bytes(back[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
            self.fast = tiktoken.Encoding("byte-level", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = _Memory(self._piece)
        self.tails = _Memory(self._tail)  # of chunks, without the space they begin with

    def _piece(self, text: str) -> bytes:
        ids = self.fast(text) if text and max(text) < "\u0250" else self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _tail(self, tail: str) -> bytes:
        word = tail.rstrip(_MARKS)
        if len(word) < len(tail) and word.isalpha():
            return self.pieces[" " + word] + self.pieces[tail[len(word) :]]
        return self._piece(" " + tail)

    def encode(self, text: str) -> bytes:
        if not self.plain or (self.added and self.added.search(text)):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _OTHER_SPACE.search(text):
            head, *rest = _BEFORE_WORD.split(text)
            parts = [x[1:] for x in rest]
        else:
            parts = text.split(" ")
            head = parts.pop(0)
        return self._piece(head) + b"".join(map(self.tails.__getitem__, parts))


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones of `size`, the first of what remains."""
    first = n % size or min(n, size)
    return [(0, first), *((s, size) for s in range(first, n, size))] if n else []


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(documents: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each row's ids, `end_id` last. Null texts are empty."""
    arrow_limits(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            ids = b.column("doc_id").to_pylist()
            for doc, text in zip(ids, b.column("text"), strict=True):
                got = encoder(tokenizer_path).encode(text.as_py()) + end
                for k, (s, n) in enumerate(cut(len(got) // 4, size)):
                    for col, v in zip(rows, (doc, k, s, n, zlib.crc32(got[4 * s : 4 * (s + n)])), strict=True):
                        col.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select("doc_id", text_column().alias("text")).mapInArrow(tidy(run), _PIECES)


class SumIndex:
    """Which lengths can still be had, and by their sum the singles, pairs and triples of them.

    Counts only fall, so what can't be had once is never looked at again: a table's entry goes when a length of it has
    run out. Pairs and triples of a sum are listed when that sum is first asked for, by their largest length, longest
    first; a triple is its largest length and a pair of the rest.
    """

    def __init__(self, counts: dict[int, int], size: int):
        self.free = np.zeros(size + 1, np.int64)
        for n, c in counts.items():
            self.free[n] = c
        self._pairs: dict[int, list[int]] = {}
        self._triples: dict[int, list[int]] = {}

    def _listed(self, table: dict[int, list[int]], total: int, least: int) -> list[int]:
        """The lengths from `least` on that may lead a combination of this sum; those that have run out are dropped."""
        if total not in table:
            table[total] = np.flatnonzero(self.free[least:total])[::-1] + least
        left = table[total] = table[total][self.free[table[total]] > 0]
        return left

    def has(self, extra: tuple[int, ...], beside: tuple[int, ...] = ()) -> bool:
        whole = beside + extra
        return all(self.free[n] >= whole.count(n) for n in set(extra))

    def pair(self, total: int, beside: tuple[int, ...], most: int) -> tuple[int, int] | None:
        """The pair of this sum with the longest first length, `most` at most, that can be had besides."""
        lead = self._listed(self._pairs, total, (total + 1) // 2)
        for a in lead[(lead <= most) & (self.free[total - lead] > 0)]:
            if self.has((int(a), int(total - a)), beside):
                return int(a), int(total - a)
        return None

    def triple(self, total: int, beside: tuple[int, ...]) -> tuple[int, int, int] | None:
        for a in self._listed(self._triples, total, -(-total // 3)):
            a = int(a)
            if total - a >= 2 and self.has((a,), beside):
                rest = self.pair(total - a, (*beside, a), a)
                if rest is not None:
                    return a, *rest
        return None

    def complement(self, total: int, beside: tuple[int, ...]) -> tuple[int, ...] | None:
        """One, two or three lengths that make up this sum and can be had beside those of a sequence."""
        if self.has((total,), beside):
            return (total,)
        return self.pair(total, beside, total) or self.triple(total, beside)

    def longest(self, most: int, beside: tuple[int, ...]) -> int | None:
        """The longest length of at most `most` that can be had beside those of a sequence."""
        left = self.free[: most + 1].copy()
        for n in beside:
            if n <= most:
                left[n] -= 1
        fits = np.flatnonzero(left > 0)
        return int(fits[-1]) if len(fits) else None

    def often(self, pattern: tuple[int, ...]) -> int:
        return min(int(self.free[n]) // pattern.count(n) for n in set(pattern))

    def take(self, pattern: tuple[int, ...], times: int) -> None:
        for n in pattern:
            self.free[n] -= times


def plan_packing(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences), from counts by length.

    From the longest length down, what is left of a sequence is looked up among the sums of one, two and three available
    lengths; an exact complement is taken as often as all its counts allow. Lengths without one are packed best-fit:
    each opens a sequence, which takes the longest length that fits, with complements tried again, until none fits.
    """
    plan: list[tuple[tuple[int, ...], int]] = []
    index = SumIndex({n: c for n, c in counts.items() if c > 0}, size)

    def take(pattern: tuple[int, ...], times: int) -> None:
        plan.append((pattern, times))
        index.take(pattern, times)

    if index.free[size]:
        take((size,), int(index.free[size]))
    for n in range(size - 1, 0, -1):
        while index.free[n] > 0:
            pattern, gap = (n,), size - n
            while gap:
                more = index.complement(gap, pattern)
                if more is not None:
                    pattern, gap = (*pattern, *more), 0
                elif (fit := index.longest(gap, pattern)) is not None:
                    pattern, gap = (*pattern, fit), gap - fit
                else:
                    break
            take(pattern, index.often(pattern))
    return plan


class Slots:
    """For each length, which sequence and offset its r-th piece has. Its size follows the plan, not the corpus."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        used: dict[int, int] = defaultdict(int)
        first = 0
        for pattern, times in plan:
            offset = 0
            for n in pattern:
                rows[n].append((used[n], first, offset))
                used[n] += times
                offset += n
            first += times
        self.rows = {n: np.array(v, np.int64) for n, v in rows.items()}

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = self.rows[length]
        at = np.searchsorted(t[:, 0], rank, side="right") - 1
        return t[at, 1] + rank - t[at, 0], t[at, 2]


def pack_pieces(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """pieces with sequence_id and offset. What reaches the driver is one count for each length, `size` of them at most;
    counts by length and task, from which pieces are numbered, stay a table."""
    spark: SparkSession = pieces.sparkSession
    arrow_limits(spark)
    names = pieces.columns
    task, mixed, start = (fresh(names, n) for n in ("task", "mix", "from"))
    order = ["length", mixed, "doc_id", "piece", "start", "ids_crc32"]
    ranked = pieces.withColumn(mixed, F.xxhash64("doc_id", "piece")).repartitionByRange(*order[:4]).sortWithinPartitions(*order).withColumn(task, F.spark_partition_id())
    ranked = materialize(ranked, "pieces")
    counted = materialize(ranked.groupBy(task, "length").agg(F.count("*").alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.select(task, "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    counts = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    slots = spark.sparkContext.broadcast(Slots(plan_packing(counts, size)))

    # A written part may be read by several tasks or with others: the rows of a (task, length) are numbered by group.
    def run(key: tuple, batch: pa.Table) -> pa.Table:
        batch = batch.sort_by([(n, "ascending") for n in (mixed, "doc_id", "piece", "start", "ids_crc32")])
        first = batch.column(start)[0].as_py()
        seq, off = slots.value.place(int(key[1].as_py()), first + np.arange(batch.num_rows))
        return batch.select(names).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    numbered = ranked.join(firsts, [task, "length"])
    return numbered.groupBy(task, "length").applyInArrow(run, pieces.schema.add("sequence_id", "long").add("offset", "long"))


def pack_documents(documents: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each row.

    Null and empty texts have one piece, the end id alone; rows that repeat a doc_id are packed each; an empty table
    gives no rows.
    """
    return pack_pieces(materialize(token_pieces(documents, tokenizer_path, size, end_id), "tokens"), size)
