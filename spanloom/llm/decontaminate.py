"""Benchmark decontamination by the CGK embedding of edit distance into Hamming distance.

Symbols are words. Windows of an item's size are embedded by random walks (Chakraborty, Goldenberg, Koucky 2016): a step
writes the current symbol and moves on by a random bit of (step, symbol). Symbols of the walks, sampled at a few steps
again and again, are the keys of a locality-sensitive hash: every window of every text is looked up in tables of the
items' keys. How often is settled by simulated edits, so that the target recall is reached. What collides is verified by
exact edit distance.

A walk is the same for all windows until it ends, and walks that meet go on together, so a text's windows are embedded
by one sweep over its coalescing walks: after j steps about one in sqrt(j) of them is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import LOWER, WORD, arrow_limits, fresh, mix, run_hashes, text_blocks, text_column, tidy, words_of

#: Items and their words that one block of the benchmark holds; a larger benchmark takes several passes.
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 1_000_000
#: Random walks, sampled steps of a key, and words of a part at most: a longer item is keyed by each of its parts.
WALKS, SAMPLED, PART = 4, 3, 63
#: Windows of a text that one sweep embeds, and the steps behind which walks that have met are joined.
_SWEEP = 1 << 16
_JOIN = frozenset((1, 2, 4, 6, 9, 13, 18, 25, 35, 48, 64))
HITS = "doc_id long, item_id long, start_word long, n_words long, distance int, similarity double"


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each word of whole texts, letters A-Z in lower case."""
    texts, hashes = [], []
    for docs, data, off in text_blocks(column):
        w, s, e = words_of(data, off, WORD)
        texts.append(docs[w])
        hashes.append(run_hashes(LOWER[data], s, e))
    return (np.concatenate(texts), np.concatenate(hashes)) if texts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def walk_bits(symbols: np.ndarray, walk: int) -> np.ndarray:
    """For each symbol the random bits by which a walk moves on, bit j for step j; symbol 0, an end, is never left."""
    bits = mix(symbols ^ mix(np.array([walk + 1], np.uint64))) >> np.uint64(1)
    return np.where(symbols == 0, np.uint64(0), bits).view(np.int64)


def sweep(bits: np.ndarray, windows: int, steps: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Where the walks that begin at places 0 to windows - 1 are after each of the given numbers of steps: (places of the
    distinct walks, number of the walk of each window). Walks never pass one another; those that meet are one."""
    at, number, out = np.arange(windows), np.arange(windows), {}
    wanted = set(steps)
    for j in range(max(steps) + 1):
        if j in wanted:
            out[j] = (at, number)
        at = at + ((bits[at] >> j) & 1)
        if j + 1 in _JOIN and len(at) > 1:
            new = np.ones(len(at), bool)
            np.not_equal(at[1:], at[:-1], out=new[1:])
            number = (np.cumsum(new) - 1)[number]
            at = at[new]
    return out


def reach(low: int) -> int:
    """Steps that keys of items of low to 2 low - 1 words sample: nearly all walks are still inside the item then."""
    return max(1, low * 3 // 2)


@dataclass
class SizeClass:
    """Parts of about one length: low to 2 low - 1 words."""

    low: int
    item: np.ndarray  # of each part
    offset: np.ndarray  # words of the item before the part
    parts: list[np.ndarray]
    steps: np.ndarray  # [walk, repetition, SAMPLED], ascending

    @cached_property
    def tables(self) -> list[list[tuple[list[np.ndarray], np.ndarray, np.ndarray]]]:
        """By walk and repetition: for each further sampled step, from the last one back, marks of the keys so far; the
        sorted whole keys; their parts. A part whose walk has left it at a sampled step has no key there."""
        text, first = _joined(self.parts)
        size = 1 << int(np.clip((len(self.parts) * 64).bit_length(), 12, 18))
        while size < 4 * len(self.parts):
            size *= 2
        out = []
        for w in range(len(self.steps)):
            at = first.copy()
            symbols = np.zeros((reach(self.low), len(first)), np.uint64)
            bits = walk_bits(text, w)
            for j in range(len(symbols)):
                symbols[j] = text[at]
                at = at + ((bits[at] >> j) & 1)
            row = []
            for steps in self.steps[w]:
                inside = np.flatnonzero((symbols[steps] != 0).all(axis=0))
                key, marks = np.zeros(len(inside), np.uint64), []
                for j in steps[::-1]:
                    key = mix(key + symbols[j, inside])
                    mark = np.zeros(size, bool)
                    mark[(key & np.uint64(size - 1)).astype(np.int64)] = True
                    marks.append(mark)
                order = np.argsort(key, kind="stable")
                row.append((marks, key[order], inside[order]))
            out.append(row)
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tables"}  # made anew by each worker

    def keyed(self) -> np.ndarray:
        """Which parts have a key in some repetition: exact copies of them are always found."""
        out = np.zeros(len(self.parts), bool)
        for row in self.tables:
            for _, _, parts in row:
                out[parts] = True
        return out

    def collisions(self, text: np.ndarray, places: list[dict]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, part) pairs that share a key; places: the sweep of each walk over the text."""
        for w, row in enumerate(self.tables):
            for steps, (marks, keys, parts) in zip(self.steps[w], row, strict=True):
                wrap = np.uint64(len(marks[0]) - 1)
                at, number = places[w][int(steps[-1])]
                key = mix(text[at])
                window = np.flatnonzero(marks[0][(key & wrap).astype(np.int64)][number])
                key = key[number[window]]
                for j, mark in zip(steps[-2::-1], marks[1:], strict=True):
                    at, number = places[w][int(j)]
                    key = mix(key + text[at[number[window]]])
                    hit = mark[(key & wrap).astype(np.int64)]
                    window, key = window[hit], key[hit]
                left, right = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                size = right - left
                yield np.repeat(window, size), parts[_ranges(left, size)]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[i] to first[i] + size[i] - 1 of each i, one after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The parts one after the other, each with an end behind it; where each begins."""
    end = np.zeros(1, np.uint64)
    size = np.array([len(p) + 1 for p in parts], np.int64)
    return np.concatenate([x for p in parts for x in (p, end)]), np.cumsum(size) - size


@dataclass
class Index:
    """One block of the benchmark. Its size is bounded by BLOCK_ITEMS and BLOCK_WORDS."""

    ids: np.ndarray
    words: list[np.ndarray]
    edits: np.ndarray
    classes: list[SizeClass]
    recall: dict[int, float] = field(default_factory=dict)  # simulated, by size class

    @cached_property
    def size(self) -> np.ndarray:
        return np.array([len(w) for w in self.words], np.int64)

    @cached_property
    def run(self) -> np.ndarray:
        """For each item, how many consecutive words of it, four at most, stay together under any edits allowed."""
        return np.minimum(-(-(self.size - self.edits) // (self.edits + 1)), 4)

    @cached_property
    def bags(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sorted hashes of (item, word) pairs with marks of them, and the same of (item, run of its words)."""
        out = []
        for lengths in (np.ones(len(self.words), np.int64), self.run):
            pairs = np.unique(np.concatenate([_pair(i, runs_of(w, int(k))) for i, (w, k) in enumerate(zip(self.words, lengths, strict=True))]))
            mark = np.zeros(1 << min(24, max(12, (len(pairs) * 16).bit_length())), bool)
            mark[(pairs & np.uint64(len(mark) - 1)).astype(np.int64)] = True
            out.append((pairs, mark))
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("bags", "size", "run")}


def runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words."""
    out = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for i in range(k):
        out = mix(out) + h[i : len(h) - k + 1 + i]
    return out


def _pair(item, word: np.ndarray) -> np.ndarray:
    return mix(word + mix(np.atleast_1d(np.asarray(item, np.uint64))))


def simulate(parts: list[np.ndarray], steps: np.ndarray, low: int, share: float, rng: np.random.Generator, trials: int = 200) -> np.ndarray:
    """Which of some parts with as many random edits as are allowed have a window with their key, by repetition:
    bool[trial, repetition], repetition r of all walks together."""
    filler = np.concatenate(parts)
    whole, owner = [], rng.integers(0, len(parts), trials)
    spare = []
    for i in owner:
        e = int(share * len(parts[i]))
        text = np.concatenate([rng.choice(filler, e + 2), _edited(parts[i], e, rng), rng.choice(filler, len(parts[i]) + e)])
        whole.append(text)
        spare.append(2 * e + 4)
    text, first = _joined(whole)
    item, begin = _joined([parts[i] for i in owner])
    trial = np.repeat(np.arange(trials), spare)
    start = _ranges(first, np.array(spare))
    out = np.zeros((trials, steps.shape[1]), bool)
    for w in range(steps.shape[0]):
        at, mine, same = start.copy(), begin.copy(), []
        bits, own = walk_bits(text, w), walk_bits(item, w)
        for j in range(reach(low)):
            same.append((text[at] == item[mine][trial]) & (item[mine] != 0)[trial])
            at, mine = at + ((bits[at] >> j) & 1), mine + ((own[mine] >> j) & 1)
        same = np.array(same)
        for r, s in enumerate(steps[w]):
            out[trial[same[s].all(axis=0)], r] = True
    return out


def sample_steps(low: int, count: int, rng: np.random.Generator) -> np.ndarray:
    """SAMPLED steps for each walk and each of `count` repetitions, different ones where there are so many."""
    order = rng.random((WALKS, count, max(reach(low), SAMPLED))).argsort(axis=2)
    return np.sort(order[:, :, :SAMPLED] % reach(low), axis=2)


def size_class(low: int, item: np.ndarray, offset: np.ndarray, parts: list[np.ndarray], share: float, recall: float, seed: int) -> tuple[SizeClass, float]:
    """The keys of parts of about one length: as many repetitions as simulated edits need for the recall, and as give each
    part a key."""
    rng = np.random.default_rng(seed)
    steps = sample_steps(low, 8, rng)
    while True:
        found = simulate(parts, steps, low, share, rng)
        reached = np.maximum.accumulate(found, axis=1).mean(axis=0)
        enough = np.flatnonzero(reached >= recall)
        if len(enough):
            made = SizeClass(low, item, offset, parts, steps[:, : enough[0] + 1])
            if made.keyed().all():
                return made, float(reached[enough[0]])
            recall = 1.0 if enough[0] + 1 == steps.shape[1] else recall
        if steps.shape[1] >= 1024:
            raise ValueError(f"simulated recall stays at {reached[-1]:.3f} for items of {low} words and more: allow fewer edits")
        steps = np.concatenate([steps, sample_steps(low, steps.shape[1], rng)], axis=1)


def _edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    out = list(words)
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(len(out))) if out else 0
        new = np.uint64(rng.integers(1, 1 << 62))
        if kind == 0 and len(out) > 1:
            out.pop(at)
        elif kind == 1:
            out.insert(at, new)
        elif out:
            out[at] = new
    return np.array(out, np.uint64)


def build_index(ids: list[int], texts: list[str], share: float = 0.2, recall: float = 0.97, seed: int = 11) -> Index | None:
    """The index of items with words; None where there are none."""
    owner, hashes = word_hashes(pa.array(texts, pa.string()))
    words = np.split(hashes, np.searchsorted(owner, np.arange(1, len(texts))))
    keep = [i for i in range(len(texts)) if len(words[i])]
    if not keep:
        return None
    words = [words[i] for i in keep]
    edits = np.array([int(share * len(w)) for w in words], np.int64)
    sized: dict[int, tuple[list, list, list]] = {}
    for i, w in enumerate(words):
        n = -(-len(w) // PART)
        for k in range(n):
            a, b = len(w) * k // n, len(w) * (k + 1) // n
            row = sized.setdefault(1 << ((b - a).bit_length() - 1), ([], [], []))
            for col, v in zip(row, (i, a, w[a:b]), strict=True):
                col.append(v)
    classes, reached = [], {}
    for low, (item, offset, parts) in sorted(sized.items()):
        made, reached[low] = size_class(low, np.array(item), np.array(offset), parts, share, recall, seed)
        classes.append(made)
    return Index(np.array([ids[i] for i in keep], np.int64), words, edits, classes, reached)


def collide(index: Index, owner: np.ndarray, h: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, start) of all windows that share a key with an item or a part of it; start, in words of the batch, is
    where the whole item would begin and may lie before its text."""
    ended = np.zeros(len(h) + texts, np.uint64)  # each text with an end behind it
    ended[np.arange(len(h)) + owner] = h
    deepest = max(reach(c.low) for c in index.classes)
    bits = [walk_bits(ended, w) for w in range(WALKS)]
    wanted = [sorted({int(j) for c in index.classes for j in c.steps[w].ravel()}) for w in range(WALKS)]
    ends = np.flatnonzero(ended == 0)
    found = [np.zeros((3, 0), np.int64)]
    for a in range(0, len(ended), _SWEEP):
        b = min(a + _SWEEP, len(ended))
        text = np.append(ended[a : b + deepest], np.uint64(0))
        places = [sweep(np.append(bits[w][a : b + deepest], 0), b - a, wanted[w]) for w in range(WALKS)]
        for c in index.classes:
            pairs = np.unique(np.concatenate([part * _SWEEP + window for window, part in c.collisions(text, places)]))
            at, part = pairs % _SWEEP + a, pairs // _SWEEP
            doc = np.searchsorted(ends, at)
            found.append(np.stack([doc, c.item[part], at - doc - c.offset[part]]))
    doc, item, start = np.concatenate(found, axis=1)
    order = np.lexsort((start, item, doc))
    return doc[order], item[order], start[order]


def regions(index: Index, doc: np.ndarray, item: np.ndarray, start: np.ndarray, first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, from, to): the stretches around colliding windows, overlapping ones of one item as one, that hold
    as many of the item's words, and a run of them, as every place within the allowed edits does."""
    size, e = index.size[item], index.edits[item]
    lo = np.maximum(start - 2 * e, first[doc])
    hi = np.minimum(start + size + 2 * e, first[doc + 1])
    ok = hi > lo
    doc, item, lo, hi = doc[ok], item[ok], lo[ok], hi[ok]
    if not len(doc):
        return doc, item, lo, hi
    new = np.ones(len(doc), bool)  # rows are sorted by text, item and start: within a pair both bounds only grow
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])
    begin = np.flatnonzero(new)
    doc, item, lo, hi = doc[begin], item[begin], lo[begin], hi[np.append(begin[1:], len(new)) - 1]
    for bag, lengths, least in zip(index.bags, (np.ones_like(index.run), index.run), (index.size - index.edits, np.ones_like(index.run)), strict=True):
        pairs, mark = bag
        keep = [np.zeros(0, np.int64)]
        for a in range(0, len(doc), 1 << 13):
            some = slice(a, a + (1 << 13))
            n = np.maximum(hi[some] - lo[some] - lengths[item[some]] + 1, 0)
            row = np.repeat(np.arange(len(n)), n)
            at, k = _ranges(lo[some], n), lengths[item[some]][row]
            run = np.zeros(len(at), np.uint64)
            for i in range(int(k.max(initial=0))):
                run = np.where(i < k, mix(run) + h[np.minimum(at + i, len(h) - 1)], run)
            key = _pair(item[some][row], run)
            hit = np.flatnonzero(mark[(key & np.uint64(len(mark) - 1)).astype(np.int64)])
            there = pairs[np.minimum(np.searchsorted(pairs, key[hit]), len(pairs) - 1)] == key[hit]
            keep.append(np.bincount(row[hit[there]], minlength=len(n)))
        enough = np.concatenate(keep) >= least[item]
        doc, item, lo, hi = doc[enough], item[enough], lo[enough], hi[enough]
    return doc, item, lo, hi


def best_place(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, from, to): the part of the text nearest to the item by edit distance, the leftmost shortest of these."""
    m = len(text)
    cost = np.zeros(m + 1, np.int64)
    origin = np.arange(m + 1)
    ramp = np.arange(m + 1)
    for k, x in enumerate(item):
        sub = cost[:-1] + (text != x)
        down = cost[1:] + 1
        new, source = np.empty(m + 1, np.int64), np.empty(m + 1, np.int64)
        new[0], source[0] = k + 1, 0
        take = sub <= down
        new[1:], source[1:] = np.where(take, sub, down), np.where(take, origin[:-1], origin[1:])
        low = np.minimum.accumulate(new - ramp)  # words of the text left out, after the best of the cells before
        best = low + ramp
        first = np.maximum.accumulate(np.where(new - ramp == low, ramp, 0))
        cost, origin = best, source[first]
    to = int(cost.argmin())
    return int(cost[to]), int(origin[to]), to


def find_leaks(index: Index, column: pa.Array) -> list[tuple[int, int, int, int, int, float]]:
    """(text, item_id, start_word, n_words, distance, similarity): for each text and item, the nearest place found."""
    owner, h = word_hashes(column)
    if not len(h):
        return []
    first = np.searchsorted(owner, np.arange(len(column) + 1))
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for d, i, lo, hi in zip(*(x.tolist() for x in regions(index, *collide(index, owner, h, len(column)), first, h)), strict=True):
        distance, s, t = best_place(index.words[i], h[lo:hi])
        if distance <= index.edits[i] and ((d, i) not in found or (distance, lo + s) < found[d, i][:2]):
            found[d, i] = (distance, lo + s, t - s)
    return [(d, int(index.ids[i]), s - int(first[d]), n, distance, 1 - distance / len(index.words[i])) for (d, i), (distance, s, n) in sorted(found.items())]


def item_blocks(benchmark: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """Blocks of the benchmark, streamed through the driver one at a time; each is small enough to broadcast."""
    ids, texts, words = [], [], 0
    for row in benchmark.select("item_id", text_column().alias("text")).orderBy("item_id").toLocalIterator():
        ids.append(-1 if row.item_id is None else row.item_id)
        texts.append(row.text)
        words += row.text.count(" ") + 1
        if len(ids) >= BLOCK_ITEMS or words >= BLOCK_WORDS:
            yield ids, texts
            ids, texts, words = [], [], 0
    if ids:
        yield ids, texts


def contamination(documents: DataFrame, benchmark: DataFrame, share: float = 0.2, recall: float = 0.97) -> DataFrame:
    """doc_id, item_id, start_word, n_words, distance, similarity of each item that a text holds within `share` of its
    words in edits. One map over the documents for each block of items, no shuffle.

    Words are runs of digits, ASCII letters (either case) and non-ASCII characters. Null texts are empty; items without
    words are never found; an item of under five words must be there exactly, and exact copies are found always; rows that
    repeat a doc_id report each, as do items that repeat an item_id; a null item_id is reported as -1; an empty table of
    either kind gives no rows.
    """
    spark = documents.sparkSession
    arrow_limits(spark)
    slim = documents.select("doc_id", text_column().alias("text"))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
    names = [x.split()[0] for x in HITS.split(", ")]
    out = spark.createDataFrame([], HITS)
    for ids, texts in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(build_index(ids, texts, share, recall))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = find_leaks(shared.value, b.column("text")) if shared.value is not None else []
                doc = b.column("doc_id").to_pylist()
                rows = [(doc[d], *rest) for d, *rest in hits]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names)

        out = out.unionByName(slim.mapInArrow(tidy(run), HITS))
    return out


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, share: float = 0.2, recall: float = 0.97) -> DataFrame:
    """The rows of documents whose text holds no item; all columns as they are, whatever their names. One map for each
    block of items. Null and empty texts stay, as do all rows where the benchmark is empty."""
    spark = documents.sparkSession
    arrow_limits(spark)
    for ids, texts in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(build_index(ids, texts, share, recall))
        schema = documents.schema

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = [True] * b.num_rows
                for d, *_ in find_leaks(shared.value, b.column(b.num_columns - 1)) if shared.value is not None else []:
                    keep[d] = False
                yield pa.RecordBatch.from_arrays(b.columns[:-1], b.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

        documents = documents.withColumn(fresh(documents.columns, "whole_text"), text_column()).mapInArrow(tidy(run), schema)
    return documents
