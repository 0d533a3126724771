"""Refinement of spans in a sentence to a fixed point. Each step is a function (text, spans) -> spans over sets of
(start, end); spans are visited in order, so that results don't depend on chance. A sentence is one row of an Arrow
batch: the steps look at each other's results, and have no column form."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.operators.brackets import CLOSE, OPEN, PAIRS, repair, typed_balanced, unmatched

Span = tuple[int, int]
Spans = set[Span]
SPANS = "array<struct<start:int,end:int,text:string>>"
MARKS = ",.!?;:"
# Words before and behind a span that belong to it.
BEFORE = re.compile("glacial|cyclic|hydrate|amino", re.I)
BEHIND = re.compile("acid|isomer|ether|ester", re.I)
# A code of a lipid.
_LIPID = re.compile(r"\(?\d+:(?:0\D|[1-9])")
# Texts that are no names.
EXCLUDED = "trust|ham$|ow$|[a-wz]y$|hz|echo$|orks?$|burg|guideline|suite|process|^tea$|ic$|coronal|gue$|ion$|tead$|able$|proxy$|gether|hy$|meter|success|watch|threshold|epoxy|determin|risk|intermediate|intern|incubate|debate|subset|\\wtype|scop(?:e|ic|ie)|cop(?:y|ies)$|perform|ics$|^mode|^state|-of-|xy$|water|-based$"


def previous_word(text: str, start: int) -> Span | None:
    """Bounds of the word between the last two blanks before start, without one trailing mark."""
    blank = text.rfind(" ", 0, start)
    if blank <= 0:
        return None
    begin = text.rfind(" ", 0, blank) + 1
    return (begin, blank - 1) if blank > begin and text[blank - 1] in MARKS + " " else (begin, blank)


def next_word(text: str, end: int) -> Span | None:
    """Bounds of the word behind the first blank at or after end, without one trailing mark."""
    blank = text.find(" ", end)
    if blank < 0 or blank + 1 >= len(text) - 1:
        return None
    stop = text.find(" ", blank + 1)
    stop = len(text) if stop < 0 else stop
    return (blank + 1, stop - 1) if stop > blank + 1 and text[stop - 1] in MARKS + " " else (blank + 1, stop)


def merge_overlapping(text: str, spans: Spans) -> Spans:
    """Spans that overlap or touch become one."""
    out: list[Span] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return set(out)


def merge_close(text: str, spans: Spans) -> Spans:
    """Spans one character apart become one."""
    out: list[Span] = []
    for s, e in sorted(spans):
        if out and s - out[-1][1] == 1:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return set(out)


def _extends_left(text: str, start: int, end: int, word: str, names: set[str], stop: frozenset[str]) -> tuple[bool, bool]:
    """(whether the word before belongs to the span, whether it does so across any gap)."""
    here = text[start:end]
    digits = here[:1].isdigit() and here[0] != "0" and word[-1].isdigit()
    touch = here[:1] in ("-", ",") or word.endswith("-")
    lipid = bool(_LIPID.match(here)) and word.lower() not in stop
    fits = word in names or bool(BEFORE.search(word)) or lipid or text.startswith(("acid", "ester"), start) or touch or digits
    return fits and "acid" not in word, digits


def extend_to_neighbours(text: str, spans: Spans, stop: frozenset[str] = frozenset()) -> Spans:
    """Take in neighbouring words by the rules for words before and behind; spans that are taken in disappear."""
    out = set(spans)
    names = {text[s:e] for s, e in spans}
    for span in sorted(spans):
        if span not in out:
            continue
        start, end = span
        while word := previous_word(text, start):
            if word[0] == word[1]:
                word = previous_word(text, word[0])
                if not word or word[0] == word[1]:
                    break
            fits, far = _extends_left(text, start, end, text[slice(*word)], names, stop)
            if not fits or (start - word[1] > 1 and not far):
                break
            out.discard(word)
            start = word[0]
        while end > start and (word := next_word(text, end)) and word[0] < word[1]:
            here, behind = text[start:end], text[slice(*word)]
            bare = not re.search("[a-z()]", here, re.I) or re.search(r"^\d.*\d$", text)
            fits = behind in names or BEHIND.search(behind) or bare or here[-1] == "-" or behind[0] == "-" or re.search("[α-ω]$", here)
            if "acid" in here or not fits or word[0] - end > 1:
                break
            out.discard(word)
            end = word[1]
        if (start, end) != span:
            out.discard(span)
            out.add((start, end))
    return out


def _anchor(text: str, span: Span) -> Span | None:
    """The span of the repaired text within the span."""
    fixed = repair(text[slice(*span)])
    at = text.find(fixed, *span)
    return (at, at + len(fixed)) if fixed and at >= 0 else None


def close_brackets(text: str, spans: Spans) -> Spans:
    """Repair each span's brackets, reach for the partners of those left alone, and repair again. A partner that the
    sentence does not have leaves the bound where it is."""
    out: Spans = set()
    for span in sorted(spans):
        fixed = _anchor(text, span)
        if not fixed:
            continue
        start, end = fixed
        for i in reversed(unmatched(text[start:end])):
            c = text[fixed[0] + i]
            if c in OPEN:
                partner = next(k for k, v in PAIRS.items() if v == c)
                at = text.find(partner, end)
                end = at + 1 if at >= 0 else end
            else:
                at = text.rfind(PAIRS[c], 0, start)
                start = at if at >= 0 else start
        if again := _anchor(text, (start, end)):
            out.add(again)
    return out


def _complete_once(text: str, span: Span) -> list[Span]:
    """The span from behind the last blank before it to the first blank behind it, without a mark at either end, and
    without brackets that enclose balanced text or stand alone at an end of it; cut at colons between letters."""
    start = text.rfind(" ", 0, span[0]) + 1
    end = text.find(" ", span[1])
    end = len(text) if end < 0 else end
    end -= text[end - 1 : end] in list(".,:!?&;=")
    start += text[start : start + 1] in list(".,:!?&;=")
    here = text[start:end]
    if not here:
        return []
    if PAIRS.get(here[-1]) == here[0]:
        inside = typed_balanced(here[1:-1])
        start, end = start + inside, end - inside
    elif here[0] in OPEN:
        start += typed_balanced(here[1:])
    elif here[-1] in CLOSE:
        end -= typed_balanced(here[:-1])
    here = text[start:end]
    bounds = [m.start() for m in re.finditer(":", here)] if re.search("[A-Za-z]:[A-Za-z]", here) else []
    parts = zip([0, *(b + 1 for b in bounds)], [*bounds, len(here)], strict=True)
    return [(start + a, start + b) for a, b in parts if b > a]


def complete_words(text: str, spans: Spans) -> Spans:
    """Three rounds of widening to whole words, trimming marks, unwrapping brackets and splitting at colons."""
    for _ in range(3):
        spans = {new for span in sorted(spans) for new in _complete_once(text, span)}
    return spans


def exclude(text: str, spans: Spans, patterns: str = EXCLUDED) -> Spans:
    """Spans of over one character whose text matches none of the patterns."""
    bad = re.compile(patterns, re.I)
    return {(s, e) for s, e in spans if e - s > 1 and not bad.search(text[s:e])}


STEPS: list[Callable[[str, Spans], Spans]] = [merge_overlapping, extend_to_neighbours, close_brackets, merge_overlapping, merge_close, complete_words]


def refine(text: str, spans: Spans, patterns: str = EXCLUDED) -> list[Span]:
    """The steps again and again until the spans are ones that have been before, then the exclusion; sorted. Mostly that
    is a fixed point; where the steps go in a circle, it is the first set of the circle that comes again. Spans have bounds in the text,
    so this always ends."""
    spans = {(max(s, 0), min(e, len(text))) for s, e in spans if s < e}
    seen: set[frozenset[Span]] = set()
    while frozenset(spans) not in seen:
        seen.add(frozenset(spans))
        for step in STEPS:
            spans = step(text, spans) if spans else spans
    return sorted(exclude(text, spans, patterns))


def step_udf(step: Callable[[str, Spans], Spans | list[Span]]) -> Callable[[Column, Column], Column]:
    """A column function (text, spans) -> spans with their texts, sorted by start, of one of the steps above."""

    @F.pandas_udf(SPANS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            out = []
            for t, given in zip(texts, spans, strict=True):
                got = sorted(step(t, {(int(x["start"]), int(x["end"])) for x in given})) if t is not None and given is not None else []
                out.append([{"start": s, "end": e, "text": t[s:e]} for s, e in got])
            yield pd.Series(out)

    return run


def dominant(candidates: list[tuple[int, int, float]]) -> list[bool]:
    """By descending score, equal ones in order: whether none of a candidate's characters is taken by a dominant one."""
    taken: list[Span] = []
    out = [False] * len(candidates)
    for i in sorted(range(len(candidates)), key=lambda i: -candidates[i][2]):
        s, e, _ = candidates[i]
        if all(e <= a or s >= b for a, b in taken):
            out[i] = True
            taken.append((s, e))
    return out
