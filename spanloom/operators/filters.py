"""Rule filters over spans, as predicates and columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.refine import EXCLUDED

# Whole texts that are no names.
NO_NAMES = "alcohol transit preparing overload sheet result PC PE medicine vortex(e?) sherlock isomer acid ester ether oate xylate(d?) adrenal gas(e?) aldehyde".split(" ")
# Words that don't make a name of the acid, ester or ether they stand before.
NO_HEADS = (
    "urofuran κeto mineral halogenated gastric-tract keto included palmi representative fat to terminal total aqueous \\(caprylic\\) nuclei "
    "-hphaa\\)\\) acetoace without these aspartate for small various model(l?)ed \\(dpa\\) from amine maximum stomach different nuclear tract after "
    "\\(dha\\) polyunsaturated lewis standard sugar conjugate enhanced tagged other osbond others biliary \\(gca\\) cycle aa a-keto volatile "
    "prevent -bile mild lignocericc bile \\(c12\\) kyn fractional"
).split(" ")
#: One alternation for all of them, folded when the plan is built.
RULES = "|".join([f"^(?:{'|'.join(NO_NAMES)})s?$", "(?:ics|ia|yl)s?$", f"^(?:{'|'.join(NO_HEADS)}) (?:acid|ester|ether)s?$", "(?:ed|[^i]al) (?:acid|ester|ether)s?$"])


def not_excluded(text: Column, patterns: str = EXCLUDED) -> Column:
    """Over one character and no pattern found, in either case of letters."""
    return (F.char_length(text) > 1) & ~text.rlike(f"(?i)(?:{patterns})")


def passes_rules(text: Column, known: Column, patterns: str | None = None) -> Column:
    """Whether a span text stays: one that is no dictionary match needs over three characters and none of the patterns;
    every one must be clear of the fixed lists."""
    loose = F.char_length(text) > 3
    if patterns:
        loose = loose & ~text.rlike(f"(?i)(?:{patterns})")
    return (known | loose) & ~text.rlike(f"(?i)(?:{RULES})")


def sentence_rule(sentence: Column, text: Column, end: Column) -> Column:
    """A text that ends in `ic` stays only if its sentence ends behind it, and not before the next `acid`."""
    tail = F.substr(sentence, end + 1)
    stop = F.regexp_instr(tail, F.lit("[.;!?]"))
    acid = F.instr(tail, "acid")
    return ~text.endswith("ic") | ((stop > 0) & ((acid == 0) | (stop >= acid)))


def trimmed_end(text: Column, end: Column) -> Column:
    """The end without one trailing mark, and then without one more mark or blank."""
    once = F.regexp_replace(text, "[,.?:;!]$", "")
    twice = F.regexp_replace(once, "[,.?:;! ]$", "")
    return end - (F.char_length(text) - F.char_length(twice))


def cut_end(text: Column, start: Column) -> Column:
    """The end of a span whose text ends in `v v)`: before its last opening bracket and a blank before that; null, for a
    span that goes, where it has none. Ends of other spans stay. Ends are places of the sentence, as start is."""
    back = F.instr(F.reverse(text), "(")
    at = F.char_length(text) - back
    at = at - F.when(F.substr(text, at, F.lit(1)) == " ", 1).otherwise(0)
    mixed = text.rlike("v v\\)$")
    return F.when(~mixed, start + F.char_length(text)).when(back > 0, start + at)


def cure(found: DataFrame, sentence: str, known: str, patterns: str | None = None) -> DataFrame:
    """Spans (start, end, in the sentence column) that pass all rules for what a span's text may be, with trimmed and cut
    ends; `known` says which are dictionary matches. Other columns stay."""
    text = F.substr(F.col(sentence), F.col("start") + 1, F.col("end") - F.col("start"))
    kept = found.where(passes_rules(text, F.col(known), patterns) & sentence_rule(F.col(sentence), text, F.col("end")))
    kept = kept.withColumn("end", trimmed_end(text, F.col("end")).cast("int"))
    return kept.withColumn("end", cut_end(text, F.col("start")).cast("int")).where(F.col("end") > F.col("start"))


def any_of(patterns: list[str]) -> str:
    """One alternation of patterns, for one scan of each text."""
    return "|".join(f"(?:{p})" for p in patterns if p)


def literal(words: list[str]) -> str:
    return any_of([f"^{re.escape(w)}$" for w in words])
