"""Licence scans with DataFrame functions only, by a positional index of rare licence words.

Templates are short licence texts with a mandatory key phrase. A first pass counts in how many texts each licence word
is; that gives its weight (IDF). The index is a table of postings: licence word, template, position. Each file is looked
up by the highest-weighted of its licence words that lead a posting list; the postings of the next rarest words of the
same template are intersected with these by relative position, the key phrase is verified word by word, and the weight
that agrees with the rest of the template is the score. The plan has one join with the postings, however many templates
there are.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import materialize, text_column
from spanloom.llm.line_dedup import lower_ascii

#: Postings of one template that are intersected: its rarest key words.
ANCHORS = 3


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str  # consecutive words of the text that must be there
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        w, k = self.words, self.key_words
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


# Phrases whose every place counts, and their labels.
BASE = [Template("mit", "under the mit license", "under the mit license", True), Template("apache-2", "apache license version 2", "apache license version 2", True), Template("cc-by-nc", "cc by nc", "cc by nc", True)]
# Openings of well-known licence texts and notices, with the phrase that must be there.
TEMPLATES = [
    *BASE,
    Template("gpl-3", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "general public license version 2"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge to any person"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "modify and or distribute this software"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "may not use this file except in compliance with the license"),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", "affero general public license"),
    Template("epl-2", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    Template("cddl", "subject to the terms of the common development and distribution license", "common development and distribution license"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    Template("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "person or organization obtaining a copy of the software"),
    Template("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", "has dedicated the work to the public domain"),
    Template("ofl", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    Template("eupl", "licensed under the eupl version 1 2", "under the eupl"),
    Template("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee", "software and its documentation for any purpose without fee"),
    Template("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license", "license governs use of the accompanying software"),
]
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_column(text: Column) -> Column:
    """The words of a text, A-Z in lower case: runs of digits, ASCII letters and non-ASCII characters."""
    return F.array_remove(F.split(lower_ascii(text), _SEPARATOR, -1), "")


def _literal(words: list[str]) -> Column:
    """The words as one literal array (words hold no blanks)."""
    return F.split(F.lit(" ".join(words)), " ")


def word_weights(words: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """The IDF of each licence word over the rows of words (w: array of words). One count for each licence word reaches
    the driver."""
    held = words.select(F.explode(F.array_append(F.array_intersect("w", _literal(vocabulary)), "")).alias("word"))
    seen = {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}  # "" counts the rows
    n = seen.get("", 0)
    return {w: round(log(1 + n / seen.get(w, 0.5)), 6) if n else 1.0 for w in vocabulary}


_POSTING = "array<struct<word:string,label:string,base:boolean,held:array<string>,anchors:array<struct<word:string,at:int>>,key:array<string>,key_at:int,words:array<string>,weights:array<double>,total:double>>"


def postings(spark: SparkSession, templates: list[Template], weight: dict[str, float]) -> tuple[DataFrame, list[str]]:
    """The index, one row for each template's leading word (of the words of its key phrase the one with the highest
    weight) with the relative positions of the next rarest; and the leading words."""
    rows = []
    for t in templates:
        key = t.key_words
        ranked = sorted(range(len(key)), key=lambda i: (-weight[key[i]], key[i], i))[:ANCHORS]
        anchors = [{"word": key[i], "at": i} for i in ranked]
        weights = [weight[w] for w in t.words]
        rows.append({"word": anchors[0]["word"], "label": t.label, "base": t.base, "held": sorted(set(key)), "anchors": anchors, "key": key, "key_at": t.key_at, "words": t.words, "weights": weights, "total": sum(weights)})
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), _POSTING)))
    return table, sorted({r["word"] for r in rows})


def _places(words: Column, anchors: Column, key: Column) -> Column:
    """Where in the words the key phrase stands: the starts that the postings of all anchors agree on, verified."""

    def starts(anchor: Column) -> Column:
        return F.filter(F.transform(words, lambda w, i: F.when(w == anchor["word"], i - anchor["at"])), lambda s: s >= 0)

    agreed = F.aggregate(F.slice(anchors, 2, ANCHORS), starts(F.get(anchors, F.lit(0))), lambda found, a: F.array_intersect(found, starts(a)))
    return F.filter(agreed, lambda s: F.slice(words, s + 1, F.size(key)) == key)


def _score(words: Column, start: Column, template: Column, weights: Column, total: Column) -> Column:
    """The share of the template's weight whose words stand where they would if the template began at start."""
    agree = F.transform(template, lambda w, j: F.when(F.get(words, start + j) == w, F.get(weights, j)).otherwise(F.lit(0.0)))
    return F.round(F.aggregate(agree, F.lit(0.0), lambda a, x: a + x) / total, 6)


def scan_licenses(documents: DataFrame, least: float = 0.8, templates: list[Template] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of documents.

    A template counts where its key phrase stands and at least `least` of its weight agrees; score is the best of
    these, 0 if there is none. Null texts are empty: no words, no labels. Rows that repeat a doc_id, or have none, are
    scanned each; other columns are not looked at. An empty table gives no rows. What reaches the driver is one number
    for each licence word.
    """
    templates = templates or TEMPLATES
    vocabulary = sorted({w for t in templates for w in t.words})
    split = documents.select("doc_id", words_column(text_column()).alias("w"))
    index, leading = postings(documents.sparkSession, templates, word_weights(split, vocabulary))
    rare = split.select("doc_id", F.size("w").cast("long").alias("n_words"), F.array_intersect("w", _literal(leading)).alias("rare"), "w")
    held = F.when(F.size("rare") > 0, F.array_intersect("w", _literal(vocabulary)))
    files = rare.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "rare", held.alias("lic"), F.when(F.size("rare") > 0, F.col("w")).alias("w"))
    files = materialize(files, "licence-words")
    looked_up = files.where(F.size("rare") > 0).select("row", "lic", "w", F.explode("rare").alias("word"))
    found = looked_up.join(index, "word").where(F.size(F.array_except("held", "lic")) == 0)
    found = found.withColumn("places", _places(F.col("w"), F.col("anchors"), F.col("key"))).where(F.size("places") > 0)
    best = F.array_max(F.transform("places", lambda s: _score(F.col("w"), s - F.col("key_at"), F.col("words"), F.col("weights"), F.col("total"))))
    found = found.select("row", "label", "base", "places", best.alias("best")).withColumn("fits", F.col("best") >= least)

    def labels(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    base = F.col("base")
    whole = found.groupBy("row").agg(
        F.sum(F.when(base, F.size("places")).otherwise(0)).alias("n_base"),
        F.min(F.when(base, F.array_min("places"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.array_max("places"))).cast("long").alias("last_word"),
        labels(base & F.col("fits")).alias("base_labels"),
        labels(F.col("fits")).alias("labels"),
        F.max(F.when(F.col("fits"), F.col("best"))).alias("score"),
    )
    return files.select("row", "doc_id", "n_words").join(whole, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
