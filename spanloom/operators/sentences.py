"""Sentences from tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Tokens that end a sentence, and tokens before them that keep it going.
ENDS = [".", "?", "!", '"']
ABBREVIATIONS = ["Fig", "al", "i.e", "ie", "eg", "e.g", "ref", "Dr", "Prof", "Sir"]


def number_sentences(tokens: DataFrame, *key: str) -> DataFrame:
    """tokens (key, id, value) with `ends` and `sentence`, counted from 0 within the key.

    An ending token does not end its sentence, if it has two tokens before it and one behind, where a quote follows no
    other ending, an abbreviation stands before it, or an ending or an all lower-case token behind it.
    """
    o = Window.partitionBy(*key).orderBy("id")
    before, after = F.lag("value").over(o), F.lead("value").over(o)
    held = ((F.col("value") == '"') & ~before.isin(ENDS)) | before.isin(ABBREVIATIONS) | after.isin(ENDS) | after.rlike("^[a-z]+$")
    flagged = tokens.withColumn("ends", F.col("value").isin(ENDS) & ~((F.col("id") >= 2) & after.isNotNull() & held))
    earlier = o.rowsBetween(Window.unboundedPreceding, -1)
    return flagged.withColumn("sentence", F.coalesce(F.sum(F.col("ends").cast("long")).over(earlier), F.lit(0)))


def sentence_texts(numbered: DataFrame, texts: DataFrame, *key: str, text: str = "text") -> DataFrame:
    """(key, sentence, s): the source from a sentence's first token to its last."""
    bounds = numbered.groupBy(*key, "sentence").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    cut = F.substr(F.col(text), (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int"))
    return bounds.join(texts, list(key)).select(*key, "sentence", cut.alias("s"))
