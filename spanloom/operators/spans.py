"""Span operators as DataFrame operations and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_overlapping(df: DataFrame, *key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Per key, spans that overlap or touch become one. One window by key and one aggregation on the same partitioning."""
    order = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(start) <= F.col("__reach"), 0).otherwise(1)).over(order)
    marked = df.withColumn("__reach", reach).withColumn("__island", island)
    return marked.groupBy(*key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def merge_close(df: DataFrame, *key: str, start: str = "start", end: str = "end", gap: int = 1) -> DataFrame:
    """Per key, chains of spans exactly `gap` apart become one."""
    order = Window.partitionBy(*key).orderBy(start, end)
    chained = F.col(start) - F.lag(end).over(order) == gap
    island = F.sum(F.when(chained, 0).otherwise(1)).over(order)
    return df.withColumn("__island", island).groupBy(*key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def bioes(token_start: Column, token_end: Column, start: Column, end: Column) -> Column:
    """The tag that a span gives a token; null for none."""
    inside = (token_start >= start) & (token_end <= end)
    tag = F.when((token_start == start) & (token_end == end), "S").when(token_start == start, "B").when(token_end == end, "E").otherwise("I")
    return (
        F.when(inside, tag)
        .when((token_start <= start) & (token_end >= end), "S")
        .when((token_start >= start) & (token_start <= end), "E")
        .when((token_end >= start) & (token_end <= end), "B")
    )


def label_tokens(tokens: DataFrame, spans: DataFrame, *key: str) -> DataFrame:
    """tokens (key, id, start, end) with `tag`: of the first span, by start and end, that gives one, else O. Spans of a
    key are gathered first, so that tokens are not multiplied by spans in the shuffle."""
    own = spans.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    tags = F.transform("__spans", lambda s: bioes(F.col("start"), F.col("end"), s["start"], s["end"]))
    first = F.get(F.array_compact(tags), F.lit(0))
    return tokens.join(own, list(key), "left").withColumn("tag", F.coalesce(first, F.lit("O"))).drop("__spans")


def revise_tags(df: DataFrame, *key: str, order: str = "id") -> DataFrame:
    """An E that no B or I precedes becomes O, except on a first token."""
    before = F.lag("tag").over(Window.partitionBy(*key).orderBy(order))
    return df.withColumn("tag", F.when((F.col("tag") == "E") & before.isNotNull() & ~before.isin("B", "I"), "O").otherwise(F.col("tag")))


def decode(tokens: DataFrame, *key: str, threshold: float = 0.5) -> DataFrame:
    """(key, start, end, score) of the candidate spans of scored tokens (key, id, start, end, s, o, i, e, b): single
    tokens with s over the threshold, and runs from a b over it to an e over it whose inner i are all over it; the score
    is the least of these.

    Tokens between two of too low an i form a run; a first and a last token meet by an equality join on the run, and the
    inner scores are looked up in the run's array.
    """
    order = Window.partitionBy(*key).orderBy("id")
    low = F.sum(F.when(F.col("i") > threshold, 0).otherwise(1)).over(order)
    t = tokens.withColumn("run", low)
    within = t.groupBy(*key, "run").agg(F.min("id").alias("at"), F.transform(F.array_sort(F.collect_list(F.struct("id", "i"))), lambda x: x["i"]).alias("inner"))
    first = t.where(F.col("b") > threshold).select(*key, "run", F.col("id").alias("from"), "start", "b")
    last = t.where(F.col("e") > threshold).select(*key, (F.col("run") - F.when(F.col("i") > threshold, 0).otherwise(1)).alias("run"), F.col("id").alias("to"), "end", "e")
    pairs = first.join(within, [*key, "run"]).join(last, [*key, "run"]).where(F.col("to") > F.col("from"))
    lowest = F.array_min(F.slice("inner", F.col("from") - F.col("at") + 2, F.col("to") - F.col("from") - 1))
    many = pairs.select(*key, "start", "end", F.least("b", "e", F.coalesce(lowest, F.lit(1.0))).alias("score"))
    return tokens.where(F.col("s") > threshold).select(*key, "start", "end", F.col("s").alias("score")).unionByName(many)


def locate_term(text: Column, term: Column) -> Column:
    """0-based starts of the non-overlapping places of a literal term, from left to right, that begin at the text's start
    or behind a blank and end at its end, before its last character, or before a mark or blank."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), term, F.lit("\\E")), -1)
    size = F.char_length(term)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    starts = F.aggregate(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        zero,
        lambda s, p: F.struct((s["at"] + F.char_length(p) + size).alias("at"), F.concat(s["found"], F.array(s["at"] + F.char_length(p))).alias("found")),
        lambda s: s["found"],
    )
    left = lambda i: (i == 0) | (F.substr(text, i, F.lit(1)) == " ")
    right = lambda i: (i + size + 1 >= F.char_length(text)) | F.substr(text, i + size + 1, F.lit(1)).isin(list(",.!?;: "))
    return F.filter(starts, lambda i: left(i) & right(i))
