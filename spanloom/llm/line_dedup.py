"""Line-level deduplication with DataFrame functions only.

Line hashes are range-partitioned and sorted by hash, document and position. In that order a line's first row is in the
document that keeps it, and the row of its fifth document makes it frequent: both are read off the sorted stream, in the
partition where it lies. Lines so frequent that they would fill a partition are cut into several ranges of their own,
whose counts and first documents are carried over to one another. What comes back is a compressed keep bitmap for each
document, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import materialize, text_column

_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is. The general function does the same for ASCII texts, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def split_lines(text: Column) -> Column:
    """The lines of a text; one empty line for an empty one."""
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at its ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(_BLANK)))


def line_table(documents: DataFrame, min_chars: int = 40) -> DataFrame:
    """doc_id, tid (a hash of the text, which tells rows of one doc_id apart), pos, and two independent 64-bit hashes
    h1, h2 of the key, for each line whose key has at least `min_chars` code points. Rows without a doc_id take no part."""
    text = text_column()
    lines = documents.where("doc_id is not null").select("doc_id", F.xxhash64(text).alias("tid"), F.posexplode(split_lines(text)).alias("pos", "line"))
    long = lines.where(F.char_length("line") >= min_chars).select("doc_id", "tid", "pos", line_key(F.col("line")).alias("key"))
    return long.where(F.char_length("key") >= min_chars).select("doc_id", "tid", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def hot_lines(table: DataFrame, sample: int = 1_000_000, share: int = 1000) -> DataFrame:
    """h1, h2 of the lines that make up more than one in `share` of some rows of the table: fewer than `share` of them.
    They only settle how lines are dealt to partitions; results don't depend on them."""
    rows = table.count()
    some = table if rows <= sample else table.sample(sample / rows, seed=1)
    return some.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > min(rows, sample) / share).select("h1", "h2")


def keep_bitmaps(documents: DataFrame, min_chars: int = 40, min_docs: int = 5, keep: str = "last", spread: int = 64, share: int = 1000) -> DataFrame:
    """(doc_id, tid, n_dropped, runs) for each document that loses lines: the bitmap as run containers, that is the
    bounds of its runs of zeros (dropped lines): the first position of each and the first behind it.

    A key that at least `min_docs` documents hold stays only in the one with the largest ("last") or smallest ("first")
    doc_id. Hot lines are cut into `spread` ranges by document, each streamed by itself; what is carried over between the
    ranges of a line is two numbers.
    """
    table = materialize(line_table(documents, min_chars), "lines")
    hot = materialize(hot_lines(table, share=share).withColumn("hot", F.lit(True)), "hot-lines")
    dealt = table.join(F.broadcast(hot), ["h1", "h2"], "left")  # fewer than `share` rows
    dealt = dealt.withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(spread))).otherwise(0))
    first = F.col("doc_id").desc() if keep == "last" else F.col("doc_id").asc()
    ranges = dealt.repartitionByRange("h1", "h2", "part").sortWithinPartitions("h1", "h2", "part", first, "pos")
    line = Window.partitionBy("h1", "h2", "part")  # met by the ranges and their order: no further exchange or sort
    stream = line.orderBy(first)
    ranges = ranges.withColumns({"nth": F.dense_rank().over(stream), "keeper": F.first("doc_id").over(stream)}).withColumn("held", F.max("nth").over(line))
    wanted = F.col("hot") | ((F.col("held") >= min_docs) & (F.col("doc_id") != F.col("keeper")))
    often = materialize(ranges.where(wanted).select("h1", "h2", "part", "hot", "held", "keeper", "doc_id", "tid", "pos"), "frequent-lines")
    each = often.where("hot").groupBy("h1", "h2", "part").agg(F.max("held").alias("held"), F.max("keeper").alias("keeper"))
    carried = each.groupBy("h1", "h2").agg(F.sum("held").alias("held"), (F.max if keep == "last" else F.min)("keeper").alias("keeper")).where(F.col("held") >= min_docs)
    cut = often.where("hot").select("h1", "h2", "doc_id", "tid", "pos").join(F.broadcast(carried), ["h1", "h2"]).where("doc_id <> keeper")  # fewer than `share` rows
    dropped = often.where("hot is null").select("doc_id", "tid", "pos").unionByName(cut.select("doc_id", "tid", "pos"))
    rows = dropped.groupBy("doc_id", "tid").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    return rows.select("doc_id", "tid", F.size("p").cast("long").alias("n_dropped"), _runs(F.col("p")).alias("runs"))


def let(value: Column, use) -> Column:
    """use(value), the value computed once rather than for each element of a lambda that looks at it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _runs(positions: Column) -> Column:
    """Run bounds of sorted positions: where each run of them begins, and where it has ended, in turn."""

    def of(p: Column) -> Column:
        starts = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) < x - 1))
        ends = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) > x + 1))
        return F.flatten(F.zip_with(starts, ends, lambda s, e: F.array(s, e + 1)))

    return let(positions, of)


def dropped_positions(runs: Column) -> Column:
    """The positions that a keep bitmap drops."""
    pairs = F.filter(runs, lambda _, i: i % 2 == 0)
    ends = F.filter(runs, lambda _, i: i % 2 == 1)
    return F.flatten(F.zip_with(pairs, ends, lambda s, e: F.sequence(s, e - 1)))


def lines_without(text: Column, gone: Column) -> Column:
    """The lines of a text at other positions, joined by newlines."""

    def of(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    return let(split_lines(text), of)


def apply_bitmaps(documents: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """row (the row of documents), n_lines, n_dropped and kept: the text of the lines that stay, joined by newlines."""
    text = text_column("row.text")
    whole = documents.select(F.struct(*documents.columns).alias("row"))
    there = (F.col("row.doc_id") == F.col("b.doc_id")) & (F.xxhash64(text) == F.col("b.tid"))
    marked = whole.join(bitmaps.withColumn("gone", dropped_positions(F.col("runs"))).alias("b"), there, "left")
    kept = F.when(F.col("gone").isNull(), text).otherwise(lines_without(text, F.col("gone")))
    n = (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return marked.select("row", n.alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def dedup_lines(documents: DataFrame, **how) -> DataFrame:
    """documents, texts without the dropped lines; n_chars, where there is such a column, follows. Other columns stay,
    whatever their names.

    Null and empty texts have one empty line. Rows without a doc_id keep all lines. Rows that repeat a doc_id count as
    one document, and each loses its own lines. An empty table gives an empty one.
    """
    done = apply_bitmaps(documents, keep_bitmaps(documents.select("doc_id", "text"), **how))
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept")}
    return done.select(*[new[f.name].cast(f.dataType).alias(f.name) if f.name in new else F.col("row")[f.name].alias(f.name) for f in documents.schema])


def line_report(documents: DataFrame, **how) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each row of documents; odd rows as in dedup_lines."""
    slim = documents.select("doc_id", "text")
    done = apply_bitmaps(slim, keep_bitmaps(slim, **how))
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
