"""A corpus from raw documents to packed token sequences: each stage is one operator over all that the last one kept.

Stages take any table with doc_id (long) and text (string); other columns stay as they are, whatever their names. Null
texts count as empty. Empty tables go through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import fresh, lookup, materialize, text_column
from spanloom.llm.decontaminate import drop_contaminated
from spanloom.llm.line_dedup import dedup_lines
from spanloom.llm.near_copies import near_copies, sifted
from spanloom.llm.packing import pack_documents
from spanloom.llm.quality import fit_quality, score_quality
from spanloom.llm.queries import table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier predicts to be of quality. Every row is scored by itself, also one that repeats a
    doc_id or has none; without usable labels all stay."""
    score = fresh(docs.columns, "quality_score")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")), score)
    return scored.where(scored[score] >= 0.5).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share, except in the document that keeps them. Every row stays; one
    without a doc_id keeps its lines, rows of one doc_id are one document."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that share five-word shingles to a Jaccard similarity of 0.8 or more: the one with
    the smallest doc_id, then the smallest hash of the text, then the smallest other columns. Texts that repeat a doc_id
    are rows by themselves; rows without a doc_id stay."""
    tid = fresh(docs.columns, "tid")
    groups = materialize(near_copies(docs.select("doc_id", "text")), "near-groups")
    keys = materialize(groups.groupBy("root", "doc_id", "tid").agg(F.count("*").alias("rows")), "near-keys")
    least = materialize(keys.groupBy("root").agg(F.min(F.struct("doc_id", "tid")).alias("least"), F.count("*").alias("n")), "near-least")
    marks = lookup(keys, least, ["root"], "n").select("doc_id", F.col("tid").alias(tid), (F.struct("doc_id", "tid") == F.col("least")).alias("stays"), "rows").where("not stays or rows > 1")
    marks = materialize(marks, "near-marks")
    maybe = fresh([*docs.columns, tid], "maybe")
    keyed = sifted(docs.withColumn(tid, F.xxhash64(text_column())), marks, ["doc_id", tid], maybe)
    plain = keyed.where(~F.col(maybe)).unionByName(keyed.where(maybe).join(marks, ["doc_id", tid], "left_anti")).select(*docs.columns)
    repeated = keyed.where(maybe).join(marks.where("stays"), ["doc_id", tid], "left_semi")
    return plain.unionByName(repeated.groupBy("doc_id", tid).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose texts hold no benchmark item; each by itself."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts, packed into sequences; each row has at least one piece, its end mark."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("packing", pack)]

#: A classifier, a tokenizer and SimHash are among the stages: tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
