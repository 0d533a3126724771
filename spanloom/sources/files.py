"""Sources and sinks: articles, corpus and annotation tables, lexicons, pattern lists, embeddings, abbreviations, models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "corpus string, section string, text string"
ANNOTATIONS = "corpus string, section string, start int, end int, name string"
ARTICLE = "paragraphs array<struct<IAO_term:array<string>,body:string>>"


def read_articles(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """A row for each paragraph: corpus, pos, terms, body. Without a `name` a file is one article and named by it, up to its
    first _; with one, a line is an article and has its name in that field."""
    schema = f"{ARTICLE}, {name} string" if name else ARTICLE
    df = spark.read.schema(schema).json(folder, multiLine=name is None)
    named = F.col(name) if name else F.element_at(F.split(F.col("_metadata.file_name"), "_"), 1)
    return df.select(named.alias("corpus"), F.posexplode("paragraphs").alias("pos", "p")).select("corpus", "pos", F.col("p.IAO_term").alias("terms"), F.col("p.body").alias("body"))


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    """A tab-separated table, UTF-8 with or without a mark at its head; texts are as written, NA included."""
    return spark.read.schema(schema).csv(path, sep="\t", quote='"', escape='"', header=header, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="", nullValue="\\N")


def write_tsv(df: DataFrame, path: str, *order: str) -> None:
    """A tab-separated table, sorted over all parts by `order`: a range sort, not one file. Empty texts are quoted, so
    that they come back empty."""
    (df.orderBy(*order) if order else df).write.csv(path, sep="\t", quote='"', escape='"', emptyValue='""', nullValue="\\N", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """name and its lower-case form, from a table with a header that has a column `name`."""
    df = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', nullValue="\\N", emptyValue="")
    return df.select("name", F.lower("name").alias("lower_name"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """word and its lower-case form, of distinct non-empty lines without blanks at their ends."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct().withColumn("lower_word", F.lower("word"))


def lexicon_pieces(lines: DataFrame, line: str, pieces: Column) -> DataFrame:
    """kind and word: pieces of the lines, their lower-case forms, and lower-case lines of one piece."""
    each = lines.select(line, pieces.alias("p"))
    raw = each.select(F.lit("piece").alias("kind"), F.explode("p").alias("word"))
    low = raw.select(F.lit("lower_piece").alias("kind"), F.lower("word").alias("word"))
    one = each.where(F.size("p") == 1).select(F.lit("single").alias("kind"), F.lower(line).alias("word"))
    return raw.unionByName(low).unionByName(one).distinct()


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """The patterns of a file that tabs separate; empty ones, which would match everything, go."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "[\t\n]")).alias("pattern"))
    return whole.where("pattern <> ''")


def exact_patterns(symbols: DataFrame, column: str) -> DataFrame:
    """Patterns that match the given words as a whole."""
    return symbols.select(F.concat(F.lit("^"), F.col(column), F.lit("$")).alias("pattern"))


def read_stop_words(spark: SparkSession, path: str | None) -> list[str]:
    """A short word list; none without a path."""
    return sorted(r.word for r in read_lines(spark, path).select("word").collect()) if path else []  # a fixed list of words


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """word and vec from lines of a word and numbers, separated by blanks."""
    parts = F.split("value", " ")
    vec = F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda x: x.cast("float"))
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("word"), vec.alias("vec"))


def read_abbreviations(spark: SparkSession, path: str) -> DataFrame:
    """kind, short, long from JSON objects {kind: {short: long}}."""
    return abbreviations(spark.read.text(path, wholetext=True), "value")


def abbreviations(df: DataFrame, json: str, *keep: str) -> DataFrame:
    kinds = df.select(*keep, F.explode(F.from_json(json, "map<string,map<string,string>>")).alias("kind", "pairs"))
    return kinds.select(*keep, "kind", F.explode("pairs").alias("short", "long"))


def save_table(df: DataFrame, path: str) -> DataFrame:
    """Models, prepared sequences and dumps: Parquet, written and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
