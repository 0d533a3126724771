"""Registry of the queries over the driver's tables, and the frames and SQL that many of them begin with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import tokens as tk

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
# Short words that n-grams don't cross.
STOP = ["the", "of", "and", "de", "la", "der", "die", "le"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, sent_id, s: texts cut at full stops and newlines; empty sentences keep their number."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "[.\n]")).alias("sent_id", "s"))


def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """w: distinct words of all texts. Features are computed once for each."""
    return table(spark, sf_dir, "documents").select(F.explode(tk.words(F.col("text"))).alias("w")).distinct()


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term, n, first: the dictionary, lower-cased openings of two and three words of the benchmark's items."""
    w = tk.words(F.regexp_replace(F.lower("text"), "[,.!?;:]", ""))
    each = table(spark, sf_dir, "benchmark").select(F.explode(F.transform(F.array(F.lit(2), F.lit(3)), lambda n: F.array_join(F.slice(w, F.lit(1), n), " "))).alias("term"))
    return each.distinct().select("term", F.size(F.split("term", " ")).alias("n"), F.element_at(F.split("term", " "), 1).alias("first"))


def dictionary_matches(sents: DataFrame, dictionary: DataFrame, *key: str) -> DataFrame:
    """Distinct (key, gram) of the n-grams of s whose lower-case form is a term; grams don't cross a mark before a blank.

    Single words meet the first words of terms; only where one can begin is its sentence looked at again, for the words
    behind.
    """
    w = F.split(F.regexp_replace("s", "[,!?;:]$", ""), "[,!?;:]? ")
    each = sents.select(*key, F.posexplode(w).alias("pos", "x")).select(*key, "pos", F.lower("x").alias("first"))
    begins = each.join(dictionary, "first").select(*key, "pos", "term", "n").distinct()
    found = sents.select(*key, w.alias("w")).join(begins, list(key))
    gram = F.array_join(F.slice("w", F.col("pos") + 1, F.col("n")), " ")
    return found.withColumn("gram", gram).where(F.lower("gram") == F.col("term")).select(*key, "gram").distinct()


SENT = r"s AS (SELECT doc_id, CAST(i AS INT) - 1 AS sent_id, p[i] AS s FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '[.\n]') AS p FROM documents)))"
WORDS = r"w AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(text, '\s+')) AS w FROM documents) WHERE w <> '')"
TERMS = r"""b AS (SELECT string_split_regex(trim(regexp_replace(lower(text), '[,.!?;:]', '', 'g')), '\s+') AS w FROM benchmark),
t AS (SELECT DISTINCT array_to_string(w[1:n], ' ') AS term FROM b, (VALUES (2), (3)) AS k(n))"""
MATCHES = rf"""{SENT}, {TERMS},
sw AS (SELECT doc_id, sent_id, s, string_split_regex(regexp_replace(s, '[,!?;:]$', ''), '[,!?;:]? ') AS w FROM s),
g AS (SELECT DISTINCT doc_id, sent_id, s, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM sw), (VALUES (1), (2), (3), (4)) AS k(n) WHERE i + n - 1 <= len(w)),
m AS (SELECT g.* FROM g JOIN t ON lower(g.gram) = t.term WHERE gram <> '')"""
# All places of a gram, from left to right without overlap, by lengths of the pieces between them
SPANS = rf"""{MATCHES},
pc AS (SELECT *, string_split(s, gram) AS parts FROM m),
ix AS (SELECT *, unnest(range(1, len(parts))) AS i FROM pc),
pl AS (SELECT doc_id, sent_id, s, gram, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(gram) AS INT) AS start FROM ix),
sp AS (SELECT doc_id, sent_id, s, start, CAST(start + length(gram) AS INT) AS "end", gram FROM pl
  WHERE (start = 0 OR substr(s, start, 1) = ' ') AND (start + length(gram) + 1 >= length(s) OR strpos(',.!?;: ', substr(s, start + length(gram) + 1, 1)) > 0))"""
