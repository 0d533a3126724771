"""Lexicons of words, names and extra names, a token's memberships in them, and its named features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.functions import tokens as tk
from spanloom.plans.catalog import table
from spanloom.sources.files import lexicon_pieces

# Names of the membership flags, in the order of the features; the first kind looks at the token as it is,
# the second at its lower-case form.
RAW, LOW = ("usdw", "chebi", "cs"), ("usdwl", "chebil", "chebiwl", "csl")
FLAGS = (*RAW, *LOW)
#: The memberships that go into a token's vector.
IN_VECTOR = ("usdw", "chebi", "usdwl", "chebil", "chebiwl")


def lexicon(spark: SparkSession, d: str) -> DataFrame:
    """kind, x: words (of the benchmark), pieces of names and whole names of one piece (of parts), extra names (nations)."""
    words = table(spark, d, "benchmark").select(F.explode(tk.words(F.col("text"))).alias("x"))
    names = table(spark, d, "part").select("p_name").distinct()
    pieces = lexicon_pieces(names, "p_name", tk.fine_tokens(F.col("p_name"))).select(F.col("kind").alias("k"), F.col("word").alias("x"))
    extra = table(spark, d, "nation").select(F.explode(tk.fine_tokens(F.col("n_name"))).alias("x"))
    kinds = {"usdw": words, "usdwl": words.select(F.lower("x").alias("x")), "cs": extra, "csl": extra.select(F.lower("x").alias("x"))}
    kinds |= {flag: pieces.where(F.col("k") == k).select("x") for flag, k in (("chebi", "piece"), ("chebil", "lower_piece"), ("chebiwl", "single"))}
    out = None
    for kind, frame in kinds.items():
        part = frame.select(F.lit(kind).alias("kind"), "x")
        out = part if out is None else out.unionByName(part)
    return out


def with_memberships(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """words (w, ...) with a 0/1 column for each flag. Two joins, whatever the number of lexicons; they are grouped by
    word before."""
    for kinds, key in ((RAW, F.col("w")), (LOW, F.lower("w"))):
        has = [F.max((F.col("kind") == k).cast("int")).alias(f"has_{k}") for k in kinds]
        known = lexicon.where(F.col("kind").isin(*kinds)).groupBy("x").agg(*has)
        words = words.join(known, key == F.col("x"), "left").drop("x")
    rest = [c for c in words.columns if not c.startswith("has_")]
    return words.select(*rest, *[F.coalesce(f"has_{k}", F.lit(0)).alias(k) for k in FLAGS])


def forest_features(w: Column) -> Column:
    """All named features of a token with its memberships beside it."""
    held = F.array_compact(F.array(*[F.when(F.col(k) == 1, F.lit(f"dict={k}")) for k in FLAGS]))
    return F.array_distinct(F.concat(tx.features(w), held))


_RX = r"'([A-Z]*[a-z]+|[A-Z]+|[0-9]+|\S)'"
LEXICON_SQL = rf"""lxw AS (SELECT DISTINCT unnest(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS x FROM benchmark),
lxn AS (SELECT DISTINCT p_name AS line, regexp_extract_all(p_name, {_RX}) AS p FROM part), lxp AS (SELECT unnest(p) AS x FROM lxn),
lxe AS (SELECT DISTINCT unnest(regexp_extract_all(n_name, {_RX})) AS x FROM nation),
lex AS (SELECT 'usdw' AS kind, x FROM lxw UNION SELECT 'chebi', x FROM lxp UNION SELECT 'cs', x FROM lxe UNION SELECT 'usdwl', lower(x) FROM lxw UNION SELECT 'chebil', lower(x) FROM lxp
  UNION SELECT 'chebiwl', lower(line) FROM lxn WHERE len(p) = 1 UNION SELECT 'csl', lower(x) FROM lxe)"""
MEMBER_SQL = ", ".join(f"CAST({'w' if k in RAW else 'lower(w)'} IN (SELECT x FROM lex WHERE kind = '{k}') AS INT) AS {k}" for k in FLAGS)
DICT_SQL = "list_filter([" + ", ".join(f"CASE WHEN {k} = 1 THEN 'dict={k}' END" for k in FLAGS) + "], lambda x: x IS NOT NULL)"


def feature_sql(source: str, shape: str, grams: str, flags: str) -> str:
    """Common table expressions lex, fl (source with memberships) and ft (with the list f of features), for a source
    that has a column w."""
    return f"{LEXICON_SQL}, fl AS (SELECT *, {MEMBER_SQL} FROM {source}), fx AS (SELECT *, '^' || w || '$' AS m FROM fl), ft AS (SELECT *, list_concat(list_concat(list_concat(['ws=' || {shape}], {grams}), {flags}), {DICT_SQL}) AS f FROM fx)"
