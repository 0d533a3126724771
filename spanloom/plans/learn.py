"""Queries over statistics, joins with lexicons and vectors, and models."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import stats
from spanloom.functions import text as tx
from spanloom.functions import tokens as tk
from spanloom.operators import forest, tagger
from spanloom.plans.storage import scratch_path
from spanloom.sources.files import save_table
from spanloom.plans.catalog import WORDS, distinct_words, query, table
from spanloom.plans import lexicons
from spanloom.plans.tokenize import _FLAG_LIST, _GRAMS, _SHAPE, TOKENS, labelled, turn_tokens, word_features


@query("agg_1", f"WITH {TOKENS} SELECT value, count(*) AS n FROM k GROUP BY value")
def agg_1(spark: SparkSession, d: str) -> DataFrame:
    return turn_tokens(spark, d).groupBy("value").agg(F.count("*").alias("n"))


_VOCAB = f"{TOKENS}, vc AS (SELECT value, count(*) AS n, min(turn_id * 100000 + id) AS first FROM k GROUP BY value HAVING count(*) > 2), vo AS (SELECT value, n, row_number() OVER (ORDER BY first) AS idx FROM vc)"


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """value, n, idx: values seen over twice, numbered from 1 in the order of their first places; 0 is padding.

    The numbers come from a range sort and the sizes of its parts, so that the values never meet in one task.
    """
    first = F.min(F.col("turn_id") * 100000 + F.col("id")).alias("first")
    v = turn_tokens(spark, d).groupBy("value").agg(F.count("*").alias("n"), first).where("n > 2")
    return dense_rank_by(v, "first", "idx")


def dense_rank_by(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with 1, 2, ... in the order of a column of distinct values. Parts of a range sort are numbered within, and the
    sizes of the earlier parts added; only one number for each part is gathered."""
    part = df.repartitionByRange(column).withColumn("__part", F.spark_partition_id())
    parts = save_table(part, scratch_path(df.sparkSession, "ranks"))
    sizes = sorted((r["__part"], r["n"]) for r in parts.groupBy("__part").agg(F.count("*").alias("n")).collect())  # a row for each part
    starts = dict(zip([p for p, _ in sizes], accumulate([0, *(n for _, n in sizes)]), strict=False))
    before = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("__part")) if starts else F.lit(0)
    own = F.row_number().over(Window.partitionBy("__part").orderBy(column))
    return parts.withColumn(name, (own + before).cast("long")).drop("__part")


@query("agg_2", f"WITH {_VOCAB} SELECT value, idx FROM vo UNION ALL SELECT '[PAD]', 0 UNION ALL SELECT '[UNK]', (SELECT count(*) + 1 FROM vo)")
def agg_2(spark: SparkSession, d: str) -> DataFrame:
    v = vocabulary(spark, d).select("value", "idx")
    pad = spark.createDataFrame([("[PAD]", 0)], "value string, idx long")
    unknown = v.agg((F.count("*") + 1).alias("idx")).select(F.lit("[UNK]").alias("value"), "idx")
    return v.unionByName(pad).unionByName(unknown)


@query("join_9", f"WITH {_VOCAB} SELECT k.turn_id, CAST(sum(coalesce(vo.idx, 99999)) AS BIGINT) AS ids, count(vo.idx) AS known FROM k LEFT JOIN vo ON vo.value = k.value GROUP BY k.turn_id")
def join_9(spark: SparkSession, d: str) -> DataFrame:
    t = turn_tokens(spark, d).join(vocabulary(spark, d).select("value", "idx"), "value", "left")
    return t.groupBy("turn_id").agg(F.sum(F.coalesce("idx", F.lit(99999))).alias("ids"), F.count("idx").alias("known"))


@query("agg_3", r"WITH x AS (SELECT DISTINCT doc_id // 2 AS pair, unnest(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS w FROM documents) SELECT w, count(*) AS df FROM x GROUP BY w")
def agg_3(spark: SparkSession, d: str) -> DataFrame:
    return pair_frequency(spark, d)


def pair_frequency(spark: SparkSession, d: str) -> DataFrame:
    """df of each word over pairs of neighbouring documents."""
    each = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 2).alias("pair"), F.explode(F.array_distinct(tk.words(F.col("text")))).alias("w"))
    return each.distinct().groupBy("w").agg(F.count("*").alias("df"))


_SIDES = r"""o AS (SELECT DISTINCT w, toxic FROM (SELECT unnest(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS w, toxic FROM documents JOIN labels ON documents.doc_id = labels.doc_id)),
u AS (SELECT w, max(toxic) AS target FROM o GROUP BY w HAVING min(toxic) = max(toxic))"""


def unambiguous(spark: SparkSession, d: str) -> DataFrame:
    """w, target: words that occur in texts of one label only."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    each = docs.select("toxic", F.explode(F.array_distinct(tk.words(F.col("text")))).alias("w"))
    return each.groupBy("w").agg(F.min("toxic").alias("a"), F.max("toxic").alias("target")).where("a = target").select("w", "target")


@query("set_2", f"WITH {_SIDES} SELECT target, count(*) AS n, min(w) AS least, max(w) AS greatest FROM u GROUP BY target")
def set_2(spark: SparkSession, d: str) -> DataFrame:
    return unambiguous(spark, d).groupBy("target").agg(F.count("*").alias("n"), F.min("w").alias("least"), F.max("w").alias("greatest"))


@query("srt_3", f"WITH {_SIDES} SELECT w, target FROM u ORDER BY md5(w), w")
def srt_3(spark: SparkSession, d: str) -> DataFrame:
    return unambiguous(spark, d).orderBy(F.md5("w"), "w")


_MI = f"""{_SIDES}, {lexicons.feature_sql('u', _SHAPE, _GRAMS, _FLAG_LIST)},
f AS (SELECT DISTINCT w, target, unnest(f) AS feature FROM ft),
n AS (SELECT count(*) AS total, sum(target) AS pos FROM u),
c AS (SELECT feature, CAST(sum(target) AS BIGINT) AS joint, count(*) AS a FROM f GROUP BY feature),
e AS (SELECT feature, joint, a, CAST(pos AS DOUBLE) AS b, CAST(total AS DOUBLE) AS t FROM c, n),
mi AS (SELECT feature, joint, a, (CASE WHEN joint * t < a * b THEN -1 ELSE 1 END) * (
  CASE WHEN joint > 0 THEN joint / t * ln(joint * t / (a * b)) ELSE 0 END + CASE WHEN a - joint > 0 THEN (a - joint) / t * ln((a - joint) * t / (a * (t - b))) ELSE 0 END
  + CASE WHEN b - joint > 0 THEN (b - joint) / t * ln((b - joint) * t / ((t - a) * b)) ELSE 0 END + CASE WHEN t - a - b + joint > 0 THEN (t - a - b + joint) / t * ln((t - a - b + joint) * t / ((t - a) * (t - b))) ELSE 0 END) AS mi FROM e)"""


def feature_counts(spark: SparkSession, d: str) -> DataFrame:
    """feature, joint, a, mi over distinct words. Two totals reach the driver."""
    u = unambiguous(spark, d)
    known = lexicons.with_memberships(u, lexicons.lexicon(spark, d))
    f = known.select("w", "target", F.explode(lexicons.forest_features(F.col("w"))).alias("feature"))
    c = f.groupBy("feature").agg(F.sum("target").cast("long").alias("joint"), F.count("*").alias("a"))
    total = u.agg(F.count("*").cast("double").alias("t"), F.coalesce(F.sum("target"), F.lit(0)).cast("double").alias("b")).first()
    return c.withColumn("mi", stats.signed_information(F.col("joint"), F.col("a"), F.lit(total.b), F.lit(total.t)))


@query("agg_5", f"WITH {_MI} SELECT feature, joint, a FROM mi")
def agg_5(spark: SparkSession, d: str) -> DataFrame:
    return feature_counts(spark, d).select("feature", "joint", "a")


@query("agg_6", f"WITH {_MI} SELECT feature, round(mi, 8) AS mi FROM mi")
def agg_6(spark: SparkSession, d: str) -> DataFrame:
    return feature_counts(spark, d).select("feature", F.round("mi", 8).alias("mi"))


@query("top_1", f"WITH {_MI} SELECT feature, round(mi, 8) AS mi FROM mi ORDER BY round(abs(mi), 10) DESC, feature LIMIT 1000")
def top_1(spark: SparkSession, d: str) -> DataFrame:
    return feature_counts(spark, d).orderBy(F.round(F.abs("mi"), 10).desc(), "feature").limit(1000).select("feature", F.round("mi", 8).alias("mi"))


_WEIGHTED = rf"""{_SIDES}, f AS (SELECT DISTINCT w, unnest(['ws=' || {_SHAPE}, 'suf3=' || right(w, 3), 'suf2=' || right(w, 2)]) AS feature FROM u),
pr AS (SELECT DISTINCT doc_id // 2 AS pair, unnest(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS w FROM documents), df AS (SELECT w, count(*) AS df FROM pr GROUP BY w),
wt AS (SELECT feature, CAST(sum(df) AS BIGINT) AS n FROM f JOIN df ON df.w = f.w GROUP BY feature)"""


def weighted_features(spark: SparkSession, d: str) -> DataFrame:
    """feature, n: shapes and suffixes of unambiguous words, each as often as the word is in a pair of documents."""
    f = unambiguous(spark, d).join(pair_frequency(spark, d), "w")
    each = f.select("df", F.explode(tx.direct_features(F.col("w"))).alias("feature"))
    return each.groupBy("feature").agg(F.sum("df").alias("n"))


@query("agg_7", f"WITH {_WEIGHTED} SELECT feature, n FROM wt")
def agg_7(spark: SparkSession, d: str) -> DataFrame:
    return weighted_features(spark, d)


@query("top_2", f"WITH {_WEIGHTED} SELECT feature, n FROM wt ORDER BY n DESC, feature LIMIT 100")
def top_2(spark: SparkSession, d: str) -> DataFrame:
    return weighted_features(spark, d).orderBy(F.col("n").desc(), "feature").limit(100)


_SCORED = "sc AS (SELECT d.doc_id, (d.doc_id * 37 + length(d.text)) % 101 / 100.0 AS score, toxic, row_number() OVER (ORDER BY d.doc_id) - 1 AS pos FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return docs.select("doc_id", (((F.col("doc_id") * 37 + F.char_length("text")) % 101) / 100.0).alias("score"), "toxic")


@query("agg_8", f"WITH {_SCORED}, x AS (SELECT count(*) FILTER (WHERE score > 0.5 AND toxic = 1) AS tp, count(*) FILTER (WHERE score > 0.5 AND toxic = 0) AS fp, count(*) FILTER (WHERE score <= 0.5 AND toxic = 1) AS fn, count(*) FILTER (WHERE score <= 0.5 AND toxic = 0) AS tn FROM sc) SELECT *, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM x")
def agg_8(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).agg(*stats.confusion(F.col("score"), F.col("toxic")))


@query("agg_9", "SELECT source, round(sum(toxic * n_chars) / sum(n_chars), 6) AS loss, round(sum(quality * n_chars) / sum(n_chars), 6) AS accuracy FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY source")
def agg_9(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    weighted = lambda c: F.round(F.sum(F.col(c) * F.col("n_chars")) / F.sum("n_chars"), 6)
    return docs.groupBy("source").agg(weighted("toxic").alias("loss"), weighted("quality").alias("accuracy"))


@query("grp_1", f"WITH {TOKENS}, b AS (SELECT turn_id, count(*) AS size FROM k GROUP BY turn_id) SELECT size, count(*) AS n, CAST(sum(turn_id) AS BIGINT) AS members FROM b WHERE size > 1 GROUP BY size")
def grp_1(spark: SparkSession, d: str) -> DataFrame:
    sizes = turn_tokens(spark, d).groupBy("turn_id").agg(F.count("*").alias("size")).where("size > 1")
    return sizes.groupBy("size").agg(F.count("*").alias("n"), F.sum("turn_id").alias("members"))


@query("grp_2", f"WITH {TOKENS}, b AS (SELECT turn_id, count(*) AS size FROM k GROUP BY turn_id), r AS (SELECT *, (row_number() OVER (PARTITION BY size ORDER BY turn_id) - 1) // 4 AS batch FROM b) SELECT size, batch, count(*) AS n, min(turn_id) AS first FROM r GROUP BY size, batch")
def grp_2(spark: SparkSession, d: str) -> DataFrame:
    sizes = turn_tokens(spark, d).groupBy("turn_id").agg(F.count("*").alias("size"))
    batch = F.floor((F.row_number().over(Window.partitionBy("size").orderBy("turn_id")) - 1) / 4).alias("batch")
    return sizes.select("size", "turn_id", batch).groupBy("size", "batch").agg(F.count("*").alias("n"), F.min("turn_id").alias("first"))


@query("join_7", f"WITH {WORDS}, {lexicons.LEXICON_SQL} SELECT w, {lexicons.MEMBER_SQL} FROM w")
def join_7(spark: SparkSession, d: str) -> DataFrame:
    return lexicons.with_memberships(distinct_words(spark, d), lexicons.lexicon(spark, d))


@query("join_8", "SELECT d.doc_id, CASE WHEN e.vec_id IS NULL THEN 0 ELSE 1 END AS known, round(CAST(coalesce(e.embedding[1], 0) AS DOUBLE), 6) AS x FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def join_8(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    v = table(spark, d, "documents").select("doc_id").join(e, F.col("doc_id") == F.col("vec_id"), "left")
    vec = F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), 64))
    return v.select("doc_id", F.col("vec_id").isNotNull().cast("int").alias("known"), F.round(F.get(vec, F.lit(0)).cast("double"), 6).alias("x"))


# A fixed small forest over a word's length and share of digits: (tree, node, feature, threshold, left, right, value); a
# leaf's feature is -2
_WORD_NODES = [(0, 0, 0, 6.0, 1, 2, 0.0), (0, 1, -2, 0.0, 0, 0, 0.2), (0, 2, 1, 0.25, 3, 4, 0.0), (0, 3, -2, 0.0, 0, 0, 0.6), (0, 4, -2, 0.0, 0, 0, 0.9), (1, 0, 1, 0.1, 1, 2, 0.0), (1, 1, -2, 0.0, 0, 0, 0.1), (1, 2, -2, 0.0, 0, 0, 0.8)]
_DIGITS = "length(regexp_replace(w, '[^0-9]', '', 'g'))"
_WORD_SCORES = rf"""ca AS (SELECT w, round(avg(toxic), 6) AS cached FROM (SELECT DISTINCT l.doc_id, toxic, unnest(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS w FROM documents JOIN labels l ON documents.doc_id = l.doc_id) GROUP BY w),
ws AS (SELECT w.w, coalesce(ca.cached, round({forest.score_sql(_WORD_NODES, ["length(w.w)", "length(regexp_replace(w.w, '[^0-9]', '', 'g')) / length(w.w)"])}, 6)) AS score, ca.cached IS NOT NULL AS known FROM w LEFT JOIN ca ON ca.w = w.w)"""


def word_scores(spark: SparkSession, d: str) -> DataFrame:
    """w, score, known: the score that is cached for a word of labelled texts (here the share of toxic ones among the texts
    that hold it), and the forest's for all others."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    cached = docs.select("doc_id", "toxic", F.explode(F.array_distinct(tk.words(F.col("text")))).alias("w")).distinct().groupBy("w").agg(F.round(F.avg("toxic"), 6).alias("cached"))
    n = F.char_length("w")
    x = F.array(n.cast("double"), F.char_length(F.regexp_replace("w", "[^0-9]", "")) / n)
    w = distinct_words(spark, d).join(cached, "w", "left")
    return w.select("w", F.coalesce("cached", F.round(forest.score_column(_WORD_NODES, x), 6)).alias("score"), F.col("cached").isNotNull().alias("known"))


@query("join_10", f"WITH {WORDS}, {_WORD_SCORES} SELECT w, score, known FROM ws")
def join_10(spark: SparkSession, d: str) -> DataFrame:
    return word_scores(spark, d)


_NUMBERS = f"""length(w), round(ln(length(w)), 6), round(sqrt(length(w)), 6), length(regexp_replace(w, '[a-z]', '', 'g')), round(length(regexp_replace(w, '[a-z]', '', 'g')) / length(w), 6),
  length(regexp_replace(w, '[A-Za-z]', '', 'g')), round(length(regexp_replace(w, '[A-Za-z]', '', 'g')) / length(w), 6), {_DIGITS}, {", ".join(lexicons.IN_VECTOR)}, {", ".join(f"CAST(regexp_matches(w, '{p}') AS INT)" for p in tx.FLAGS.values())}"""


@query("str_8", f"""WITH {WORDS}, {_WEIGHTED}, nn AS (SELECT list(feature ORDER BY n DESC, feature) AS sel FROM (SELECT feature, n FROM wt ORDER BY n DESC, feature LIMIT 100)),
{_WORD_SCORES}, {lexicons.LEXICON_SQL}, fl AS (SELECT *, {lexicons.MEMBER_SQL} FROM ws)
SELECT w, list_concat(list_concat([score], list_transform(sel, lambda s: CAST(s IN ('ws=' || {_SHAPE}, 'suf3=' || right(w, 3), 'suf2=' || right(w, 2)) AS DOUBLE))), [{_NUMBERS}]::DOUBLE[]) AS vector FROM fl, nn""")
def str_8(spark: SparkSession, d: str) -> DataFrame:
    """The whole vector of a word: its score, a bit for each of the hundred selected direct features, and 23 numbers."""
    selected = [r.feature for r in top_2(spark, d).collect()]  # a hundred rows
    known = lexicons.with_memberships(word_scores(spark, d), lexicons.lexicon(spark, d))
    numbers = [*tx.numerics(F.col("w")).values(), *lexicons.IN_VECTOR, *[F.col("w").rlike(p).cast("int") for p in tx.FLAGS.values()]]
    numbers = [(F.col(c) if isinstance(c, str) else c).cast("double") for c in numbers]
    bits = tx.encode(tx.direct_features(F.col("w")), selected).cast("array<double>")
    return known.select("w", F.concat(F.array("score"), bits, F.array(*numbers)).alias("vector"))


_ABBR = r"ab AS (SELECT item_id, w[1] AS short, w[2] || ' ' || w[3] AS long FROM (SELECT item_id, string_split(lower(regexp_replace(text, '[,.\n]', '', 'g')), ' ') AS w FROM benchmark)), ke AS (SELECT * FROM ab WHERE regexp_extract(long, '^[a-z]+ [a-z]+', 0) = long)"


def two_words(text: Column) -> Column:
    """A recogniser: the first entity of a text, here two lower-case words at its head; empty where there is none."""
    return F.regexp_extract(text, "^[a-z]+ [a-z]+", 0)


def kept_abbreviations(spark: SparkSession, d: str, first_entity: Callable[[Column], Column] = two_words) -> DataFrame:
    """item_id, short, long of pairs whose expansion is, as a whole, the first entity that a recogniser finds in it."""
    w = F.split(F.lower(F.regexp_replace("text", "[,.\n]", "")), " ")
    pairs = table(spark, d, "benchmark").select("item_id", F.get(w, F.lit(0)).alias("short"), F.concat_ws(" ", F.get(w, F.lit(1)), F.get(w, F.lit(2))).alias("long"))
    return pairs.where(first_entity(F.col("long")) == F.col("long"))


@query("join_11", f"WITH {_ABBR} SELECT item_id, short, long FROM ke")
def join_11(spark: SparkSession, d: str) -> DataFrame:
    return kept_abbreviations(spark, d)


def _places_sql(source: str, key: str, kept: str, on: str) -> str:
    return rf"""{_ABBR}, {kept}, px AS (SELECT {key}, regexp_extract_all(lower(text), '[0-9a-z_]+|[^0-9a-z_]+') AS p FROM {source}), pp AS (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM px),
pq AS (SELECT {key}, p[i] AS v, CAST(sum(length(p[i])) OVER (PARTITION BY {key} ORDER BY i) AS BIGINT) AS e FROM pp) SELECT {", ".join("pq." + k.strip() for k in key.split(","))}, e - length(v) AS start, e AS "end", short FROM pq JOIN sh ON {on}"""


def whole_words(df: DataFrame, text: Column, *key: str) -> DataFrame:
    """key, short, start, end of each run of word characters of a text in lower case."""
    runs = df.select(*key, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z_]+|[^0-9a-z_]+"), 0)).alias("i", "short"))
    end = F.sum(F.char_length("short")).over(Window.partitionBy(*key).orderBy("i"))
    placed = runs.select(*key, "short", end.alias("end")).withColumn("start", F.col("end") - F.char_length("short"))
    return placed.where(F.col("short").rlike("^[0-9a-z_]"))


@query("join_12", "WITH " + _places_sql("conversations", "conv_id, turn", "sh AS (SELECT DISTINCT short FROM ke WHERE length(short) > 3)", "sh.short = pq.v"))
def join_12(spark: SparkSession, d: str) -> DataFrame:
    """All places of kept abbreviations as whole words. An abbreviation of word characters stands between word bounds just
    where it is a whole run of such characters, so runs meet abbreviations by equality, not by a pattern each."""
    short = kept_abbreviations(spark, d).where(F.char_length("short") > 3).select("short").distinct()
    return whole_words(table(spark, d, "conversations"), F.col("text"), "conv_id", "turn").join(short, "short").select("conv_id", "turn", "start", "end", "short")


@query("ml_10", "WITH " + _places_sql("benchmark", "item_id", "sh AS (SELECT DISTINCT item_id, short FROM ke)", "sh.short = pq.v AND sh.item_id = pq.item_id"))
def ml_10(spark: SparkSession, d: str) -> DataFrame:
    """For each article the places of its own abbreviations: those whose expansion a recogniser takes as a whole."""
    own = kept_abbreviations(spark, d).select("item_id", "short").distinct()
    return whole_words(table(spark, d, "benchmark"), F.col("text"), "item_id").join(own, ["item_id", "short"]).select("item_id", "start", "end", "short")


@query("join_13", f"WITH {_SCORED} SELECT pos % 5 AS fold, count(*) AS test, (SELECT count(*) FROM sc) - count(*) AS train, CAST(sum(toxic) AS BIGINT) AS toxic FROM sc GROUP BY 1")
def join_13(spark: SparkSession, d: str) -> DataFrame:
    folds = dense_rank_by(scored(spark, d), "doc_id", "pos").withColumn("fold", (F.col("pos") - 1) % 5)
    each = folds.groupBy("fold").agg(F.count("*").alias("test"), F.sum("toxic").alias("toxic"))
    total = folds.count()
    return each.select("fold", "test", (F.lit(total) - F.col("test")).alias("train"), "toxic")


def training_rows(spark: SparkSession, d: str, width: int = 100) -> DataFrame:
    """w, x, y: for each unambiguous word a bit for each of the `width` features of most information, and its side."""
    top = feature_counts(spark, d).orderBy(F.round(F.abs("mi"), 10).desc(), "feature").limit(width)
    selected = [r.feature for r in top.select("feature").collect()]  # `width` rows
    known = lexicons.with_memberships(unambiguous(spark, d), lexicons.lexicon(spark, d))
    bits = tx.encode(lexicons.forest_features(F.col("w")), selected).cast("array<double>")
    return save_table(known.select("w", bits.alias("x"), F.col("target").cast("double").alias("y")), scratch_path(spark, "training"))


@query("ml_1")
def ml_1(spark: SparkSession, d: str) -> DataFrame:
    """A forest of 100 trees with a fixed seed over the words' feature bits, and its scores."""
    rows = training_rows(spark, d)
    return forest.score_with_model(forest.fit(rows, trees=100), rows)


@query("ml_2")
def ml_2(spark: SparkSession, d: str) -> DataFrame:
    """Scores of five folds, each from a forest of 100 trees that has not seen the fold, and beside them those of the last
    forest, which is fitted on all rows."""
    rows = dense_rank_by(training_rows(spark, d), "w", "pos")
    last = forest.score_with_model(forest.fit(rows, trees=100), rows).select("w", F.col("score").alias("refit"))
    return forest.out_of_fold(rows, trees=100).join(last, "w")


@query("ml_3")
def ml_3(spark: SparkSession, d: str) -> DataFrame:
    """A fitted forest as a node table."""
    return forest.export(spark, forest.fit(training_rows(spark, d), trees=20))


# A fixed small forest: (tree, node, feature, threshold, left, right, value); a leaf's feature is -2
_NODES = [(0, 0, 0, 20.0, 1, 2, 0.0), (0, 1, -2, 0.0, 0, 0, 0.2), (0, 2, 1, 0.5, 3, 4, 0.0), (0, 3, -2, 0.0, 0, 0, 0.6), (0, 4, -2, 0.0, 0, 0, 0.9), (1, 0, 1, 0.4, 1, 2, 0.0), (1, 1, -2, 0.0, 0, 0, 0.1), (1, 2, -2, 0.0, 0, 0, 0.8)]
_NODE_SQL = ", ".join(str(n) for n in _NODES)


@query("ml_4", rf"""WITH RECURSIVE nd(tree, node, feature, threshold, l, r, value) AS (VALUES {_NODE_SQL}),
x AS (SELECT p_partkey, [CAST(p_size AS DOUBLE), p_retailprice % 1.0] AS x FROM part),
wk AS (SELECT p_partkey, x, tree, 0 AS node FROM x, (SELECT DISTINCT tree FROM nd) t
  UNION ALL SELECT wk.p_partkey, wk.x, wk.tree, CASE WHEN wk.x[nd.feature + 1] <= nd.threshold THEN nd.l ELSE nd.r END FROM wk JOIN nd ON nd.tree = wk.tree AND nd.node = wk.node WHERE nd.feature <> -2)
SELECT wk.p_partkey, round(avg(nd.value), 6) AS score FROM wk JOIN nd ON nd.tree = wk.tree AND nd.node = wk.node WHERE nd.feature = -2 GROUP BY wk.p_partkey""")
def ml_4(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice") % 1.0).alias("x"))
    return x.select("p_partkey", F.round(forest.score_column(_NODES, F.col("x")), 6).alias("score"))


_LEAVES = rf"""WITH RECURSIVE nd(tree, node, feature, threshold, l, r, value) AS (VALUES {_NODE_SQL}),
x AS (SELECT p_partkey, [CAST(p_size AS DOUBLE), p_retailprice % 1.0] AS x FROM part),
wk AS (SELECT p_partkey, x, tree, 0 AS node FROM x, (SELECT DISTINCT tree FROM nd) t
  UNION ALL SELECT wk.p_partkey, wk.x, wk.tree, CASE WHEN wk.x[nd.feature + 1] <= nd.threshold THEN nd.l ELSE nd.r END FROM wk JOIN nd ON nd.tree = wk.tree AND nd.node = wk.node WHERE nd.feature <> -2)
SELECT wk.p_partkey, list(wk.node ORDER BY wk.tree) AS leaves FROM wk JOIN nd ON nd.tree = wk.tree AND nd.node = wk.node WHERE nd.feature = -2 GROUP BY wk.p_partkey"""


@query("ml_5", _LEAVES)
def ml_5(spark: SparkSession, d: str) -> DataFrame:
    """The leaf of each tree that a row ends in."""
    x = table(spark, d, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice") % 1.0).alias("x"))
    return x.select("p_partkey", forest.leaf_columns(_NODES, F.col("x")).alias("leaves"))


#: Turns that a tagger is trained on, those of least hash, and the most tokens of one.
TAGGER_SAMPLE, TAGGER_TOKENS = 200, 32


def tagger_sequences(spark: SparkSession, d: str) -> DataFrame:
    """turn_id, features, embedding, scores, tags of each turn, a list for each token. No trained vectors or classifiers
    are to be had: the embedding is made of hashes of the lower-cased token, the class scores of its first characters."""
    value = F.col("value")
    numbers = [x.cast("double") for x in tx.flags(value)] + [F.least(F.char_length(value), F.lit(20)) / 20.0]
    near = [(F.pmod(F.xxhash64(F.lower(value), F.lit(k)), F.lit(2001)) - 1000) / 1000.0 for k in range(8)]
    scores = [F.when(F.pmod(F.ascii(F.substring(value, k + 1, 1)), F.lit(5)) == k, 1.0).otherwise(0.0) for k in range(len(tagger.TAGS))]
    tokens = labelled(spark, d)
    each = F.struct("id", F.array(*numbers).alias("f"), F.array(*near).alias("e"), F.array(*scores).alias("s"), "tag")
    own = tokens.groupBy("turn_id").agg(F.array_sort(F.collect_list(each)).alias("t"))
    return own.select("turn_id", F.col("t.f").alias("features"), F.col("t.e").alias("embedding"), F.col("t.s").alias("scores"), F.array_join("t.tag", "").alias("tags"))


def trained_tagger(sequences: DataFrame, vectors: str, epochs: int, batch: int | None) -> tuple[tagger.Tagger, list[tuple[int, float, float]]]:
    """A tagger of the sample, and its history of training."""
    short = sequences.where(F.size("features").between(2, TAGGER_TOKENS)).orderBy(F.xxhash64("turn_id"), "turn_id").limit(TAGGER_SAMPLE)
    rows = [(np.array(r.features), np.array(r[vectors]), np.array([tagger.TAGS.index(c) for c in r.tags])) for r in short.collect()]  # TAGGER_SAMPLE rows
    model = tagger.Tagger(len(rows[0][0][0]), len(rows[0][1][0])) if rows else tagger.Tagger(1, 1)
    return model, tagger.train(model, rows, epochs, batch)


def _tagged(spark: SparkSession, d: str, vectors: str, epochs: int, batch: int | None) -> DataFrame:
    sequences = save_table(tagger_sequences(spark, d), scratch_path(spark, "sequences"))
    model, _ = trained_tagger(sequences, vectors, epochs, batch)
    return tagger.tag(model, sequences.withColumn("vectors", F.col(vectors)), "turn_id")


@query("ml_6")
def ml_6(spark: SparkSession, d: str) -> DataFrame:
    """Tags of whole turns by a network over features and word vectors, trained on whole lengths at a time."""
    return _tagged(spark, d, "embedding", 30, None)


@query("ml_7")
def ml_7(spark: SparkSession, d: str) -> DataFrame:
    """Tags of whole turns by a network over features and the class scores of a token classifier, trained by fours."""
    return _tagged(spark, d, "scores", 10, 4)


@query("ml_8")
def ml_8(spark: SparkSession, d: str) -> DataFrame:
    """Loss and accuracy of each epoch of both ways of training."""
    sequences = save_table(tagger_sequences(spark, d), scratch_path(spark, "sequences"))
    a, b = trained_tagger(sequences, "embedding", 30, None)[1], trained_tagger(sequences, "scores", 10, 4)[1]
    rows = [("a", *x) for x in a] + [("b", *x) for x in b]
    return spark.createDataFrame(rows, "model string, epoch int, loss double, accuracy double")


@query("ml_9")
def ml_9(spark: SparkSession, d: str) -> DataFrame:
    """Batch scoring through an injected model function: here a stub that follows from the words, since weights of the
    networks are not to be had, and reads whole texts (null: empty). Texts of one length go to one task, as batches of one shape need it."""

    w = table(spark, d, "conversations").withColumn("size", F.size(tk.words(F.col("text"))))
    parts = spark.sparkContext.defaultParallelism
    dealt = w.withColumn("part", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(parts)))  # a common length goes to several tasks
    return dealt.repartition("size", "part").select("conv_id", "turn", stub_model(F.coalesce("text", F.lit(""))).alias("score"))


def stub_model(text: Column) -> Column:
    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: (sum(map(ord, t)) % 101) / 100.0)

    return run(text)


@query("ml_11", f"WITH {TOKENS}, dw AS (SELECT DISTINCT value, length(value) AS n FROM k) SELECT k.turn_id, CAST(sum(dw.n) AS BIGINT) AS n FROM k JOIN dw ON dw.value = k.value GROUP BY k.turn_id")
def ml_11(spark: SparkSession, d: str) -> DataFrame:
    """Features once for each distinct token, joined back."""
    t = turn_tokens(spark, d)
    memo = t.select("value").distinct().withColumn("n", F.char_length("value"))
    return t.join(memo, "value").groupBy("turn_id").agg(F.sum("n").alias("n"))
