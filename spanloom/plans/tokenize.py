"""Queries over tokens, scalar functions and labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.functions import tokens as tk
from spanloom.operators import rule_tokens, sentences, spans
from spanloom.plans import lexicons
from spanloom.plans.catalog import SENT, WORDS, distinct_words, query, table
from spanloom.plans.catalog import sentences as all_sentences

_RX = r"'([A-Z]*[a-z]+|[A-Z]+|[0-9]+|\S)'"
TOKENS = rf"""pc AS (SELECT turn_id, regexp_extract_all(text, '\s*([A-Z]*[a-z]+|[A-Z]+|[0-9]+|\S)') AS p FROM (SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations)),
tp AS (SELECT turn_id, id, CAST(p[id + 1] AS VARCHAR) AS piece FROM (SELECT turn_id, p, unnest(range(0, len(p))) AS id FROM pc)),
tk AS (SELECT turn_id, CAST(id AS INT) AS id, regexp_replace(piece, '^\s+', '') AS value, CAST(sum(length(piece)) OVER (PARTITION BY turn_id ORDER BY id) AS BIGINT) AS "end" FROM tp),
k AS (SELECT turn_id, id, value, "end" - length(value) AS start, "end" FROM tk)"""


def turn_tokens(spark: SparkSession, d: str) -> DataFrame:
    """turn_id, id, value, start, end: fine tokens of the turns of conversations."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    return tk.with_fine_tokens(turns, "text", "turn_id")


@query("tok_1", "SELECT doc_id, CAST(len(string_split(text, '')) AS BIGINT) AS n, string_split(text, '')[1] AS first FROM documents")
def tok_1(spark: SparkSession, d: str) -> DataFrame:
    c = tk.characters(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(c).cast("long").alias("n"), F.get(c, F.lit(0)).alias("first"))


@query("tok_2", f'WITH {TOKENS} SELECT turn_id, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, CAST(sum("end") AS BIGINT) AS ends, min(value) AS least, max(value) AS greatest FROM k GROUP BY turn_id')
def tok_2(spark: SparkSession, d: str) -> DataFrame:
    return turn_tokens(spark, d).groupBy("turn_id").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.min("value").alias("least"), F.max("value").alias("greatest"))


@query("tok_2_documents", f"SELECT doc_id, CAST(len(regexp_extract_all(text, {_RX})) AS BIGINT) AS n FROM documents")
def tok_2_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(tk.fine_tokens(F.col("text"))).cast("long").alias("n"))


@query("tok_3_words", r"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS BIGINT) AS n FROM documents")
def tok_3_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(tk.words(F.col("text"))).cast("long").alias("n"))


@query("tok_3")
def tok_3(spark: SparkSession, d: str) -> DataFrame:
    """Rule tokens of all sentences, in one Arrow pass; a worker splits a blank-separated token once."""
    t = all_sentences(spark, d).withColumn("t", rule_tokens.rule_tokens(F.col("s")))
    return t.select("doc_id", "sent_id", F.explode("t").alias("t")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("t.end").alias("ends"), F.max("t.value").alias("greatest"))


@query("tok_4")
def tok_4(spark: SparkSession, d: str) -> DataFrame:
    """What the rules make of each distinct word of the pages and of the events' properties."""
    w = table(spark, d, "pages").select(F.explode(tk.words(F.col("html"))).alias("w")).unionByName(table(spark, d, "events").select(F.explode(tk.words(F.col("props"))).alias("w"))).distinct()
    return w.select("w", F.transform(rule_tokens.rule_tokens(F.col("w")), lambda t: t["value"]).alias("parts"))


@query("tok_5", f"WITH {WORDS} SELECT w, [substr(w, 1, 1), substr(w, 2, 2), substr(w, 4)] AS parts FROM w WHERE length(w) > 4")
def tok_5(spark: SparkSession, d: str) -> DataFrame:
    return distinct_words(spark, d).where(F.char_length("w") > 4).select("w", tk.split_at(F.col("w"), F.lit(1), F.lit(3)).alias("parts"))


_COMMA = r"^([^-\[(]+),[^-]"


@query("tok_6", f"WITH {WORDS}, c AS (SELECT w, CASE WHEN regexp_matches(w, '{_COMMA}') THEN length(regexp_extract(w, '{_COMMA}', 1)) ELSE length(w) - 1 END AS i FROM w) SELECT w, list_filter([left(w, i), substr(w, i + 1, 1), substr(w, i + 2)], lambda x: x <> '') AS parts FROM c WHERE length(w) > 1")
def tok_6(spark: SparkSession, d: str) -> DataFrame:
    """Words split on both sides of a character (the comma of the comma rule, else the last one); a split is taken only
    if over one part has text, which here is every word of two characters."""
    w = distinct_words(spark, d).withColumn("i", tk.comma_index(F.col("w")))
    i = F.when(F.col("i") < 0, F.char_length("w") - 1).otherwise(F.col("i"))
    return w.select("w", tk.accepted(tk.split_at(F.col("w"), i, i + 1)).alias("parts")).where("parts is not null")


@query("tok_7")
def tok_7(spark: SparkSession, d: str) -> DataFrame:
    """The hyphen that the rules split each hyphenated word at, -1 for none."""
    w = distinct_words(spark, d).unionByName(table(spark, d, "pages").select(F.explode(tk.words(F.col("html"))).alias("w")).distinct())
    return w.where(F.col("w").rlike(f"[{rule_tokens.HYPHENS}]")).distinct().select("w", rule_tokens.hyphen_column(F.col("w")).alias("at"))


@query("tok_8", f"WITH {WORDS} SELECT w, CAST(CASE WHEN regexp_matches(w, '{_COMMA}') THEN length(regexp_extract(w, '{_COMMA}', 1)) ELSE -1 END AS INT) AS at FROM w WHERE contains(w, ',')")
def tok_8(spark: SparkSession, d: str) -> DataFrame:
    return distinct_words(spark, d).where(F.contains("w", F.lit(","))).select("w", tk.comma_index(F.col("w")).alias("at"))


@query("tok_9", r"""WITH pc AS (SELECT conv_id, turn, regexp_extract_all(text, '\s*\S+') AS p FROM conversations), tp AS (SELECT conv_id, turn, p, unnest(range(1, len(p) + 1)) AS i FROM pc),
k AS (SELECT conv_id, turn, i, regexp_replace(p[i], '^\s+', '') AS v, CAST(sum(length(p[i])) OVER (PARTITION BY conv_id, turn ORDER BY i) AS BIGINT) AS e FROM tp),
b AS (SELECT *, e - length(v) AS s FROM k), c AS (SELECT *, list_concat(list_concat([s], list_filter(range(0, e, 7), lambda o: o > s)), [e]) AS cuts FROM b)
SELECT conv_id, turn, CAST(sum(len(cuts) - 1) AS BIGINT) AS n, CAST(sum(list_sum(cuts[1:len(cuts) - 1])) AS BIGINT) AS starts, md5(string_agg(array_to_string(list_transform(range(1, len(cuts)), lambda j: substr(v, CAST(cuts[j] - s AS INT) + 1, CAST(cuts[j + 1] - cuts[j] AS INT))), '|'), ' ' ORDER BY i)) AS parts FROM c GROUP BY conv_id, turn""")
def tok_9(spark: SparkSession, d: str) -> DataFrame:
    """Blank-separated tokens, cut at forced offsets as well: here at every seventh place of a turn."""
    offsets = F.transform(F.sequence(F.lit(0), F.floor(F.char_length("text") / 7)), lambda i: i * 7)
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text", offsets.alias("offsets"))
    k = tk.forced_tokens(turns, "text", "offsets", "conv_id", "turn")
    each = k.select("conv_id", "turn", "id", F.size("parts").alias("n"), F.aggregate("cuts", F.lit(0).cast("long"), lambda a, x: a + x).alias("s"), F.array_join("parts", "|").alias("t"))
    own = each.groupBy("conv_id", "turn").agg(F.sum("n").alias("n"), F.sum("s").alias("starts"), F.array_sort(F.collect_list(F.struct("id", "t"))).alias("t"))
    return own.select("conv_id", "turn", "n", "starts", F.md5(F.array_join(F.transform("t", lambda x: x["t"]), " ")).alias("parts"))


@query("tok_10", f"WITH {TOKENS} SELECT turn_id, max(value) FILTER (WHERE id = 1) AS second, string_agg(value, ' ' ORDER BY id) AS strings FROM k GROUP BY turn_id")
def tok_10(spark: SparkSession, d: str) -> DataFrame:
    own = turn_tokens(spark, d).groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("id", "value"))).alias("t"))
    values = F.transform("t", lambda t: t["value"])
    return own.select("turn_id", F.get(values, F.lit(1)).alias("second"), F.array_join(values, " ").alias("strings"))


@query("tok_11", f"""WITH {TOKENS}, g AS (SELECT turn_id, id, start - coalesce(lag("end") OVER (PARTITION BY turn_id ORDER BY id), 0) AS gap FROM k) SELECT turn_id, CAST(sum(gap) AS BIGINT) AS blanks, max(gap) AS widest FROM g GROUP BY turn_id""")
def tok_11(spark: SparkSession, d: str) -> DataFrame:
    before = F.coalesce(F.lag("end").over(Window.partitionBy("turn_id").orderBy("id")), F.lit(0))
    return turn_tokens(spark, d).withColumn("gap", F.col("start") - before).groupBy("turn_id").agg(F.sum("gap").alias("blanks"), F.max("gap").alias("widest"))


@query("tok_12", f"""WITH {TOKENS}, n AS (SELECT turn_id, id, lead(value, 2) OVER o AS ahead, CASE WHEN id > 1 THEN lag(value) OVER o END AS behind FROM k WINDOW o AS (PARTITION BY turn_id ORDER BY id)) SELECT turn_id, count(ahead) AS n_ahead, count(behind) AS n_behind, max(ahead) AS ahead, min(behind) AS behind FROM n GROUP BY turn_id""")
def tok_12(spark: SparkSession, d: str) -> DataFrame:
    o = Window.partitionBy("turn_id").orderBy("id")
    n = turn_tokens(spark, d).select("turn_id", F.lead("value", 2).over(o).alias("ahead"), F.when(F.col("id") > 1, F.lag("value").over(o)).alias("behind"))
    return n.groupBy("turn_id").agg(F.count("ahead").alias("n_ahead"), F.count("behind").alias("n_behind"), F.max("ahead").alias("ahead"), F.min("behind").alias("behind"))


_VOCAB = [*"abcdefghijklmnopqrstuvwxyz", *("##" + c for c in "abcdefghijklmnopqrstuvwxyz"), "the", "and", "##ing", "##tion", "th", "##er", "##ou"]


@query("tok_13")
def tok_13(spark: SparkSession, d: str) -> DataFrame:
    w = distinct_words(spark, d).select(F.lower("w").alias("w")).distinct()
    pieces = F.flatten(rule_tokens.wordpiece_udf(_VOCAB)(F.array("w")))
    return w.select("w", pieces.alias("pieces"))


@query("tok_14", r"SELECT doc_id, CAST(len(w[1:254]) AS BIGINT) AS n, w[254] AS last FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM documents)")
def tok_14(spark: SparkSession, d: str) -> DataFrame:
    w = tk.truncate(tk.words(F.col("text")), 256)
    return table(spark, d, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.get(w, F.lit(253)).alias("last"))


@query("tok_14_whole", r"""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM conversations),
x AS (SELECT conv_id, turn, i, sum(1 + length(w[i]) // 4) OVER (PARTITION BY conv_id, turn ORDER BY i) AS used FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w))
SELECT conv_id, turn, count(*) FILTER (WHERE used <= 100) AS fit FROM x GROUP BY conv_id, turn""")
def tok_14_whole(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "conversations").select("conv_id", "turn", tk.words(F.col("text")).alias("w"))
    counts = F.transform("w", lambda x: (F.lit(1) + F.floor(F.char_length(x) / 4)).cast("int"))
    return w.where(F.size("w") > 0).select("conv_id", "turn", tk.whole_within(counts, 100).cast("long").alias("fit"))


@query("tok_15")
def tok_15(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def align(text: pd.Series, pieces: pd.Series) -> pd.Series:
        return pd.Series([[None if x is None else {"start": x[0], "end": x[1]} for x in rule_tokens.align_from_right(t, list(p))] for t, p in zip(text, pieces, strict=True)])

    w = tok_13(spark, d)
    return w.select("w", align(F.col("w"), F.col("pieces")).alias("places"))


@query("tok_16", r"""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM conversations)
SELECT conv_id, turn, md5(array_to_string(flatten(list_transform(w, lambda x: list_transform(range(0, 1 + length(x) // 4), lambda i: x))), ' ')) AS repeated FROM w""")
def tok_16(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "conversations").select("conv_id", "turn", tk.words(F.col("text")).alias("w"))
    counts = F.transform("w", lambda x: (F.lit(1) + F.floor(F.char_length(x) / 4)).cast("int"))
    return w.select("conv_id", "turn", F.md5(F.array_join(tk.repeat_each(F.col("w"), counts), " ")).alias("repeated"))


_SENTENCE_SQL = rf"""{TOKENS},
f AS (SELECT *, lag(value) OVER o AS before, lead(value) OVER o AS after FROM k WINDOW o AS (PARTITION BY turn_id ORDER BY id)),
e AS (SELECT *, value IN ('.', '?', '!', '"') AND NOT (id >= 2 AND after IS NOT NULL AND ((value = '"' AND before NOT IN ('.', '?', '!', '"')) OR before IN ('Fig', 'al', 'i.e', 'ie', 'eg', 'e.g', 'ref', 'Dr', 'Prof', 'Sir') OR after IN ('.', '?', '!', '"') OR regexp_matches(after, '^[a-z]+$'))) AS ends FROM f),
n AS (SELECT *, CAST(coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY turn_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sentence FROM e)"""


@query("seg_1", f"WITH {_SENTENCE_SQL} SELECT turn_id, max(sentence) + 1 AS n, count(*) FILTER (WHERE ends) AS n_ends FROM n GROUP BY turn_id")
def seg_1(spark: SparkSession, d: str) -> DataFrame:
    s = sentences.number_sentences(turn_tokens(spark, d), "turn_id")
    return s.groupBy("turn_id").agg((F.max("sentence") + 1).alias("n"), F.count_if("ends").alias("n_ends"))


@query("seg_2", f"""WITH {_SENTENCE_SQL}, b AS (SELECT turn_id, sentence, min(start) AS start, max("end") AS "end" FROM n GROUP BY turn_id, sentence)
SELECT b.turn_id, sentence, substr(c.text, CAST(start AS INT) + 1, CAST("end" - start AS INT)) AS s FROM b JOIN conversations c ON c.conv_id * 1000 + c.turn = b.turn_id""")
def seg_2(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    return sentences.sentence_texts(sentences.number_sentences(turn_tokens(spark, d), "turn_id"), turns, "turn_id", text="text")


_SHAPE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '[0-9]+', '0', 'g'), '[a-z][a-z]+', '1', 'g'), '[a-z]', '2', 'g'), '[A-Z][A-Z]+', '3', 'g'), '[A-Z]', '4', 'g')"


@query("str_1", f"WITH {WORDS} SELECT {_SHAPE} AS shape, count(*) AS n, min(w) AS example FROM w GROUP BY 1")
def str_1(spark: SparkSession, d: str) -> DataFrame:
    return distinct_words(spark, d).groupBy(tx.shape(F.col("w")).alias("shape")).agg(F.count("*").alias("n"), F.min("w").alias("example"))


@query("str_2", f"WITH {WORDS} SELECT w, " + ", ".join(f"CAST(regexp_matches(w, '{p}') AS INT) AS re_{n.replace('2', 'two_')}" for n, p in tx.FLAGS.items()) + " FROM w")
def str_2(spark: SparkSession, d: str) -> DataFrame:
    return distinct_words(spark, d).select("w", *[F.col("w").rlike(p).cast("int").alias(f"re_{n.replace('2', 'two_')}") for n, p in tx.FLAGS.items()])


@query("str_3", rf"WITH {WORDS} SELECT w, length(w) AS n, round(ln(length(w)), 6) AS log_n, round(sqrt(length(w)), 6) AS sqrt_n, length(regexp_replace(w, '[a-z]', '', 'g')) AS other, round(length(regexp_replace(w, '[a-z]', '', 'g')) / length(w), 6) AS other_share, length(regexp_replace(w, '[A-Za-z]', '', 'g')) AS marks, round(length(regexp_replace(w, '[A-Za-z]', '', 'g')) / length(w), 6) AS marks_share, length(regexp_replace(w, '[^0-9]', '', 'g')) AS digits FROM w")
def str_3(spark: SparkSession, d: str) -> DataFrame:
    return distinct_words(spark, d).select("w", *[c.cast("long").alias(n) if n in ("n", "other", "marks", "digits") else c.alias(n) for n, c in tx.numerics(F.col("w")).items()])


_GRAMS = "list_concat(list_concat(list_transform(range(1, length(m) - 2), lambda i: '4g=' || substr(m, CAST(i AS INT), 4)), list_transform(range(1, length(m) - 1), lambda i: '3g=' || substr(m, CAST(i AS INT), 3))), list_concat(list_transform(range(1, length(m)), lambda i: '2g=' || substr(m, CAST(i AS INT), 2)), list_transform(range(1, length(w) + 1), lambda i: '1g=' || substr(w, CAST(i AS INT), 1))))"


@query("str_4", f"WITH {WORDS}, x AS (SELECT w, '^' || w || '$' AS m FROM w) SELECT w, CAST(len({_GRAMS}) AS BIGINT) AS n, md5(array_to_string({_GRAMS}, ' ')) AS grams FROM x")
def str_4(spark: SparkSession, d: str) -> DataFrame:
    g = distinct_words(spark, d).select("w", tx.char_grams(F.col("w")).alias("g"))
    return g.select("w", F.size("g").cast("long").alias("n"), F.md5(F.array_join("g", " ")).alias("grams"))


@query("str_5", f"WITH {WORDS} SELECT w, ['suf3=' || right(w, 3), 'suf2=' || right(w, 2)] AS suffixes FROM w")
def str_5(spark: SparkSession, d: str) -> DataFrame:
    return distinct_words(spark, d).select("w", tx.suffixes(F.col("w")).alias("suffixes"))


_FLAG_LIST = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(w, '{p}') THEN 're={n}' END" for n, p in tx.FLAGS.items()) + "], lambda x: x IS NOT NULL)"
FEATURES = f"{WORDS}, {lexicons.feature_sql('w', _SHAPE, _GRAMS, _FLAG_LIST)}"


def word_features(spark: SparkSession, d: str) -> DataFrame:
    """w, its memberships, and f, all its named features, for each distinct word."""
    known = lexicons.with_memberships(distinct_words(spark, d), lexicons.lexicon(spark, d))
    return known.withColumn("f", lexicons.forest_features(F.col("w")))


@query("str_6", f"WITH {FEATURES}, u AS (SELECT DISTINCT w, unnest(f) AS f FROM ft) SELECT w, count(*) AS n, min(f) AS least, max(f) AS greatest FROM u GROUP BY w")
def str_6(spark: SparkSession, d: str) -> DataFrame:
    return word_features(spark, d).select("w", F.size("f").cast("long").alias("n"), F.array_min("f").alias("least"), F.array_max("f").alias("greatest"))


_SELECTED = ["ws=1", "3g=the", "2g=^t", "1g=e", "re=num", "4g=ing$", "2g=ou", "re=2uc", "dict=usdw", "dict=usdwl"]
_BITS = "list_transform([" + ", ".join(f"'{s}'" for s in _SELECTED) + "], lambda s: CAST(list_contains(f, s) AS INT))"


@query("str_7", f"WITH {FEATURES} SELECT w, {_BITS} AS bits FROM ft")
def str_7(spark: SparkSession, d: str) -> DataFrame:
    return word_features(spark, d).select("w", tx.encode(F.col("f"), _SELECTED).alias("bits"))


@query("str_9", f"WITH {FEATURES}, n AS (SELECT DISTINCT unnest(f) AS feature FROM ft) SELECT feature, regexp_replace(feature, '[^\\x{{00}}-\\x{{FF}}]', '?', 'g') AS narrow FROM n WHERE regexp_matches(feature, '[^\\x{{00}}-\\x{{7F}}]')")
def str_9(spark: SparkSession, d: str) -> DataFrame:
    """Feature names beyond ASCII, which keep their text here, beside the narrow form in which code points over 255 are
    question marks and so would never be found again."""
    names = word_features(spark, d).select(F.explode("f").alias("feature")).distinct()
    return names.where(F.col("feature").rlike("[^\\x{00}-\\x{7F}]")).select("feature", tx.narrow(F.col("feature")).alias("narrow"))


BRACKETS = """p AS (SELECT DISTINCT props FROM (SELECT props FROM events UNION ALL SELECT substr(props, 2) FROM events UNION ALL SELECT left(props, length(props) - 1) FROM events UNION ALL SELECT ')' || p_name || '(' FROM part UNION ALL SELECT '(' || p_name || ']' FROM part)),
c AS (SELECT props, i, substr(props, CAST(i AS INT), 1) AS ch FROM (SELECT props, unnest(range(1, length(props) + 1)) AS i FROM p)),
v AS (SELECT props, i, CASE WHEN ch IN ('(', '[', '{') THEN 1 WHEN ch IN (')', ']', '}') THEN -1 ELSE 0 END AS step FROM c),
l AS (SELECT props, sum(step) OVER (PARTITION BY props ORDER BY i) AS up, sum(step) OVER (PARTITION BY props ORDER BY i DESC) AS down, sum(step) OVER (PARTITION BY props) AS final FROM v),
r AS (SELECT props, min(up) < 0 AS lacks_open, max(down) > 0 AS lacks_close, max(final) = 0 AND min(up) >= 0 AS balanced FROM l GROUP BY props)"""


def bracket_texts(spark: SparkSession, d: str) -> DataFrame:
    props = table(spark, d, "events").select("props")
    names = table(spark, d, "part").select("p_name")
    n = F.char_length("props")
    parts = [props, props.select(F.substr("props", F.lit(2)).alias("props")), props.select(F.left("props", n - 1).alias("props")), names.select(F.concat(F.lit(")"), "p_name", F.lit("(")).alias("props")), names.select(F.concat(F.lit("("), "p_name", F.lit("]")).alias("props"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


@query("str_10", f"WITH {BRACKETS} SELECT props, balanced FROM r")
def str_10(spark: SparkSession, d: str) -> DataFrame:
    return bracket_texts(spark, d).select("props", tx.brackets_balanced(F.col("props")).alias("balanced"))


@query("str_11", f"WITH {BRACKETS} SELECT props, lacks_open FROM r")
def str_11(spark: SparkSession, d: str) -> DataFrame:
    return bracket_texts(spark, d).select("props", tx.lacks_open(F.col("props")).alias("lacks_open"))


@query("str_12", f"WITH {BRACKETS} SELECT props, lacks_close FROM r")
def str_12(spark: SparkSession, d: str) -> DataFrame:
    return bracket_texts(spark, d).select("props", tx.lacks_close(F.col("props")).alias("lacks_close"))


@query("str_13", rf"WITH {BRACKETS}, o AS (SELECT props, length(props) >= 3 AND (left(props, 1) || right(props, 1)) IN ('()', '[]', '{{}}') AS pair FROM p) SELECT o.props, pair AND balanced AS bracketed FROM o JOIN r ON r.props = o.props")
def str_13(spark: SparkSession, d: str) -> DataFrame:
    # an outer pair around flat text: balanced as a whole and balanced inside are the same here
    return bracket_texts(spark, d).select("props", tx.bracketed(F.col("props")).alias("bracketed"))


def _python_text(name: str, kind: str, f):
    @query(name)
    def run(spark: SparkSession, d: str) -> DataFrame:
        @F.pandas_udf(kind)
        def one(s: pd.Series) -> pd.Series:
            return s.map(f)

        return bracket_texts(spark, d).select("props", one("props").alias("result"))


def _register_typed() -> None:
    from spanloom.operators.brackets import repair, typed_balanced

    _python_text("str_14", "boolean", typed_balanced)
    _python_text("str_15", "string", repair)


_register_typed()


@query("str_16", r"SELECT doc_id, CAST(length(regexp_replace(text, '[^\-‐‑‒–—―]', '', 'g')) AS BIGINT) AS hyphens, CAST(length(regexp_replace(text, '[^=<>≠≡≢≣≤≥≦≧≨≩≪≫]', '', 'g')) AS BIGINT) AS relations FROM documents")
def str_16(spark: SparkSession, d: str) -> DataFrame:
    count = lambda chars: F.char_length(F.regexp_replace("text", f"[^{chars}]", "")).cast("long")
    return table(spark, d, "documents").select("doc_id", count("\\" + rule_tokens.HYPHENS).alias("hyphens"), count(rule_tokens.RELATIONS).alias("relations"))


@query("str_17", f"""WITH {SENT}, x AS (SELECT doc_id, sent_id, substr(s, 1, CAST(length(s) // 2 AS INT)) AS h FROM s),
y AS (SELECT *, CASE WHEN strpos(h, ' ') > 0 THEN length(h) - strpos(reverse(h), ' ') END AS blank FROM x)
SELECT doc_id, sent_id, CASE WHEN blank > 0 THEN regexp_replace(string_split(substr(h, 1, CAST(blank AS INT)), ' ')[-1], '[,.!?;: ]$', '') END AS word FROM y""")
def str_17(spark: SparkSession, d: str) -> DataFrame:
    half = F.floor(F.char_length("s") / 2).cast("int")
    return all_sentences(spark, d).select("doc_id", "sent_id", tx.previous_word(F.col("s"), half).alias("word"))


@query("str_18", f"""WITH {SENT}, x AS (SELECT doc_id, sent_id, substr(s, CAST(length(s) // 2 AS INT) + 1) AS t FROM s),
y AS (SELECT *, strpos(t, ' ') AS blank FROM x)
SELECT doc_id, sent_id, CASE WHEN blank > 0 AND blank + 1 < length(t) THEN regexp_replace(string_split(substr(t, CAST(blank AS INT) + 1), ' ')[1], '[,.!?;: ]$', '') END AS word FROM y""")
def str_18(spark: SparkSession, d: str) -> DataFrame:
    half = F.floor(F.char_length("s") / 2).cast("int")
    return all_sentences(spark, d).select("doc_id", "sent_id", tx.next_word(F.col("s"), half).alias("word"))


@query("str_19", f"WITH {WORDS} SELECT lower(w) AS low, count(*) AS n FROM w GROUP BY 1 HAVING count(*) > 1")
def str_19(spark: SparkSession, d: str) -> DataFrame:
    return distinct_words(spark, d).groupBy(F.lower("w").alias("low")).agg(F.count("*").alias("n")).where("n > 1")


# Spans over the turns' tokens: capitalised words, and their neighbours half-way into a word
_CAPS = """cs AS (SELECT turn_id, start, "end" FROM k WHERE regexp_matches(value, '^[A-Z]') AND length(value) > 3 UNION ALL SELECT turn_id, start + 2, "end" + 3 FROM k WHERE length(value) > 6 AND id % 5 = 0)"""
_TAGS = f"""{TOKENS}, {_CAPS},
j AS (SELECT k.turn_id, k.id, c.start AS cs, c."end" AS ce, CASE
  WHEN k.start >= c.start AND k."end" <= c."end" THEN CASE WHEN k.start = c.start AND k."end" = c."end" THEN 'S' WHEN k.start = c.start THEN 'B' WHEN k."end" = c."end" THEN 'E' ELSE 'I' END
  WHEN k.start <= c.start AND k."end" >= c."end" THEN 'S' WHEN k.start BETWEEN c.start AND c."end" THEN 'E' WHEN k."end" BETWEEN c.start AND c."end" THEN 'B' END AS tag
  FROM k JOIN cs c ON c.turn_id = k.turn_id AND k."end" >= c.start AND k.start <= c."end"),
fj AS (SELECT turn_id, id, tag, row_number() OVER (PARTITION BY turn_id, id ORDER BY cs, ce) AS rn FROM j WHERE tag IS NOT NULL),
lb AS (SELECT k.turn_id, k.id, coalesce(fj.tag, 'O') AS tag FROM k LEFT JOIN fj ON fj.turn_id = k.turn_id AND fj.id = k.id AND fj.rn = 1)"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    t = turn_tokens(spark, d)
    caps = t.where(F.col("value").rlike("^[A-Z]") & (F.char_length("value") > 3)).select("turn_id", "start", "end")
    half = t.where((F.char_length("value") > 6) & (F.col("id") % 5 == 0)).select("turn_id", (F.col("start") + 2).alias("start"), (F.col("end") + 3).alias("end"))
    return spans.label_tokens(t, caps.unionByName(half), "turn_id")


@query("lab_1", f"WITH {_TAGS} SELECT turn_id, string_agg(tag, '' ORDER BY id) AS tags FROM lb GROUP BY turn_id")
def lab_1(spark: SparkSession, d: str) -> DataFrame:
    return _tags(labelled(spark, d))


def _tags(df: DataFrame) -> DataFrame:
    own = df.groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("id", "tag"))).alias("t"))
    return own.select("turn_id", F.array_join(F.transform("t", lambda t: t["tag"]), "").alias("tags"))


@query("join_3", f"WITH {_TAGS} SELECT tag, count(*) AS n FROM lb GROUP BY tag")
def join_3(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).groupBy("tag").agg(F.count("*").alias("n"))


_REVISED = f"{_TAGS}, lg AS (SELECT *, lag(tag) OVER (PARTITION BY turn_id ORDER BY id) AS before FROM lb), rv AS (SELECT turn_id, id, CASE WHEN tag = 'E' AND before NOT IN ('B', 'I') THEN 'O' ELSE tag END AS tag FROM lg)"


@query("lab_2", f"WITH {_REVISED} SELECT turn_id, string_agg(tag, '' ORDER BY id) AS tags FROM rv GROUP BY turn_id")
def lab_2(spark: SparkSession, d: str) -> DataFrame:
    return _tags(spans.revise_tags(labelled(spark, d), "turn_id"))


@query("lab_3", f"WITH {_REVISED} SELECT turn_id, list_concat(list_concat([1], list(strpos('SOIEB', tag) - 1 ORDER BY id)), [1]) AS labels FROM rv GROUP BY turn_id")
def lab_3(spark: SparkSession, d: str) -> DataFrame:
    t = spans.revise_tags(labelled(spark, d), "turn_id").withColumn("label", (F.instr(F.lit("SOIEB"), F.col("tag")) - 1).cast("long"))
    own = t.groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("id", "label"))).alias("t"))
    o = F.array(F.lit(1).cast("long"))
    return own.select("turn_id", F.concat(o, F.transform("t", lambda x: x["label"]), o).alias("labels"))


@query("agg_4", f"WITH {_REVISED}, l AS (SELECT DISTINCT tag FROM rv) SELECT tag, row_number() OVER (ORDER BY tag DESC) - 1 AS idx FROM l")
def agg_4(spark: SparkSession, d: str) -> DataFrame:
    tags = spans.revise_tags(labelled(spark, d), "turn_id").select("tag").distinct()  # five tags at most
    return tags.select("tag", (F.row_number().over(Window.orderBy(F.col("tag").desc())) - 1).cast("long").alias("idx"))


# Scores that follow from token texts: s, o, i, e, b
_SCORES = """sc AS (SELECT turn_id, id, start, "end", (length(value) * 37 + id * 11) % 100 / 100.0 AS s, (id * 53 + length(value) * 7) % 100 / 100.0 AS b, (id * 31 + length(value) * 17) % 100 / 100.0 AS e, (id * 71 + 40) % 100 / 100.0 AS i FROM k)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    n = F.char_length("value")
    part = lambda x: (x % 100) / 100.0
    t = turn_tokens(spark, d)
    return t.select("turn_id", "id", F.col("start").cast("int"), F.col("end").cast("int"), part(n * 37 + F.col("id") * 11).alias("s"), part(F.col("id") * 31 + n * 17).alias("e"), part(F.col("id") * 71 + 40).alias("i"), part(F.col("id") * 53 + n * 7).alias("b"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return spans.decode(scored(spark, d), "turn_id")


@query("spn_1", f"""WITH {TOKENS}, {_SCORES},
bad AS (SELECT *, sum(CASE WHEN i > 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY turn_id ORDER BY id) AS nb FROM sc),
r AS (SELECT a.turn_id, a.start, z."end", least(a.b, z.e, coalesce((SELECT min(m.i) FROM sc m WHERE m.turn_id = a.turn_id AND m.id > a.id AND m.id < z.id), 1)) AS score
  FROM bad a JOIN bad z ON a.turn_id = z.turn_id AND z.id > a.id AND a.b > 0.5 AND z.e > 0.5 AND (z.nb - CASE WHEN z.i > 0.5 THEN 0 ELSE 1 END) = a.nb),
u AS (SELECT turn_id, start, "end", s AS score FROM sc WHERE s > 0.5 UNION ALL SELECT * FROM r)
SELECT turn_id, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, CAST(sum("end") AS BIGINT) AS ends, CAST(round(sum(score) * 100) AS BIGINT) AS scores FROM u GROUP BY turn_id""")
def spn_1(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).groupBy("turn_id").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.round(F.sum("score") * 100).cast("long").alias("scores"))


def _with_dominance(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.operators.refine import dominant

    @F.pandas_udf("array<struct<start:int,end:int,score:double,dom:boolean>>")
    def mark(s: pd.Series) -> pd.Series:
        def one(v):
            v = [(x["start"], x["end"], x["score"]) for x in v]
            return [{"start": a, "end": b, "score": c, "dom": m} for (a, b, c), m in zip(v, dominant(v), strict=True)]

        return s.map(one)

    own = candidates(spark, d).groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "score"))).alias("c"))
    return own.select("turn_id", F.inline(mark("c")))


@query("spn_2")
def spn_2(spark: SparkSession, d: str) -> DataFrame:
    return _with_dominance(spark, d)


@query("spn_3")
def spn_3(spark: SparkSession, d: str) -> DataFrame:
    return _with_dominance(spark, d).where("dom").drop("dom")
