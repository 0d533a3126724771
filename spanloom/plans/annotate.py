"""Queries that make and filter annotations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.functions import tokens as tk
from spanloom.operators import filters, refine, spans
from spanloom.plans.catalog import MATCHES, SENT, SPANS, STOP, TERMS, WORDS, dictionary_matches, distinct_words, query, sentences, table, terms
from spanloom.plans.storage import scratch_path
from spanloom.sources import files
from spanloom.sources.files import save_table


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, sent_id, s, start, end, gram: places of dictionary terms in sentences."""
    s = sentences(spark, d)
    grams = dictionary_matches(s, terms(spark, d), "doc_id", "sent_id")
    found = s.join(grams, ["doc_id", "sent_id"])  # sentences don't travel with their words
    return found.select("*", F.explode(spans.locate_term(F.col("s"), F.col("gram"))).alias("start")).withColumn("end", F.col("start") + F.char_length("gram"))


@query("corpus_annotations", f'WITH {SPANS} SELECT doc_id, sent_id, start, "end", gram FROM sp')
def corpus_annotations(spark: SparkSession, d: str) -> DataFrame:
    return annotations(spark, d).select("doc_id", "sent_id", "start", "end", "gram")


@query("join_4", f"WITH {MATCHES} SELECT gram, count(*) AS n FROM m GROUP BY gram")
def join_4(spark: SparkSession, d: str) -> DataFrame:
    return dictionary_matches(sentences(spark, d), terms(spark, d), "doc_id", "sent_id").groupBy("gram").agg(F.count("*").alias("n"))


@query("join_6", f'WITH {SPANS} SELECT gram, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, CAST(sum("end") AS BIGINT) AS ends FROM sp GROUP BY gram')
def join_6(spark: SparkSession, d: str) -> DataFrame:
    return annotations(spark, d).groupBy("gram").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


_PATTERNS = ["^th.*tion$", "ung$", "^[0-9]+$", "ière", "ci[oó]n$"]


@query("join_5", rf"WITH {WORDS}, x(rx) AS (VALUES ('^th.*tion$'), ('ung$'), ('^[0-9]+$'), ('ière'), ('ci[oó]n$')) SELECT DISTINCT w FROM w, x WHERE regexp_matches(w, '(?i)' || rx)")
def join_5(spark: SparkSession, d: str) -> DataFrame:
    return distinct_words(spark, d).where(F.col("w").rlike(f"(?iu){filters.any_of(_PATTERNS)}"))


@query("set_1", rf"WITH {MATCHES}, u AS (SELECT doc_id, sent_id, gram FROM m UNION SELECT doc_id, sent_id, x FROM (SELECT doc_id, sent_id, unnest(string_split(s, ' ')) AS x FROM s) WHERE regexp_matches(x, '(?i)^th.*tion$|ung$')) SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id")
def set_1(spark: SparkSession, d: str) -> DataFrame:
    s = sentences(spark, d)
    by_rule = s.select("doc_id", "sent_id", F.explode(F.split("s", " ")).alias("gram")).where(F.col("gram").rlike("(?i)^th.*tion$|ung$"))
    both = dictionary_matches(s, terms(spark, d), "doc_id", "sent_id").unionByName(by_rule).distinct()
    return both.groupBy("doc_id").agg(F.count("*").alias("n"))


_ROUTES = {"M": "de", "R": "fr", "D": "es", "A": "src1"}


@query("flt_1", "SELECT doc_id, CASE WHEN list_contains([lang, source], 'de') THEN 'M' WHEN list_contains([lang, source], 'fr') THEN 'R' WHEN list_contains([lang, source], 'es') THEN 'D' WHEN list_contains([lang, source], 'src1') THEN 'A' END AS section FROM documents")
def flt_1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", route(F.array("lang", "source")).alias("section"))


def route(labels, routes: dict[str, str] = _ROUTES):
    """The first section whose phrase is among the labels."""
    out = None
    for section, phrase in routes.items():
        hit = F.array_contains(labels, phrase)
        out = F.when(hit, section) if out is None else out.when(hit, section)
    return out


@query("prj_1", "SELECT doc_id, lang || source AS part, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS idx FROM documents")
def prj_1(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    return table(spark, d, "documents").select("doc_id", F.concat("lang", "source").alias("part"), (F.row_number().over(Window.partitionBy("lang", "source").orderBy("doc_id")) - 1).cast("long").alias("idx"))


@query("prj_2", r"SELECT doc_id, md5(replace(replace(replace(replace(text, chr(10), ' '), ' []', ''), ' ()', ''), '  ', ' ')) AS cleaned FROM documents")
def prj_2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(tx.clean_text(F.col("text"))).alias("cleaned"))


_SEPARATE = "list_reduce(list_concat(regexp_extract_all({0}, '[A-Za-z]/[A-Za-z]'), regexp_extract_all({0}, '[A-Za-z]:[A-Za-z]')), lambda a, m: replace(a, m, substr(m, 1, 1) || ' ' || substr(m, 3, 1)), {0})"


@query("prj_3", f"SELECT page_id, md5({_SEPARATE.format('html')}) AS separated, {_SEPARATE.format('url')} AS url FROM pages")
def prj_3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(tx.separate(F.col("html"))).alias("separated"), tx.separate(F.col("url")).alias("url"))


@query("prj_4", "SELECT conv_id, turn, printf('%s%02d%03d', upper(role[1]), conv_id, turn) AS section FROM conversations")
def prj_4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", tx.section_key(F.upper(F.left("role", F.lit(1))), F.col("conv_id"), F.col("turn")).alias("section"))


@query("prj_5", "SELECT vec_id, list_transform(range(0, 12), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END) AS bits FROM embeddings")
def prj_5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", tx.one_hot(F.col("label"), 12).alias("bits"))


@query("flt_2", f"WITH {SENT} SELECT doc_id, count(*) AS n FROM s WHERE s <> ' ' AND s <> '' GROUP BY doc_id")
def flt_2(spark: SparkSession, d: str) -> DataFrame:
    return sentences(spark, d).where("s <> ' ' and s <> ''").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("flt_3", f'WITH {SPANS} SELECT DISTINCT doc_id, sent_id FROM sp WHERE "end" - start > 8')
def flt_3(spark: SparkSession, d: str) -> DataFrame:
    return annotations(spark, d).where(F.col("end") - F.col("start") > 8).select("doc_id", "sent_id").distinct()


_RX = filters.RULES.replace("'", "''")
_EXCLUDED = refine.EXCLUDED


@query("flt_4", rf"WITH {WORDS}, {TERMS}, f AS (SELECT DISTINCT unnest(string_split(term, ' ')) AS f FROM t), k AS (SELECT w, lower(w) IN (SELECT f FROM f) AS known FROM w) SELECT w FROM k WHERE (known OR (length(w) > 3 AND NOT regexp_matches(w, '(?i)(?:[0-9]{{3}}|tt)'))) AND NOT regexp_matches(w, '(?i)(?:{_RX})')")
def flt_4(spark: SparkSession, d: str) -> DataFrame:
    known = terms(spark, d).select(F.explode(F.split("term", " ")).alias("f")).distinct()
    w = distinct_words(spark, d).join(known, F.lower("w") == F.col("f"), "left")
    return w.where(filters.passes_rules(F.col("w"), F.col("f").isNotNull(), "[0-9]{3}|tt")).select("w")


@query("flt_4_end", f"WITH {WORDS} SELECT w, CAST(length(regexp_replace(regexp_replace(w, '[,.?:;!]$', ''), '[,.?:;! ]$', '')) AS INT) AS \"end\" FROM w")
def flt_4_end(spark: SparkSession, d: str) -> DataFrame:
    return distinct_words(spark, d).select("w", filters.trimmed_end(F.col("w"), F.char_length("w")).alias("end"))


@query("flt_4_sentence", rf"WITH {SENT}, x AS (SELECT doc_id, sent_id, s, regexp_extract(s, '^\S+', 0) AS w FROM s), y AS (SELECT *, substr(s || '; acid', CAST(length(w) AS INT) + 1) AS tail FROM x WHERE w <> '') SELECT doc_id, sent_id, w FROM y WHERE NOT w LIKE '%ic' OR (regexp_matches(tail, '[.;!?]') AND (strpos(tail, 'acid') = 0 OR length(regexp_extract(tail, '^[^.;!?]*', 0)) + 1 >= strpos(tail, 'acid')))")
def flt_4_sentence(spark: SparkSession, d: str) -> DataFrame:
    w = sentences(spark, d).withColumn("w", F.regexp_extract("s", "^\\S+", 0)).where("w <> ''")
    return w.where(filters.sentence_rule(F.concat("s", F.lit("; acid")), F.col("w"), F.char_length("w"))).select("doc_id", "sent_id", "w")


@query("flt_4_cut", rf"""WITH {WORDS}, v AS (SELECT unnest([w, w || ' (1 v v)', w || '(v v)', w || ' v v)']) AS t FROM w), c AS (SELECT t, CASE WHEN NOT regexp_matches(t, 'v v\)$') THEN length(t) WHEN contains(t, '(') THEN length(regexp_replace(t, ' ?\([^(]*$', '')) END AS "end" FROM v) SELECT t, CAST("end" AS INT) AS "end" FROM c""")
def flt_4_cut(spark: SparkSession, d: str) -> DataFrame:
    forms = F.array(F.col("w"), *[F.concat("w", F.lit(x)) for x in (" (1 v v)", "(v v)", " v v)")])
    each = distinct_words(spark, d).select(F.explode(forms).alias("t"))
    return each.select("t", filters.cut_end(F.col("t"), F.lit(0)).alias("end"))


def corpus_spans(spark: SparkSession, d: str, sentence_splitter: Callable[[Column], Column] = lambda text: F.split(text, "[.\n]")) -> DataFrame:
    """corpus, section, text, start, end, name: the whole way from articles to annotations. Sections are routed, texts
    cleaned, cut by the given splitter, slashes between letters opened, terms found and located, spans refined to a fixed point and
    filtered."""
    section = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in {"de": "M", "fr": "R", "es": "D"}.items() for x in kv]), F.col("lang")), F.lit("A"))
    docs = table(spark, d, "documents").select("doc_id", section.alias("letter"), tx.clean_text(F.col("text")).alias("clean"))
    sents = docs.select("doc_id", "letter", F.posexplode(sentence_splitter(F.col("clean"))).alias("sent_id", "s")).where("s <> ' ' and s <> ''").withColumn("s", tx.separate(F.col("s")))
    grams = dictionary_matches(sents, terms(spark, d), "doc_id", "sent_id")
    found = sents.join(grams, ["doc_id", "sent_id"])
    found = found.select("*", F.explode(spans.locate_term(F.col("s"), F.col("gram"))).alias("start")).withColumn("end", F.col("start") + F.char_length("gram"))
    own = found.groupBy("doc_id", "letter", "sent_id", "s").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.collect_set("gram").alias("grams"))
    refined = own.select("doc_id", "letter", "sent_id", "s", "grams", F.explode(refine.step_udf(refine.refine)(F.col("s"), F.col("spans"))).alias("x"))
    known = refined.select("*", "x.start", "x.end", F.array_contains("grams", F.col("x.text")).alias("known"))
    cured = filters.cure(known, "s", "known")
    key = tx.section_key(F.col("letter"), F.lit(0), F.col("sent_id"))
    name = F.substr(F.col("s"), F.col("start") + 1, F.col("end") - F.col("start"))
    return cured.select(F.col("doc_id").cast("string").alias("corpus"), key.alias("section"), F.col("s").alias("text"), "start", "end", name.alias("name"))


@query("corpus_build")
def corpus_build(spark: SparkSession, d: str) -> DataFrame:
    """Both tables of a corpus, written tab-separated and read back: annotations with the sentences that they are in."""
    made = save_table(corpus_spans(spark, d), scratch_path(spark, "corpus-spans"))
    sentences_at, spans_at = scratch_path(spark, "corpus-sentences"), scratch_path(spark, "corpus-annotations")
    files.write_tsv(made.select("corpus", "section", "text").distinct(), sentences_at, "corpus", "section")
    files.write_tsv(made.select("corpus", "section", "start", "end", "name"), spans_at, "corpus", "section", "start")
    return files.read_tsv(spark, spans_at, files.ANNOTATIONS).join(files.read_tsv(spark, sentences_at, files.CORPUS), ["corpus", "section"])


@query("flt_5", rf"WITH {WORDS} SELECT w FROM w WHERE length(w) > 1 AND NOT regexp_matches(w, '(?i)(?:{_EXCLUDED})')")
def flt_5(spark: SparkSession, d: str) -> DataFrame:
    return distinct_words(spark, d).where(filters.not_excluded(F.col("w")))


@query("flt_6", f"WITH {SENT} SELECT doc_id, sent_id, CASE WHEN trim(s) = '' THEN [] ELSE [length(s)] END AS found FROM s")
def flt_6(spark: SparkSession, d: str) -> DataFrame:
    empty = F.array().cast("array<int>")
    return sentences(spark, d).select("doc_id", "sent_id", F.when(F.trim("s") == "", empty).otherwise(F.array(F.char_length("s"))).alias("found"))


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"


@query("seg_4", rf"""WITH {SENT},
x AS (SELECT doc_id, sent_id, string_split_regex(regexp_replace(s, '[,.!?;:]$', ''), '[,.!?;:]? ') AS w FROM s),
y AS (SELECT doc_id, sent_id, i, w[i] AS w, list_contains({_STOP_SQL}, lower(w[i])) AS stop FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM x)),
z AS (SELECT *, sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sent_id ORDER BY i) AS run FROM y),
r AS (SELECT doc_id, sent_id, run, string_agg(w, ' ' ORDER BY i) AS words FROM z WHERE NOT stop GROUP BY doc_id, sent_id, run)
SELECT doc_id, count(*) AS n_runs, md5(string_agg(words, '|' ORDER BY sent_id, run)) AS runs FROM r WHERE trim(words) <> '' GROUP BY doc_id""")
def seg_4(spark: SparkSession, d: str) -> DataFrame:
    runs = sentences(spark, d).select("doc_id", "sent_id", F.posexplode(tk.word_runs(F.col("s"), STOP)).alias("run", "words"))
    text = F.array_join("words", " ")
    each = runs.where(F.trim(text) != "").groupBy("doc_id").agg(F.count("*").alias("n_runs"), F.array_sort(F.collect_list(F.struct("sent_id", "run", text.alias("t")))).alias("r"))
    return each.select("doc_id", "n_runs", F.md5(F.array_join(F.transform("r", lambda x: x["t"]), "|")).alias("runs"))


@query("seg_5", rf"""WITH {SENT},
x AS (SELECT doc_id, list_filter(string_split(s, ' '), lambda v: v <> '') AS w FROM s),
g AS (SELECT doc_id, array_to_string(w[i:i + n - 1], ' ') AS gram, n FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM x), (VALUES (1), (2), (3), (4)) AS k(n) WHERE i + n - 1 <= len(w))
SELECT doc_id, count(*) AS n, CAST(sum(length(gram)) AS BIGINT) AS chars, min(gram) AS least, max(gram) AS greatest FROM g GROUP BY doc_id""")
def seg_5(spark: SparkSession, d: str) -> DataFrame:
    """The n-grams of all sentences in numbers, by arithmetic on the words: a word of m is in min(i, k, m - k + 1,
    m - i + 1) grams of k words. The least gram is a word, the greatest one of the longest from each word on."""
    w = F.filter(F.split("s", " "), lambda v: v != "")
    s = sentences(spark, d).select("doc_id", w.alias("w")).where(F.size("w") > 0).withColumn("m", F.size("w"))
    n = sum((F.greatest(F.col("m") - (k - 1), F.lit(0)) for k in range(2, 5)), F.col("m"))
    blanks = sum(((k - 1) * F.greatest(F.col("m") - (k - 1), F.lit(0)) for k in range(2, 5)), F.lit(0))

    def inside(v, i):
        grams = [F.greatest(F.least(i + 1, F.lit(k), F.col("m") - (k - 1), F.col("m") - i), F.lit(0)) for k in range(1, 5)]
        return F.char_length(v) * sum(grams[1:], grams[0])

    chars = F.aggregate(F.transform("w", inside), F.lit(0), lambda a, x: a + x) + blanks
    longest = F.array_max(F.transform("w", lambda v, i: F.array_join(F.slice("w", i + 1, F.lit(4)), " ")))
    each = s.select("doc_id", n.alias("n"), chars.alias("chars"), F.array_min("w").alias("least"), longest.alias("greatest"))
    return each.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))


@query("seg_3", f"WITH {SENT} SELECT doc_id, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars FROM s WHERE trim(s) <> '' GROUP BY doc_id")
def seg_3(spark: SparkSession, d: str) -> DataFrame:
    return sentences(spark, d).where(F.trim("s") != "").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.char_length("s")).alias("chars"))


@query("join_1", f'WITH {SPANS}, a AS (SELECT doc_id, sent_id, string_agg(CAST(start AS VARCHAR) || \'-\' || CAST("end" AS VARCHAR), \',\' ORDER BY start, "end") AS found FROM (SELECT DISTINCT doc_id, sent_id, start, "end" FROM sp) GROUP BY doc_id, sent_id) SELECT s.doc_id, s.sent_id, coalesce(a.found, \'\') AS found FROM s LEFT JOIN a ON a.doc_id = s.doc_id AND a.sent_id = s.sent_id')
def join_1(spark: SparkSession, d: str) -> DataFrame:
    own = annotations(spark, d).groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("x"))
    s = sentences(spark, d).select("doc_id", "sent_id").join(own, ["doc_id", "sent_id"], "left")
    shown = F.array_join(F.transform("x", lambda v: F.concat_ws("-", v["start"].cast("string"), v["end"].cast("string"))), ",")
    return s.select("doc_id", "sent_id", F.coalesce(shown, F.lit("")).alias("found"))


@query("join_2", f'WITH {SPANS} SELECT doc_id, sent_id, start, "end", substr(s, start + 1, "end" - start) AS name FROM sp')
def join_2(spark: SparkSession, d: str) -> DataFrame:
    a = annotations(spark, d)
    return a.select("doc_id", "sent_id", "start", "end", F.substr("s", F.col("start") + 1, F.col("end") - F.col("start")).alias("name"))


@query("srt_1", f'WITH {SPANS} SELECT doc_id, sent_id, start, "end", gram FROM sp ORDER BY doc_id, sent_id, start, "end"')
def srt_1(spark: SparkSession, d: str) -> DataFrame:
    return annotations(spark, d).select("doc_id", "sent_id", "start", "end", "gram").orderBy("doc_id", "sent_id", "start", "end")


@query("srt_2", f'WITH {SPANS} SELECT doc_id, sent_id, string_agg(CAST(start AS VARCHAR), \',\' ORDER BY start, "end") AS starts FROM sp GROUP BY doc_id, sent_id')
def srt_2(spark: SparkSession, d: str) -> DataFrame:
    own = annotations(spark, d).groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("x"))
    return own.select("doc_id", "sent_id", F.array_join(F.transform("x", lambda v: v["start"].cast("string")), ",").alias("starts"))


_ISLANDS = """{spans},
x AS (SELECT doc_id, sent_id, start, "end" FROM sp),
r AS (SELECT *, max("end") OVER (PARTITION BY doc_id, sent_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
i AS (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, sent_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM r),
mg AS (SELECT doc_id, sent_id, min(start) AS start, max("end") AS "end" FROM i GROUP BY doc_id, sent_id, island)""".format(spans=SPANS)


@query("spn_4", f'WITH {_ISLANDS} SELECT doc_id, sent_id, start, "end" FROM mg')
def spn_4(spark: SparkSession, d: str) -> DataFrame:
    return spans.merge_overlapping(annotations(spark, d).select("doc_id", "sent_id", "start", "end"), "doc_id", "sent_id")


@query("spn_5", f"""WITH {_ISLANDS},
c AS (SELECT *, start - lag("end") OVER (PARTITION BY doc_id, sent_id ORDER BY start, "end") AS gap FROM mg),
j AS (SELECT *, sum(CASE WHEN gap = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, sent_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM c)
SELECT doc_id, sent_id, min(start) AS start, max("end") AS "end" FROM j GROUP BY doc_id, sent_id, island""")
def spn_5(spark: SparkSession, d: str) -> DataFrame:
    merged = spans.merge_overlapping(annotations(spark, d).select("doc_id", "sent_id", "start", "end"), "doc_id", "sent_id")
    return spans.merge_close(merged, "doc_id", "sent_id")


@query("spn_4_events", """WITH x AS (SELECT user_id, epoch(ts) AS start, epoch(ts) + 3600 AS "end" FROM events),
r AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
i AS (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM r)
SELECT user_id, CAST(min(start) AS DOUBLE) AS start, CAST(max("end") AS DOUBLE) AS "end" FROM i GROUP BY user_id, island""")
def spn_4_events(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return spans.merge_overlapping(table(spark, d, "events").select("user_id", at.alias("start"), (at + 3600).alias("end")), "user_id")


def gathered(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, sent_id, s and its spans."""
    a = annotations(spark, d)
    return a.groupBy("doc_id", "sent_id", "s").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))


def _stepped(step):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return gathered(spark, d).select("doc_id", "sent_id", F.explode(refine.step_udf(step)(F.col("s"), F.col("spans"))).alias("x")).select("doc_id", "sent_id", "x.*")

    return run


query("spn_6")(_stepped(refine.extend_to_neighbours))
query("spn_7")(_stepped(refine.close_brackets))
query("spn_8")(_stepped(refine.complete_words))
query("spn_9")(_stepped(refine.refine))
