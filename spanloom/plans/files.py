"""Queries that write sources and sinks and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.functions import tokens as tk
from spanloom.operators import spans
from spanloom.plans.annotate import annotations
from spanloom.plans.catalog import ORACLES, SENT, SPANS, WORDS, query, sentences, table
from spanloom.plans.storage import scratch_path
from spanloom.plans.tokenize import _REVISED, TOKENS, labelled, turn_tokens
from spanloom.sources import files
from spanloom.streaming.annotate import annotate_stream


@query("src_1", "SELECT CAST(page_id AS VARCHAR) AS corpus, 0 AS pos, ['body', url] AS terms, html AS body FROM pages UNION ALL SELECT CAST(page_id AS VARCHAR), 1, ['url'], url FROM pages")
def src_1(spark: SparkSession, d: str) -> DataFrame:
    """Articles: one file each, written by partition, read with the articles' schema; a partition's name says which."""
    para = lambda terms, body: F.struct(terms.alias("IAO_term"), body.alias("body"))
    pages = table(spark, d, "pages").select("page_id", F.array(para(F.array(F.lit("body"), "url"), F.col("html")), para(F.array(F.lit("url")), F.col("url"))).alias("paragraphs"))
    path = scratch_path(spark, "articles")
    pages.withColumn("shelf", F.pmod(F.col("page_id"), F.lit(16))).withColumn("corpus", F.col("page_id").cast("string")).drop("page_id").write.partitionBy("shelf").json(path)
    return files.read_articles(spark, path, "corpus")


_CORPUS = f"WITH {SENT} SELECT CAST(doc_id AS VARCHAR) AS corpus, printf('M%02d%03d', doc_id % 7, sent_id) AS section, s AS text FROM s"


def corpus_rows(spark: SparkSession, d: str) -> DataFrame:
    return sentences(spark, d).select(F.col("doc_id").cast("string").alias("corpus"), F.format_string("M%02d%03d", F.col("doc_id") % 7, "sent_id").alias("section"), F.col("s").alias("text"))


@query("src_2", _CORPUS)
def src_2(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "corpus")
    files.write_tsv(corpus_rows(spark, d), path)
    return files.read_tsv(spark, path, files.CORPUS)


@query("snk_1", _CORPUS)
def snk_1(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "corpus-sorted")
    files.write_tsv(corpus_rows(spark, d), path, "corpus", "section")
    return files.read_tsv(spark, path, files.CORPUS)


@query("src_3", f'WITH {SPANS} SELECT CAST(doc_id AS VARCHAR) AS corpus, CAST(sent_id AS VARCHAR) AS section, start, "end", gram AS name FROM sp')
def src_3(spark: SparkSession, d: str) -> DataFrame:
    rows = annotations(spark, d).select(F.col("doc_id").cast("string").alias("corpus"), F.col("sent_id").cast("string").alias("section"), "start", "end", F.col("gram").alias("name"))
    path = scratch_path(spark, "annotations")
    files.write_tsv(rows, path, "corpus", "section", "start")
    return files.read_tsv(spark, path, files.ANNOTATIONS)


@query("src_4", "SELECT p_name AS name, lower(p_name) AS lower_name FROM part")
def src_4(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "names")
    table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name")).write.csv(path, sep="\t", header=True)
    return files.read_names(spark, path)


@query("src_5", r"SELECT DISTINCT trim(w) AS word, lower(trim(w)) AS lower_word FROM (SELECT unnest(string_split(text, chr(10))) AS w FROM documents) WHERE trim(w) <> ''")
def src_5(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    table(spark, d, "documents").select("text").write.text(path)
    return files.read_lines(spark, path)


@query("src_6", r"WITH n AS (SELECT DISTINCT p_name AS w FROM part), p AS (SELECT w, regexp_extract_all(w, '([A-Z]*[a-z]+|[A-Z]+|[0-9]+|\S)') AS p FROM n) SELECT 'piece' AS kind, x AS word FROM (SELECT DISTINCT unnest(p) AS x FROM p) UNION SELECT 'lower_piece', lower(x) FROM (SELECT unnest(p) AS x FROM p) UNION SELECT 'single', lower(w) FROM p WHERE len(p) = 1")
def src_6(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.col("p_name").alias("w")).distinct()
    return files.lexicon_pieces(names, "w", tk.fine_tokens(F.col("w")))


@query("src_7", "SELECT DISTINCT '^' || n_name AS pattern FROM nation")
def src_7(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "patterns")
    names = table(spark, d, "nation").agg(F.array_join(F.transform(F.collect_set("n_name"), lambda n: F.concat(F.lit("^"), n)), "\t").alias("value"))  # 25 names
    names.select(F.concat("value", F.lit("\t")).alias("value")).write.text(path)
    return files.read_patterns(spark, path)


@query("src_8", "SELECT '^' || r_name || '$' AS pattern FROM region UNION ALL SELECT '^' || n_name || '$' FROM nation")
def src_8(spark: SparkSession, d: str) -> DataFrame:
    return files.exact_patterns(table(spark, d, "region"), "r_name").unionByName(files.exact_patterns(table(spark, d, "nation"), "n_name"))


@query("src_9", "SELECT DISTINCT n_name AS word FROM nation")
def src_9(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "stop")
    table(spark, d, "nation").select("n_name").write.text(path)
    assert files.read_stop_words(spark, None) == []
    return spark.createDataFrame([(w,) for w in files.read_stop_words(spark, path)], "word string")


@query("src_10", "SELECT 'v' || vec_id AS word, CAST(len(embedding) AS INT) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[64] AS DOUBLE), 6) AS last FROM embeddings")
def src_10(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "vectors")
    numbers = F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")
    table(spark, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(" "), numbers).alias("value")).write.text(path)
    v = files.read_embeddings(spark, path)
    at = lambda i: F.round(F.get("vec", F.lit(i)).cast("double"), 6)
    return v.select("word", F.size("vec").alias("n"), at(0).alias("first"), at(63).alias("last"))


@query("src_11", "SELECT event_id, 'event' AS kind, event_type AS short, props AS long FROM events")
def src_11(spark: SparkSession, d: str) -> DataFrame:
    packed = table(spark, d, "events").select("event_id", F.to_json(F.create_map(F.lit("event"), F.create_map("event_type", "props"))).alias("json"))
    return files.abbreviations(packed, "json", "event_id")


def _saved(name: str, sql: str, make) -> None:
    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return files.save_table(make(spark, d), scratch_path(spark, name))


_SEQ = r"SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS tokens FROM conversations"


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", tk.words(F.col("text")).alias("tokens"))


_saved("snk_4", _SEQ, _sequences)


@query("snk_2", f"WITH {_REVISED} SELECT rv.turn_id, count(*) AS n, string_agg(k.value, ' ' ORDER BY rv.id) AS tokens, string_agg(rv.tag, '' ORDER BY rv.id) AS bio FROM rv JOIN k ON k.turn_id = rv.turn_id AND k.id = rv.id GROUP BY rv.turn_id")
def snk_2(spark: SparkSession, d: str) -> DataFrame:
    """Labelled sequences as a tab-separated table: a row for each, its lists as JSON; read back and opened."""
    t = spans.revise_tags(labelled(spark, d), "turn_id")
    own = t.groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("id", "value", "start", "end", "tag"))).alias("t"))
    lists = [F.to_json(F.col("t")[f]).alias(f) for f in ("value", "start", "end", "tag")]
    path = scratch_path(spark, "labelled")
    files.write_tsv(own.select("turn_id", *lists), path, "turn_id")
    back = files.read_tsv(spark, path, "turn_id long, value string, start string, end string, tag string")
    texts = lambda c: F.from_json(c, "array<string>")
    return back.select("turn_id", F.size(texts("value")).cast("long").alias("n"), F.array_join(texts("value"), " ").alias("tokens"), F.array_join(texts("tag"), "").alias("bio"))


@query("src_13", f"WITH {TOKENS} SELECT turn_id, count(*) AS n, 8 AS width, CAST(sum(length(value)) AS DOUBLE) AS chars FROM k GROUP BY turn_id")
def src_13(spark: SparkSession, d: str) -> DataFrame:
    """Prepared sequences with the numbers of each token, saved; loaded, and the width of a token's numbers recovered."""
    numbers = F.array(*[c.cast("double") for c in tx.numerics(F.col("value")).values()])
    own = turn_tokens(spark, d).groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("id", numbers.alias("ni")))).alias("t"))
    loaded = files.save_table(own.select("turn_id", F.transform("t", lambda x: x["ni"]).alias("ni")), scratch_path(spark, "prepared"))
    chars = F.aggregate("ni", F.lit(0.0), lambda a, x: a + F.get(x, F.lit(0)))
    return loaded.select("turn_id", F.size("ni").cast("long").alias("n"), F.size(F.get("ni", F.lit(0))).alias("width"), chars.alias("chars"))


def model_parts(spark: SparkSession, d: str) -> DataFrame:
    """part, name, number, value: all that a feature model keeps beside its network, in one long table: the features selected
    for the forest and for the network with their ranks, cached scores, token numbers, and the forest's nodes."""
    from spanloom.plans import learn

    def ranked(df: DataFrame, part: str, value: str, size: int) -> DataFrame:
        rank = F.row_number().over(Window.orderBy(F.round(F.abs(value), 10).desc(), "feature"))
        return df.limit(size).select(F.lit(part).alias("part"), F.col("feature").alias("name"), (rank - 1).cast("long").alias("number"), F.col(value).cast("double").alias("value"))

    nodes = spark.createDataFrame([("rf", f"{n[0]}/{n[1]}", n[2], n[3]) for n in learn._NODES], "part string, name string, number long, value double")
    cache = learn.word_scores(spark, d).where("known").select(F.lit("cache").alias("part"), F.col("w").alias("name"), F.lit(0).cast("long").alias("number"), F.col("score").alias("value"))
    toks = learn.vocabulary(spark, d).select(F.lit("tokd").alias("part"), F.col("value").alias("name"), F.col("idx").alias("number"), F.lit(0.0).alias("value"))
    return ranked(learn.top_1(spark, d), "selfeat", "mi", 1000).unionByName(ranked(learn.top_2(spark, d), "nnfeats", "n", 100)).unionByName(nodes).unionByName(cache).unionByName(toks)


def _parts_sql() -> str:
    from spanloom.plans import learn

    nodes = ", ".join(f"('rf', '{n[0]}/{n[1]}', {n[2]}, {n[3]})" for n in learn._NODES)
    strip = lambda name: ORACLES[name]
    return f"""WITH RECURSIVE {WORDS}, {learn._WORD_SCORES}, t1 AS ({strip("top_1")}), t2 AS ({strip("top_2")}), vv AS ({strip("agg_2")})
SELECT 'selfeat' AS part, feature AS name, row_number() OVER (ORDER BY round(abs(mi), 10) DESC, feature) - 1 AS number, mi AS value FROM t1
UNION ALL SELECT 'nnfeats', feature, row_number() OVER (ORDER BY n DESC, feature) - 1, CAST(n AS DOUBLE) FROM t2
UNION ALL SELECT 'cache', w, 0, score FROM ws WHERE known UNION ALL SELECT 'tokd', value, idx, 0.0 FROM vv WHERE value NOT IN ('[PAD]', '[UNK]') UNION ALL SELECT * FROM (VALUES {nodes})"""


def _register_model() -> None:
    import spanloom.plans.learn  # noqa: F401  (its SQL is part of this one's)

    sql = _parts_sql()

    @query("snk_3", sql)
    def snk_3(spark: SparkSession, d: str) -> DataFrame:
        """The model's parts as JSON lines, read back."""
        path = scratch_path(spark, "model-parts")
        model_parts(spark, d).write.json(path)
        return spark.read.schema("part string, name string, number long, value double").json(path)

    @query("src_12", f"SELECT part, count(*) AS n, min(name) AS least, max(name) AS greatest, CAST(max(number) AS BIGINT) AS last FROM ({sql}) GROUP BY part")
    def src_12(spark: SparkSession, d: str) -> DataFrame:
        """A saved model, loaded: each part's entries."""
        return snk_3(spark, d).groupBy("part").agg(F.count("*").alias("n"), F.min("name").alias("least"), F.max("name").alias("greatest"), F.max("number").alias("last"))


_register_model()


@query("snk_5")
def snk_5(spark: SparkSession, d: str) -> DataFrame:
    """A fitted model, saved, loaded, and its scores."""
    from pyspark.ml.classification import RandomForestClassificationModel

    from spanloom.operators import forest
    from spanloom.plans.learn import training_rows

    path, rows = scratch_path(spark, "model"), training_rows(spark, d)
    forest.fit(rows, trees=5).write().save(path)
    return forest.score_with_model(RandomForestClassificationModel.load(path), rows)


@query("stream_annotate", "SELECT event_id, length(props) AS n FROM events")
def stream_annotate(spark: SparkSession, d: str) -> DataFrame:
    """A batch operator over a stream of the table's files."""
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    annotate_stream(source, lambda b: b.select("event_id", F.char_length("props").alias("n")), out, state).awaitTermination()
    return spark.read.parquet(out).select("event_id", "n")
