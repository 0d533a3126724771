"""Operators on hand-made rows, invariants, and the queries' registry."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from spanloom.functions import stats
from spanloom.functions import text as tx
from spanloom.functions import tokens as tk
from spanloom.operators import brackets, filters, refine, rule_tokens, sentences, spans
from spanloom.sources import files
from spanloom.streaming.annotate import annotate_stream, windowed_counts

BALANCED = {"foo": True, "(foo": False, "(foo)": True, "foo()bar": True, "(foo)bar": True, "foo)(bar": False}
NO_OPEN = {"example)": True, "example": False, "(example)": False, "(example": False}
NO_CLOSE = {"(example": True, "example": False, "(example)": False, "example)": False}


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize(("table", "column", "plain"), [(BALANCED, tx.brackets_balanced, brackets.balanced), (NO_OPEN, tx.lacks_open, brackets.lacks_open), (NO_CLOSE, tx.lacks_close, brackets.lacks_close)])
def test_bracket_tables(spark, table, column, plain):
    df = spark.createDataFrame([(t,) for t in table], "t string")
    assert {r.t: r.x for r in df.select("t", column(F.col("t")).alias("x")).collect()} == table
    assert {t: plain(t) for t in table} == table


@pytest.mark.parametrize(("given_", "want"), [("(abc)", "abc"), ("(abc", "abc"), ("abc)", "abc"), ("(a)b(c)", "(a)b(c)"), ("plain", "plain"), ("[x)", "x"), ("((a)", "(a)")])
def test_bracket_repair(given_, want):
    assert brackets.repair(given_) == want


def test_text_columns(spark):
    r = one(
        spark,
        cleaned=tx.clean_text(F.lit("a\nb [] c () d  e")),
        separated=tx.separate(F.lit("a/b:c x/y 1/2")),
        key=tx.section_key(F.lit("M"), F.lit(3), F.lit(1234)),
        bits=tx.one_hot(F.lit(1), 3),
        shape=tx.shape(F.lit("ABc12dEf")),
        before=tx.previous_word(F.lit("one two, three"), F.lit(9)),
        none_before=tx.previous_word(F.lit("one two"), F.lit(2)),
        behind=tx.next_word(F.lit("one two, three"), F.lit(3)),
        none_behind=tx.next_word(F.lit("one"), F.lit(1)),
        grams=tk.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2),
        cut=tk.split_at(F.lit("abcdef"), F.lit(2), F.lit(3)),
        fit=tk.whole_within(F.array(F.lit(2), F.lit(2), F.lit(3), F.lit(1)), 5),
        runs=tk.word_runs(F.lit("A cat of the hat."), ["of", "the"]),
        at=spans.locate_term(F.lit("aba aba, xaba aba"), F.lit("aba")),
    )
    assert r.cleaned == "a b c d e" and r.separated == "a b c x y 1/2" and r.key == "M031234" and r.bits == [0, 1, 0]
    assert r.shape == "320242"
    assert (r.before, r.none_before, r.behind, r.none_behind) == ("two", None, "two", None)
    assert r.grams == ["a", "b", "c", "a b", "b c"] and r.cut == ["ab", "c", "def"] and r.fit == 2
    assert r.runs == [["A", "cat"], ["hat"]] and r.at == [0, 4, 14]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("(II)", ["(II)"]),
        ("iron(II)", ["iron", "(II)"]),
        ("(glucose)", ["(", "glucose", ")"]),
        ("acid-based", ["acid", "-", "based"]),
        ("glucose/lactate", ["glucose", "/", "lactate"]),
        ("1-methyl", ["1-methyl"]),
        ("Jones' reagent", ["Jones'", "reagent"]),
        ("1,2-dichloro", ["1", ",", "2-dichloro"]),
        ("$keep-based", ["$keep-based"]),
        ("--", ["--"]),
        ("", []),
    ],
)
def test_rule_tokens(text, want):
    assert [v for v, *_ in rule_tokens.tokenize(text)] == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1 ()[]-,:+=<>/.;–'", max_size=25))
def test_rule_tokens_cover_the_text(text):
    got = rule_tokens.tokenize(text)
    assert all(text[a:b] == v and v for v, a, b, _ in got)
    assert "".join(v for v, *_ in got) == re.sub(r"\s", "", text)
    assert [i for *_, i in got] == list(range(len(got)))


def test_pieces_and_alignment():
    vocab = frozenset(["glu", "##cose", "a"])
    assert rule_tokens.wordpiece(["glucose", "a", "zz"], vocab) == [["glu", "##cose"], ["a"], ["[UNK]"]]
    assert rule_tokens.align_from_right("a glucose a", ["glu", "##cose", "a"]) == [(2, 5), (5, 9), (10, 11)]
    assert rule_tokens.align_from_right("abc", ["x", "c"]) == [None, (2, 3)]
    assert rule_tokens.force_splits("abc de", [1, 4]) == [(0, 1), (1, 3), (4, 6)]


def test_refinement_steps():
    text = "The amino acid and (foo bar) gave x:y today"
    assert refine.merge_overlapping(text, {(0, 3), (3, 5), (8, 9)}) == {(0, 5), (8, 9)}
    assert refine.merge_close(text, {(0, 3), (4, 9), (11, 12)}) == {(0, 9), (11, 12)}
    assert refine.extend_to_neighbours("pure lactic acid here", {(5, 11)}) == {(5, 16)}
    assert refine.close_brackets("see a(b c) now", {(4, 8)}) == {(4, 10)}
    assert refine.exclude("nation of salt", {(0, 6), (10, 14)}) == {(10, 14)}
    assert refine.dominant([(0, 5, 0.6), (3, 8, 0.9), (9, 10, 0.1)]) == [False, True, True]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab c(d):,-1", min_size=1, max_size=30), st.sets(st.tuples(st.integers(0, 29), st.integers(1, 30)), max_size=5))
def test_refinement_stays_in_bounds(text, raw):
    spans_ = {(s, min(e, len(text))) for s, e in raw if s < min(e, len(text))}
    got = refine.refine(text, spans_)
    assert all(0 <= s < e <= len(text) and e - s > 1 for s, e in got) and got == sorted(set(got))
    assert got == refine.refine(text, set(sorted(spans_, reverse=True)))


def test_spans_in_frames(spark):
    df = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 6, 8), (2, 0, 1)], "k int, start int, end int")
    merged = spans.merge_overlapping(df, "k")
    assert sorted(map(tuple, merged.select("k", "start", "end").collect())) == [(1, 0, 5), (1, 6, 8), (2, 0, 1)]
    assert sorted(map(tuple, spans.merge_close(merged, "k").select("k", "start", "end").collect())) == [(1, 0, 8), (2, 0, 1)]
    tokens = spark.createDataFrame([(1, 0, 0, 3), (1, 1, 4, 8), (1, 2, 9, 12), (1, 3, 20, 22)], "k int, id int, start int, end int")
    tags = spans.revise_tags(spans.label_tokens(tokens, spark.createDataFrame([(1, 0, 12)], "k int, start int, end int"), "k"), "k")
    assert [r.tag for r in tags.orderBy("id").collect()] == ["B", "I", "E", "O"]
    scored = spark.createDataFrame([(1, 0, 0, 2, 0.1, 0.0, 0.0, 0.0, 0.9), (1, 1, 3, 5, 0.6, 0.0, 0.7, 0.0, 0.0), (1, 2, 6, 8, 0.0, 0.0, 0.2, 0.8, 0.0)], "k int, id int, start int, end int, s double, o double, i double, e double, b double")
    assert sorted(map(tuple, spans.decode(scored, "k").collect())) == [(1, 0, 8, 0.7), (1, 3, 5, 0.6)]


def test_sentences_and_information(spark):
    t = spark.createDataFrame([(1, i, v) for i, v in enumerate(["See", "it", ".", "Then", "Fig", ".", "Two", "end", "."])], "k int, id int, value string")
    got = sentences.number_sentences(t, "k").orderBy("id").collect()
    assert [r.sentence for r in got] == [0, 0, 0, 1, 1, 1, 1, 1, 1]
    r = one(spark, mi=stats.signed_information(F.lit(0.0), F.lit(5.0), F.lit(5.0), F.lit(10.0)), none=stats.signed_information(F.lit(25.0), F.lit(50.0), F.lit(50.0), F.lit(100.0)))
    assert abs(r.mi + 0.6931471805599453) < 1e-12 and abs(r.none) < 1e-12


def test_filters(spark):
    df = spark.createDataFrame([("acid",), ("mineral acid",), ("lactic acid",), ("ab",), ("basics",)], "t string")
    assert {r.t for r in df.where(filters.passes_rules(F.col("t"), F.lit(False))).collect()} == {"lactic acid"}
    r = one(spark, keep=filters.sentence_rule(F.lit("lactic acid. end"), F.lit("lactic"), F.lit(6)), drop=filters.sentence_rule(F.lit("lactic. acid"), F.lit("lactic"), F.lit(6)), end=filters.trimmed_end(F.lit("abc ,"), F.lit(5)))
    assert (r.keep, r.drop, r.end) == (True, False, 3)


def test_files_round_trip(spark, tmp_path):
    rows = [("c1", "M00000", 'NA "quoted" é'), ("c1", "M00001", ""), ("c2", "R00000", " a\\b ")]
    df = spark.createDataFrame(rows, files.CORPUS)
    files.write_tsv(df, str(tmp_path / "t"), "corpus", "section")
    assert sorted(map(tuple, files.read_tsv(spark, str(tmp_path / "t"), files.CORPUS).collect())) == sorted(rows)
    (tmp_path / "bom.tsv").write_bytes("﻿c1\tM1\ttext\n".encode())
    assert [tuple(r) for r in files.read_tsv(spark, str(tmp_path / "bom.tsv"), files.CORPUS).collect()] == [("c1", "M1", "text")]
    (tmp_path / "art").mkdir()
    (tmp_path / "art" / "PMC1_x.json").write_text('{"paragraphs": [\n{"IAO_term": ["methods section"], "body": "b"}]}')
    assert [tuple(r) for r in files.read_articles(spark, str(tmp_path / "art")).collect()] == [("PMC1", 0, ["methods section"], "b")]
    (tmp_path / "ab.json").write_text('{"abbr": {"ATP": "adenosine triphosphate"}}')
    assert [tuple(r) for r in files.read_abbreviations(spark, str(tmp_path / "ab.json")).collect()] == [("abbr", "ATP", "adenosine triphosphate")]
    (tmp_path / "rx.txt").write_text("a.*\t\tb$\t")
    assert {r.pattern for r in files.read_patterns(spark, str(tmp_path / "rx.txt")).collect()} == {"a.*", "b$"}


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "2020-01-01 00:10:00"), (1, "2020-01-01 00:20:00"), (2, "2020-01-01 05:00:00")], "k int, at string").withColumn("ts", F.col("at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    annotate_stream(source, lambda b: b.select("k"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 1, 2]
    counts = windowed_counts(source, "ts", "k")
    counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.k, r.n) for r in spark.table("counts").collect()) == [(1, 2), (2, 1)]


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "sent_id", "start", "end", "gram"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_typed_stack_keeps_closers():
    assert brackets.unmatched("(a]b)") == [0, 2, 4]
    assert brackets.unmatched("a(b)[c") == [4] and brackets.unmatched(")(") == [0, 1]


@pytest.mark.parametrize(
    ("text", "span", "want"),
    [
        (")abc def", (0, 4), {(0, 4)}),  # a closing bracket in front stays
        ("see (abc) now", (5, 8), {(5, 8)}),  # widened to the chunk, then unwrapped
        ("see abc, now", (4, 6), {(4, 7)}),
        ("one two three", (3, 4), {(0, 7)}),  # from a blank, the words on both its sides
        ("a citrate:borate b", (2, 9), {(2, 9), (10, 16)}),
        ("(abc def", (0, 4), {(1, 4)}),
        ("abc) def", (0, 4), {(0, 3)}),
        ("(a]b) x", (0, 5), {(0, 5)}),
    ],
)
def test_words_are_completed(text, span, want):
    assert refine.complete_words(text, {span}) == want


def test_refinement_ends_where_spans_come_again(monkeypatch):
    turn = {(0, 3): (4, 7), (4, 7): (8, 11), (8, 11): (0, 3)}
    monkeypatch.setattr(refine, "STEPS", [lambda text, spans: {turn[s] for s in spans}])
    assert refine.refine("abc def ghi", {(0, 3)}) == [(0, 3)]


def test_hyphen_rule():
    at = {"drug-related": 4, "a-b": -1, "oxy-dimethyl": 3, "poly—mer": 4, "x-bound": 1, "T-unbound": 1, "one-two-three": 7, "(a-b)": -1, "A-1": -1, "ab-": -1, "-ab": -1}
    assert {w: rule_tokens.hyphen_index(w) for w in at} == at


def test_comma_and_forced_cuts_as_columns(spark):
    words = ["a,b", "a,-b", "1,2-x", "(a,b", "ab,", ",ab", "a,b,c", "ab"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.i for r in df.select(tk.comma_index(F.col("w")).alias("i")).collect()] == [rule_tokens.comma_index(w) for w in words]
    df = spark.createDataFrame([(1, "  abc defgh  i", [0, 3, 4, 8, 99])], "k int, t string, o array<int>")
    got = [(r.cuts, r.parts) for r in tk.forced_tokens(df, "t", "o", "k").orderBy("id").collect()]
    cuts = rule_tokens.force_splits("  abc defgh  i", [0, 3, 4, 8, 99])
    assert [c for cs, _ in got for c in cs] == [a for a, _ in cuts] and [p for _, ps in got for p in ps] == ["  abc defgh  i"[a:b] for a, b in cuts]


def test_spans_are_cut_before_mixtures(spark):
    texts = ["water (1:1 v v)", "water v v)", "acid(v v)", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.e for r in df.select(filters.cut_end(F.col("t"), F.lit(10)).alias("e")).collect()] == [15, None, 14, 15]
    spans_ = spark.createDataFrame([("pure citrate, here", 5, 13, True), ("an abc there", 3, 6, False), ("gas here.", 0, 3, True)], "s string, start int, end int, known boolean")
    assert [(r.start, r.end) for r in filters.cure(spans_, "s", "known").collect()] == [(5, 12)]


def test_articles_are_files_or_lines(spark, tmp_path):
    (tmp_path / "PMC1_x.json").write_text('{"paragraphs": [{"IAO_term": ["a"],\n "body": "b"}]}')
    assert [tuple(r) for r in files.read_articles(spark, str(tmp_path)).collect()] == [("PMC1", 0, ["a"], "b")]
