"""Tokens and n-grams as array columns, without Python workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import AGGRESSIVE, let


def characters(c: Column) -> Column:
    """One token for each code point, blanks too."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def fine_tokens(c: Column) -> Column:
    """Runs of letters (capitals go with the small letters behind them), runs of digits, single other characters."""
    return F.regexp_extract_all(c, F.lit(AGGRESSIVE), 0)


def with_fine_tokens(df: DataFrame, text: str, *key: str) -> DataFrame:
    """A row for each fine token of `text`, with the key columns, id, value, start and end. An end is the running length
    of the pieces that end with a token, within the row that `key` names."""
    pieces = F.regexp_extract_all(F.col(text), F.lit("\\s*" + AGGRESSIVE), 0)
    rows = df.select(*key, F.posexplode(pieces).alias("id", "piece"))
    ends = F.sum(F.char_length("piece")).over(Window.partitionBy(*key).orderBy("id"))
    value = F.regexp_replace("piece", "^\\s+", "")
    return rows.select(*key, "id", value.alias("value"), (ends - F.char_length(value)).alias("start"), ends.alias("end"))


def words(c: Column) -> Column:
    """Runs of characters that are no blanks."""
    return F.filter(F.split(c, "\\s+"), lambda w: w != "")


def split_at(c: Column, *cuts: Column) -> Column:
    """The parts of a token between the cuts, two or three."""
    bounds = [F.lit(0), *cuts, F.char_length(c)]
    return F.array(*[F.substr(c, a + 1, b - a) for a, b in zip(bounds, bounds[1:], strict=False)])


def accepted(parts: Column) -> Column:
    """The parts that have text, where these are two or more; else null, and the token stays whole."""
    some = F.filter(parts, lambda p: p != "")
    return F.when(F.size(some) > 1, some)


def comma_index(c: Column) -> Column:
    """The last comma with no hyphen right behind it and no hyphen or opening bracket before it; -1 if there is none."""
    pattern = "^([^-\\[(]+),[^-]"
    return F.when(c.rlike(pattern), F.char_length(F.regexp_extract(c, pattern, 1))).otherwise(-1)


def forced_tokens(df: DataFrame, text: str, offsets: str, *key: str) -> DataFrame:
    """A row for each blank-separated token: the key columns, id, cuts (where its parts begin) and parts, cut at the
    offsets (array, ascending) that lie within the token. Ends are running lengths, as in with_fine_tokens."""
    rows = df.select(*key, offsets, F.posexplode(F.regexp_extract_all(F.col(text), F.lit("\\s*\\S+"), 0)).alias("id", "piece"))
    end = F.sum(F.char_length("piece")).over(Window.partitionBy(*key).orderBy("id"))
    value = F.regexp_replace("piece", "^\\s+", "")
    placed = rows.select(*key, "id", offsets, value.alias("value"), end.alias("end")).withColumn("start", F.col("end") - F.char_length("value"))
    cuts = F.concat(F.array("start"), F.filter(offsets, lambda o: (o > F.col("start")) & (o < F.col("end"))), F.array("end"))
    placed = placed.withColumn("bounds", cuts)
    part = lambda i: F.substr("value", (F.get("bounds", i) - F.col("start") + 1).cast("int"), (F.get("bounds", i + 1) - F.get("bounds", i)).cast("int"))
    begins = F.slice("bounds", F.lit(1), F.size("bounds") - 1)
    return placed.select(*key, "id", begins.alias("cuts"), F.transform(F.sequence(F.lit(0), F.size("bounds") - 2), part).alias("parts"))


def ngrams(w: Column, n: int = 4) -> Column:
    """All runs of one to n words, joined by blanks, shorter ones first."""
    none = F.array().cast("array<string>")

    def of(v: Column) -> Column:
        return F.concat(*[F.when(F.size(v) >= k, F.transform(F.sequence(F.lit(1), F.size(v) - (k - 1)), _gram(v, k))).otherwise(none) for k in range(1, n + 1)])

    return let(w, of)


def _gram(w: Column, k: int):
    return lambda i: F.array_join(F.slice(w, i, F.lit(k)), " ")


def word_runs(sentence: Column, stop: list[str]) -> Column:
    """Words of a sentence without its last mark, split at blanks and at marks before blanks, in runs between stop words."""
    w = F.split(F.regexp_replace(sentence, "[,.!?;:]$", ""), "[,.!?;:]? ")
    marks = F.array(*[F.lit(s) for s in stop]) if stop else F.array().cast("array<string>")
    runs = F.aggregate(
        w,
        F.array(F.array().cast("array<string>")),
        lambda acc, x: F.when(F.array_contains(marks, F.lower(x)), F.concat(acc, F.array(F.array().cast("array<string>")))).otherwise(
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.array(x))))
        ),
    )
    return F.filter(runs, lambda r: F.size(F.filter(r, lambda x: x != "")) > 0)


def truncate(tokens: Column, limit: int = 256) -> Column:
    """At most `limit` tokens less two end marks."""
    return F.slice(tokens, F.lit(1), F.lit(limit - 2))


def whole_within(counts: Column, budget: int) -> Column:
    """How many leading tokens fit when token i takes counts[i] pieces and `budget` pieces are had."""
    return F.aggregate(counts, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")), lambda s, c: F.when((s["sum"] >= 0) & (s["sum"] + c <= budget), F.struct((s["sum"] + c).alias("sum"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(-1).alias("sum"), s["n"].alias("n"))), lambda s: s["n"])


def repeat_each(tokens: Column, counts: Column) -> Column:
    """Each token as often as it has pieces."""
    return F.flatten(F.zip_with(tokens, counts, lambda t, n: F.array_repeat(t, n)))
