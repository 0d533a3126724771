"""Column functions over strings. Offsets are 0-based, end-exclusive code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AGGRESSIVE = "([A-Z]*[a-z]+|[A-Z]+|[0-9]+|\\S)"
# Patterns of a word's shape, in order, and of its yes/no features.
SHAPES = [("[0-9]+", "0"), ("[a-z][a-z]+", "1"), ("[a-z]", "2"), ("[A-Z][A-Z]+", "3"), ("[A-Z]", "4")]
#: Yes/no features of a token, in the order of their names.
FLAGS = {
    "2lc": "[a-z][a-z]",
    "2uc": "[A-Z][A-Z]",
    "char": "[A-Za-z]",
    "d_and_c": "[A-Za-z].*[0-9]|[0-9].*[A-Za-z]",
    "hasdigit": "[0-9]",
    "isdigit": "^[0-9]",
    "num": "^-?[0-9]+(\\.[0-9]+)?$",
    "pc": "^-?[0-9]+(\\.[0-9]+)?%$",
    "singlelower": "^[a-z]$",
    "singleupper": "^[A-Z]$",
}


def let(value: Column, use) -> Column:
    """use(value) with the value computed once. A plain column within a lambda is computed anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_text(c: Column) -> Column:
    """Newlines become blanks; empty citation brackets go; double blanks are halved once."""
    for old, new in (("\n", " "), (" []", ""), (" ()", ""), ("  ", " ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def separate(c: Column) -> Column:
    """A slash or colon between two letters becomes a blank, so that offsets stay. Matches are found in the given text
    and each is replaced wherever its three characters stand."""
    found = F.concat(*[F.regexp_extract_all(c, F.lit(f"[A-Za-z]{p}[A-Za-z]"), 0) for p in "/:"])
    return F.aggregate(found, c, lambda s, m: F.replace(s, m, F.concat(F.substring(m, 1, 1), F.lit(" "), F.substring(m, 3, 1))))


def section_key(letter: Column, part: Column, sentence: Column) -> Column:
    return F.format_string("%s%02d%03d", letter, part, sentence)


def one_hot(bit: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == bit).cast("int"))


def shape(c: Column) -> Column:
    for pattern, code in SHAPES:
        c = F.regexp_replace(c, pattern, code)
    return c


def flags(c: Column) -> list[Column]:
    return [c.rlike(p).cast("int").alias(f"re_{n}") for n, p in FLAGS.items()]


def numerics(c: Column) -> dict[str, Column]:
    """Eight numbers about a token: lengths, and counts and shares of characters that are no lower-case letters, no
    letters, or digits."""
    n = F.char_length(c)
    other = F.char_length(F.regexp_replace(c, "[a-z]", ""))
    marks = F.char_length(F.regexp_replace(c, "[A-Za-z]", ""))
    return {"n": n, "log_n": F.round(F.ln(n), 6), "sqrt_n": F.round(F.sqrt(n), 6), "other": other, "other_share": F.round(other / n, 6), "marks": marks, "marks_share": F.round(marks / n, 6), "digits": F.char_length(F.regexp_replace(c, "[^0-9]", ""))}


def char_grams(c: Column) -> Column:
    """4g, 3g, 2g of the token between ^ and $, and 1g of its characters, with those prefixes."""
    marked = F.concat(F.lit("^"), c, F.lit("$"))

    def grams(text: Column, n: int) -> Column:
        size = F.char_length(text)
        each = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.concat(F.lit(f"{n}g="), F.substr(text, i, F.lit(n))))
        return F.when(size >= n, each).otherwise(F.array().cast("array<string>"))

    return F.concat(let(marked, lambda m: F.concat(*[grams(m, n) for n in (4, 3, 2)])), grams(c, 1))


def suffixes(c: Column) -> Column:
    return F.array(F.concat(F.lit("suf3="), F.right(c, F.lit(3))), F.concat(F.lit("suf2="), F.right(c, F.lit(2))))


def direct_features(c: Column) -> Column:
    """Shape and suffixes, of which the commonest go to the network as they are."""
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("ws="), shape(c))), suffixes(c)))


def features(c: Column) -> Column:
    """All named features of a token: shape, character n-grams, and the flags that hold."""
    held = F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(f"re={n}")) for n, p in FLAGS.items()]))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("ws="), shape(c))), char_grams(c), held))


def encode(features: Column, selected: list[str]) -> Column:
    """0/1 for each selected feature."""
    return let(features, lambda f: F.transform(F.array(*[F.lit(s) for s in selected]), lambda s: F.array_contains(f, s).cast("int")))


def _levels(c: Column, up: str, down: str) -> Column:
    """(level, least level) over the characters; any bracket closes any other."""
    zero = F.struct(F.lit(0).alias("level"), F.lit(0).alias("least"))

    def move(s: Column, x: Column) -> Column:
        level = s["level"] + F.when(F.instr(F.lit(up), x) > 0, 1).when(F.instr(F.lit(down), x) > 0, -1).otherwise(0)
        return F.struct(level.alias("level"), F.least(s["least"], level).alias("least"))

    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), zero, move)


def brackets_balanced(c: Column) -> Column:
    r = _levels(c, "([{", ")]}")
    return (r["level"] == 0) & (r["least"] == 0)


def lacks_open(c: Column) -> Column:
    """Some closing bracket has no opening one before it."""
    return _levels(c, "([{", ")]}")["least"] < 0


def lacks_close(c: Column) -> Column:
    """Some opening bracket has no closing one after it."""
    return _levels(F.reverse(c), ")]}", "([{")["least"] < 0


def bracketed(c: Column) -> Column:
    """At least three characters, an outer pair, and balance within."""
    inner = F.substr(c, F.lit(2), F.char_length(c) - 2)
    pair = F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1))).isin("()", "[]", "{}")
    return (F.char_length(c) >= 3) & pair & brackets_balanced(inner)


def previous_word(text: Column, start: Column) -> Column:
    """The word before `start`: between the last two blanks, without one trailing mark; null where there is none."""
    head = F.substr(text, F.lit(1), start)
    blank = F.char_length(head) - F.instr(F.reverse(head), " ")  # 0-based place of the last blank
    before = F.substr(text, F.lit(1), blank)
    word = F.element_at(F.split(before, " "), -1)
    return F.when((F.instr(head, " ") > 0) & (blank > 0), F.regexp_replace(word, "[,.!?;: ]$", ""))


def next_word(text: Column, end: Column) -> Column:
    """The word behind the first blank at or after `end`, without one trailing mark; null where there is none or it
    would begin at the last character."""
    tail = F.substr(text, end + 1)
    at = F.instr(tail, " ")
    word = F.element_at(F.split(F.substr(tail, at + 1), " "), 1)
    return F.when((at > 0) & (at + 1 < F.char_length(tail)), F.regexp_replace(word, "[,.!?;: ]$", ""))


def narrow(c: Column) -> Column:
    """The text with code points over 255 as question marks."""
    return F.regexp_replace(c, "[^\\x{00}-\\x{FF}]", "?")
