"""A rule tokenizer for scientific prose: blanks first, then each token is split by the first rule that applies, until
none does. It runs in Arrow batches, since a rule looks at the whole token that earlier rules have left."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.operators.brackets import balanced, lacks_close, lacks_open, wrapped

TOKEN = "array<struct<value:string,start:int,end:int,id:int>>"
# Character classes.
GREEK = "αβγδεζηθικλμνξοπρςστυφχψω"
QUOTES = "\"'‘’‚‛“”„‟"
HYPHENS = "-‐‑‒–—―"
PRIMES = "'`′″‴"
RELATIONS = "=<>≠≡≢≣≤≥≦≧≨≩≪≫"
ELLIPSIS = "⋯"
# Right parts that a hyphen is split before.
SPLIT_SUFFIXES = frozenset(
    "related promoted soluble linked isomer saturated bonded blood transferrin analogous layer exchange independent treated cation "
    "enzyme shaped guest derivatives labelled group tethered coordinated biomonitor intermediate type mediated treatment catalysed "
    "lactoferrin substituent the protein protected assisted disubstituted selectivity configuration , form enriched containing only "
    "like catalyzed octahedra chains initiated moiety ligand binding units strategy compounds bond bound bonding ions bridged modified "
    "filled 15 stabilised derived position terminated protecting bonds complexes substituted hyperaccumulator donor coating terminal "
    "isomers coated peptide based complex unsaturated".split(" ")
)
# Counting prefixes, oxidation states, trademarks, possessives, labels of groups.
_COUNT_WORD = re.compile("mono|di|tri|tetra|penta|hexa|hepta|un|de|re|pre")
_STATE = re.compile(r"\((o|i{1,4}|i{0,3}[xv]|[xv]i{0,4})\)$", re.I)
_MARK = re.compile(r".+?(\((?:TM|R)\)|\(\((?:TM|R)\)\))$")
_POSSESSIVE = re.compile(r"[A-Z][a-z]+s'$")
_LABEL = re.compile(r"[RAXYM]\d*(=)")
_PRIME = f"[{PRIMES}]*"
# What may stand before the hyphen of a locant.
_LOCANT = rf"(?:\d+{_PRIME}[RSEZDLH]?|\((?:[RSEZDLH±]|\+|[{HYPHENS}])\)|[DLRSEZ]|(?:[CNOS]|Se)\d*|\d*[{GREEK}]|cis|trans|o(?:rtho)?|m(?:eta)?|p(?:ara)?|asym|sym|sec|tert|catena|closo|enantio|ent|endo|exo|fac|mer|gluco|nido|aci|erythro|threo|arachno|meso|syn|anti|tele|cine){_PRIME}"
_LOCANTS = re.compile(rf"{_LOCANT}(?:,{_LOCANT})*[{HYPHENS}]\S*$")
# Symbols of the elements, longer ones before their first letters.
_ELEMENTS = "Zr Zn Yb Y Xe W V U Tm Tl Ti Th Te Tc Tb Ta Sr Sn Sm Si Sg Se Sc Sb S Ru Rn Rh Rf Re Rb Ra Pu Pt Pr Po Pm Pd Pb Pa P Os O Np No Ni Ne Nd Nb Na N Mt Mo Mn Mg Md Lu Lr Li La Kr K Ir In I Hs Ho Hg Hf He H Ge Gd Ga Fr Fm Fe F Eu Es Er Dy Ds Db Cu Cs Cr Co Cm Cl Cf Ce Cd Ca C Br Bk Bi Bh Be Ba B Au At As Ar Am Al Ag Ac"
_ATOM = rf"(?:{_ELEMENTS.replace(' ', '|')})"
_BOND_ATOM = rf"(?:{_ATOM}\d*{_PRIME}|{_ATOM}\(\d+\))"
# Marks of a bond, one of them from the private use area.
_BONDS = re.compile(rf"{_BOND_ATOM}(?:[{HYPHENS}{ELLIPSIS}=\ue001]{_BOND_ATOM})+$")

Cut = tuple[int, ...]
Rule = Callable[[str], Cut | None]


def around(text: str, sub: str, keep: int | None = None) -> Cut | None:
    """Cuts on both sides of the first `sub`, where it stands before the last character of three or more."""
    if len(text) < 3 or sub not in text[:-1]:
        return None
    at = text.find(sub)
    return (at, at + (len(sub) if keep is None else keep))


_SUFFIX_SIZES = sorted({len(x) for x in SPLIT_SUFFIXES if len(x) > 2}, reverse=True)


def _leads_suffix(word: str) -> bool:
    """Whether a listed right part is the whole word, or leads it behind at most one counting prefix."""
    m = _COUNT_WORD.match(word)
    rest = word[m.end() :] if m else word
    return word in SPLIT_SUFFIXES or any(rest[:n] in SPLIT_SUFFIXES for n in _SUFFIX_SIZES if n <= len(rest))


def hyphen_index(text: str) -> int:
    """The last hyphen to split at, neither first nor last in the token; -1 if there is none.

    A dash always splits. A hyphen splits before a listed part, or, from the third character on, between two small letters
    and nothing but small letters. One that would leave brackets open on its right, in a token that has none open, doesn't.
    """
    known = balanced(text)
    for m in reversed(list(re.finditer(f"(?<=.)[{HYPHENS}](?=.)", text, re.S))):
        at, right = m.start(), text[m.end() :]
        if known and not balanced(right):
            continue
        plain = at > 1 and re.fullmatch("[a-z]{2}", text[at - 2 : at]) and re.fullmatch("[a-z]+", right)
        if m[0] in "–—" or plain or _leads_suffix(right.lower()):
            return at
    return -1


def hyphen_column(word: Column) -> Column:
    """hyphen_index of each word; null for a null one."""

    @F.pandas_udf("int")
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: hyphen_index(w) if w is not None else None)

    return run(word)


def comma_index(text: str) -> int:
    """The last comma with no hyphen right behind it and no hyphen or opening bracket before it; -1 if there is none."""
    clear = min((i for i in map(text.find, "-[(") if i >= 0), default=len(text))
    return next((i for i in range(min(clear, len(text) - 2), 0, -1) if text[i] == "," and text[i + 1] != "-"), -1)


def _front_bracket(t: str) -> Cut | None:
    return (1,) if t[0] in "([{" and (wrapped(t) or lacks_close(t)) else None


def _back_bracket(t: str) -> Cut | None:
    return (len(t) - 1,) if t[-1] in ")]}" and (wrapped(t) or lacks_open(t)) else None


def _state_end(t: str) -> Cut | None:
    return (t.rfind("("),) if _STATE.search(t) else None


def _front_mark(t: str) -> Cut | None:
    return (1,) if t[0] in RELATIONS + QUOTES + ",-/><=." else None


def _back_mark(t: str) -> Cut | None:
    return (len(t) - 1,) if t[-1] in ".,;:!?™®" + QUOTES and not _POSSESSIVE.match(t) else None


def _trademark(t: str) -> Cut | None:
    return (m.start(1),) if (m := _MARK.match(t)) else None


def _colon(t: str) -> Cut | None:
    cut = around(t, ":")
    return cut if cut and balanced(t) and balanced(t[cut[1] :]) else None


def _plus(t: str) -> Cut | None:
    cut = around(t, "+")
    return cut if cut and cut[0] > 0 and t[-1] != "-" else None


def _equals(t: str) -> Cut | None:
    m = _LABEL.search(t) if around(t, "=") else None
    return (m.start(1), m.end(1)) if m else None


def _comma_hyphen(t: str) -> Cut | None:
    return (t.find(",-") + 1,) if around(t, ",-") else None


def _comma(t: str) -> Cut | None:
    i = comma_index(t)
    return (i, i + 1) if i >= 0 else None


def _hyphen(t: str) -> Cut | None:
    i = hyphen_index(t)
    if i < 0 or (not re.search("[a-z][a-z]", t) and re.search("[A-Z]", t) and _BONDS.match(t)):
        return None
    return (i + 1,) if not t.endswith("NMR") and _LOCANTS.match(t) else (i, i + 1)


RULES: list[Rule] = [_front_bracket, _back_bracket, _state_end, _front_mark, _back_mark, _trademark, lambda t: around(t, "<"), lambda t: around(t, ">"), lambda t: around(t, ";"), lambda t: around(t, "/"), _colon, _plus, lambda t: around(t, ELLIPSIS), _equals, _comma_hyphen, lambda t: around(t, "--"), _comma, _hyphen]


def split_once(text: str) -> list[tuple[int, int]] | None:
    """The non-empty parts of a token by the first rule that applies; None if it stays whole. A rule that leaves one
    part only ends the search."""
    if len(text) < 2 or text[0] == "$" or text == "--" or _STATE.match(text):
        return None
    for rule in RULES:
        if cut := rule(text):
            bounds = [0, *cut, len(text)]
            parts = [(a, b) for a, b in zip(bounds, bounds[1:], strict=False) if b > a]
            return parts if len(parts) > 1 else None
    return None


@lru_cache(maxsize=1 << 17)
def token_parts(token: str) -> tuple[tuple[int, int], ...]:
    """Bounds of the parts of a token without blanks, split until no rule applies. Remembered: texts repeat tokens."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(token))]
    while todo:
        start, end = todo.pop()
        parts = split_once(token[start:end])
        if parts is None:
            out.append((start, end))
        else:
            todo += [(start + a, start + b) for a, b in reversed(parts)]
    return tuple(out)


def tokenize(text: str) -> list[tuple[str, int, int, int]]:
    """(value, start, end, id) of the tokens of a text."""
    out: list[tuple[str, int, int, int]] = []
    for m in re.finditer(r"\S+", text):
        for a, b in token_parts(m[0]):
            out.append((m[0][a:b], m.start() + a, m.start() + b, len(out)))
    return out


def force_splits(text: str, offsets: list[int]) -> list[tuple[int, int]]:
    """Tokens at blanks, cut at the given offsets as well."""
    out = []
    for m in re.finditer(r"\S+", text):
        bounds = [m.start(), *sorted(o for o in set(offsets) if m.start() < o < m.end()), m.end()]
        out += zip(bounds, bounds[1:], strict=False)
    return out


def rule_tokens(text: Column) -> Column:
    """array<struct<value, start, end, id>> of a text's rule tokens; none for a null text."""

    @F.pandas_udf(TOKEN)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: [{"value": v, "start": a, "end": b, "id": i} for v, a, b, i in tokenize(t)] if t is not None else [])

    return run(text)


def wordpiece(tokens: list[str], vocab: frozenset[str], unknown: str = "[UNK]", longest: int = 100) -> list[list[str]]:
    """Greedy longest-prefix pieces of each token, inner pieces with ##; a token that can't be covered is unknown."""
    out = []
    for token in tokens:
        pieces: list[str] = []
        at = 0
        while at < len(token) and len(token) <= longest:
            end = next((e for e in range(len(token), at, -1) if ("##" if at else "") + token[at:e] in vocab), None)
            if end is None:
                break
            pieces.append(("##" if at else "") + token[at:end])
            at = end
        out.append(pieces if at == len(token) and pieces else [unknown])
    return out


def wordpiece_udf(vocab: list[str]) -> Callable[[Column], Column]:
    """array<string> tokens to array<array<string>> pieces."""
    known = frozenset(vocab)

    @F.pandas_udf("array<array<string>>")
    def run(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: wordpiece(list(t), known) if t is not None else [])

    return run


def align_from_right(text: str, pieces: list[str]) -> list[tuple[int, int] | None]:
    """(start, end) of each piece, found from the last one back, each before the one behind it; None where a piece is
    not in what is left, which then stays as it is."""
    out: list[tuple[int, int] | None] = []
    limit = len(text)
    for piece in reversed(pieces):
        p = piece[2:] if piece.startswith("##") and len(piece) > 2 else piece
        at = text.rfind(p, 0, limit)
        out.append((at, at + len(p)) if at >= 0 else None)
        limit = at if at >= 0 else limit
    return out[::-1]
