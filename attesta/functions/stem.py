"""Porter's stemmer over word arrays, and the alignment that METEOR scores.

The rules are data; ``steps`` turns them into a chain of maps over an array,
written once for Spark columns and once for the SQL that checks them.  A letter
y counts as a consonant at the start or behind a vowel; such a y is written Y
while the rules run, so that every condition is a plain pattern.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import let

DONE, CUT = "\u0001", "\u0002"  # ends a word that no rule may touch; ends one that has lost "ed" or "ing"
CONS, VOWEL = "[^aeiouy]", "[aeiouy]"
SOME = f"^{CONS}*{VOWEL}+{CONS}"  # measure above 0
MORE = f"^{CONS}*{VOWEL}+{CONS}+{VOWEL}+{CONS}"  # measure above 1
SHORT = f"{CONS}{VOWEL}[^aeiouywxY]$|^{VOWEL}{CONS}$"  # ends consonant, vowel, consonant


class Columns:
    """The operations of the rules on Spark columns."""

    ends = staticmethod(lambda w, end: w.endswith(end))
    cut = staticmethod(lambda w, n: F.left(w, F.length(w) - n))
    cat = staticmethod(lambda w, end: F.concat(w, F.lit(end)))
    like = staticmethod(lambda w, pattern: w.rlike(pattern))
    both = staticmethod(lambda a, b: a & b)
    either = staticmethod(lambda a, b: a | b)
    no = staticmethod(lambda a: ~a)
    last = staticmethod(lambda w, n: F.lower(F.substring(w, -n, 1)))
    same = staticmethod(lambda a, b: a == b)
    replace = staticmethod(lambda w, pattern, by: F.regexp_replace(w, pattern, by.replace("\\", "$")))
    lower = staticmethod(F.lower)
    each = staticmethod(lambda words, f: F.transform(words, f))

    @staticmethod
    def choose(cases, default):
        for condition, value in reversed(cases):
            default = F.when(condition, value).otherwise(default)
        return default

    @staticmethod
    def lookup(w, table, default):
        known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
        return F.coalesce(F.try_element_at(known, w), default)


def quoted(s: str) -> str:
    return "'" + s.replace(DONE, "' || chr(1) || '").replace(CUT, "' || chr(2) || '") + "'"


class Sql:
    """The same operations as SQL text."""

    ends = staticmethod(lambda w, end: f"ends_with({w}, {quoted(end)})")
    cut = staticmethod(lambda w, n: f"left({w}, length({w}) - {n})")
    cat = staticmethod(lambda w, end: f"({w} || {quoted(end)})")
    like = staticmethod(lambda w, pattern: f"regexp_matches({w}, '{pattern}')")
    both = staticmethod(lambda a, b: f"({a} AND {b})")
    either = staticmethod(lambda a, b: f"({a} OR {b})")
    no = staticmethod(lambda a: f"(NOT {a})")
    last = staticmethod(lambda w, n: f"lower(substr({w}, -{n}, 1))")
    same = staticmethod(lambda a, b: f"({a} = {b})")
    replace = staticmethod(lambda w, pattern, by: f"regexp_replace({w}, '{pattern}', '{by}', 'g')")
    lower = staticmethod(lambda w: f"lower({w})")
    each = staticmethod(lambda words, f: f"list_transform({words}, lambda w: {f('w')})")
    choose = staticmethod(lambda cases, default: "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {default} END")
    lookup = staticmethod(lambda w, table, default: f"CASE {w} " + " ".join(f"WHEN '{a}' THEN {quoted(b)}" for a, b in table.items()) + f" ELSE {default} END")


def ruled(o, w, rules, condition=None):
    """The first rule whose ending fits decides: (ending, replacement[, pattern for what stays])."""
    cases = []
    for end, by, *own in rules:
        stem = o.cut(w, len(end))
        new = o.cat(stem, by)
        pattern = own[0] if own else condition
        cases.append((o.ends(w, end), o.choose([(o.like(stem, pattern), new)], w) if pattern else new))
    return o.choose(cases, w)


def opened(o, w):
    """Irregular and short words are done; consonant y is marked in the others."""
    marked = o.replace(o.replace(o.replace(w, "^y", "Y"), "([aeiou])y", "\\1Y"), "yy", "yY")
    return o.lookup(w, {a: b + DONE for a, b in K.IRREGULAR_STEMS.items()}, o.choose([(o.like(w, "^.{0,2}$"), o.cat(w, DONE))], marked))


def plural(o, w):
    return o.choose([(o.like(w, "^.ies$"), o.cut(w, 1))], ruled(o, w, K.STEM_PLURAL))


def past(o, w):
    ied = o.choose([(o.like(w, "^.ied$"), o.cut(w, 1))], o.cut(w, 2))
    return o.choose([(o.ends(w, "ied"), ied)], ruled(o, w, [("eed", "ee", SOME), ("ed", CUT, VOWEL), ("ing", CUT, VOWEL)]))


def mended(o, w):
    """What is left of a word that has lost "ed" or "ing" gets its e back or loses a doubled consonant."""
    stem = o.cut(w, 1)
    double = o.both(o.same(o.last(w, 2), o.last(w, 3)), o.like(w, f"{CONS}{CUT}$"))
    once = o.choose([(o.like(stem, "[lsz]$"), stem)], o.cut(w, 2))
    short = o.both(o.both(o.like(stem, SOME), o.no(o.like(stem, MORE))), o.like(stem, SHORT))
    cases = [(o.ends(w, end + CUT), o.cat(stem, "e")) for end in ("at", "bl", "iz")] + [(double, once), (short, o.cat(stem, "e"))]
    return o.choose([(o.no(o.ends(w, CUT)), w), *cases], stem)


def final_y(o, w):
    return ruled(o, w, [("y", "i", f".{CONS}$")])


def final_e(o, w):
    stem = o.cut(w, 1)
    drop = o.either(o.like(stem, MORE), o.both(o.like(stem, SOME), o.no(o.like(stem, SHORT))))
    return o.choose([(o.both(o.ends(w, "e"), drop), stem)], w)


def final_l(o, w):
    return o.choose([(o.both(o.ends(w, "ll"), o.like(o.cut(w, 1), MORE)), o.cut(w, 1))], w)


def ion(o, w):
    """The endings that go behind a measure above 1; "ion" needs an s or t before it."""
    stem = o.cut(w, 3)
    kept = o.choose([(o.both(o.like(stem, MORE), o.like(stem, "[st]$")), stem)], w)
    return o.choose([(o.ends(w, "ion"), kept)], ruled(o, w, [(end, "") for end in K.STEM_DROPPED], MORE))


STEPS = [
    opened, plural, past, mended, final_y,
    lambda o, w: ruled(o, w, [("alli", "al")], SOME),
    lambda o, w: ruled(o, w, K.STEM_DOUBLE + [("logi", "log", VOWEL)], SOME),
    lambda o, w: ruled(o, w, K.STEM_TRIPLE, SOME),
    ion, final_e, final_l,
    lambda o, w: o.lower(o.replace(w, "\\x01", "")),
]


def steps(o, words):
    for step in STEPS:
        words = o.each(words, functools.partial(step, o))
    return words


def stems(words: Column) -> Column:
    """Porter stems of an array of lower-case words."""
    return steps(Columns, words)


def stems_sql(words: str) -> str:
    return steps(Sql, words)


def rouge_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9, stemmed where longer than three characters."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)
    return let(tokens, lambda t: F.zip_with(t, stems(t), lambda w, s: F.when(F.length(w) > 3, s).otherwise(w)))


PLACED = "array<struct<w:string,k:int,side:int,i:int>>"


def numbered(entries: Column) -> Column:
    """Entries sorted by word, each with how many equal words of its side stand behind it in the text."""
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct(e["w"].alias("w"), e["side"].alias("side"), (-e["i"]).alias("neg"))))
    zero = F.struct(F.lit("").alias("w"), F.lit(-1).alias("side"), F.lit(0).alias("k"), F.array().cast(PLACED).alias("out"))

    def step(acc, e):
        k = F.when((acc["w"] == e["w"]) & (acc["side"] == e["side"]), acc["k"] + 1).otherwise(0)
        return F.struct(e["w"].alias("w"), e["side"].alias("side"), k.alias("k"), F.array_append(acc["out"], F.struct(
            e["w"].alias("w"), k.alias("k"), e["side"].alias("side"), (-e["neg"]).alias("i"))).alias("out"))

    return F.array_sort(F.aggregate(ordered, zero, step)["out"])


def paired(entries: Column) -> Column:
    """struct<pairs, rest>: the last equal words of both sides meet, then the last but one, and so on.

    Sorted by word and number, partners stand next to each other.
    """
    def meets(a, b):
        return F.coalesce((a["w"] == b["w"]) & (a["k"] == b["k"]), F.lit(False))

    return let(numbered(entries), lambda all_: F.struct(
        F.filter(F.transform(all_, lambda x, p: F.when(meets(x, F.get(all_, p + 1)), F.struct(
            x["i"].alias("i"), F.get(all_, p + 1)["i"].alias("j")))), lambda x: x.isNotNull()).alias("pairs"),
        F.filter(all_, lambda x, p: ~meets(x, F.get(all_, p + 1)) & ~meets(x, F.get(all_, p - 1))).alias("rest")))


def meteor(hyp: Column, ref: Column, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> Column:
    """METEOR of two arrays of lower-case words: equal words are aligned first, then words with equal stems.

    F mean of precision and recall, less a penalty for the runs in which the
    aligned words lie in both texts.  0 where nothing is aligned.  Synonyms,
    which need a lexical database, are not aligned.
    """
    def entries(words, side):
        return F.transform(words, lambda w, i: F.struct(w.alias("w"), F.lit(side).alias("side"), i.alias("i")))

    def stemmed(rest):
        return let(rest, lambda r: F.zip_with(r, stems(F.transform(r, lambda x: x["w"])), lambda x, s: F.struct(
            s.alias("w"), x["side"].alias("side"), x["i"].alias("i"))))

    def score(pairs, nh, nr):
        n = F.size(pairs)
        runs = F.size(F.filter(pairs, lambda x, p: F.coalesce(
            (x["i"] != F.get(pairs, p - 1)["i"] + 1) | (x["j"] != F.get(pairs, p - 1)["j"] + 1), F.lit(True))))
        precision, recall = n / nh, n / nr
        mean = precision * recall / (alpha * precision + (1 - alpha) * recall)
        return F.when(n > 0, (1 - gamma * F.pow(runs / n, F.lit(beta))) * mean).otherwise(F.lit(0.0))

    def aligned(h, r):
        first = paired(F.concat(entries(h, 0), entries(r, 1)))
        return let(first, lambda a: let(paired(stemmed(a["rest"])), lambda b: let(
            F.array_sort(F.concat(a["pairs"], b["pairs"])), lambda pairs: score(pairs, F.size(h), F.size(r)))))

    return let(hyp, lambda h: let(ref, lambda r: aligned(h, r)))
