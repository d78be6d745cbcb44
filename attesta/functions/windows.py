"""Windows over the sentences, words and turns of one text; row-local."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from . import text as T


def sentence_windows(sents: Column, size: int = K.WINDOW_SENTENCES) -> Column:
    """Consecutive sentences joined by a blank; one window when there are few."""
    return T.let(sents, lambda all_: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(all_) - (size - 1), F.lit(1))),
        lambda i: F.array_join(F.slice(all_, i, size), " ")))


def token_windows(toks: Column, width: int) -> Column:
    """Half-overlapping windows of words; the last one ends with the text."""
    stride = max(1, width // 2)
    return T.let(toks, lambda all_: F.transform(
        F.sequence(F.lit(0), F.ceil(F.greatest(F.size(all_) - width, F.lit(0)) / stride).cast("int")),
        lambda k: F.array_join(F.slice(all_, k * stride + 1, width), " ")))


def turn_windows(transcript: Column, window: int = K.WINDOW_CHARS, stride: int = K.STRIDE_CHARS,
                 keep_tail: bool = False) -> Column:
    """Windows of whole turns: array<struct<first,last,body>>.

    A window takes turns while they fit, and at least one.  The next window
    starts at the first turn that is ``stride`` characters further on; windows
    end once that turn is the last one, so by default a last turn that no
    window reached is not repeated.  ``keep_tail`` adds a window for it.
    """
    def ends_of(turns):
        return F.aggregate(turns, F.array(F.lit(0)), lambda acc, t: F.array_append(
            acc, F.element_at(acc, -1) + F.length(t) + 1))

    return T.let(T.non_empty(F.split(transcript, f"(?={K.TURN_TAG})")), lambda turns: T.let(
        ends_of(turns), lambda ends: _turn_blocks(turns, ends, window, stride, keep_tail)))


def _turn_blocks(turns: Column, ends: Column, window: int, stride: int, keep_tail: bool) -> Column:
    n = F.size(turns)

    def at(i):
        return F.get(ends, i)

    starts = F.aggregate(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("out")),
        lambda acc, i: F.when(
            (acc["next"] == i) & ((i == 0) | (i < n - 1)),
            F.struct(F.size(F.filter(ends, lambda e: e < at(i) + stride)).alias("next"),
                     F.array_append(acc["out"], i).alias("out")),
        ).otherwise(acc))["out"]

    def stop(i):
        return F.greatest(i + 1, F.size(F.filter(ends, lambda e: e <= at(i) + window)) - 1)

    def block(i):
        return F.struct(i.alias("first"), (stop(i) - 1).alias("last"),
                        F.array_join(F.slice(turns, i + 1, stop(i) - i), "\n").alias("body"))

    blocks = F.transform(starts, block)
    if keep_tail:
        blocks = F.when(F.element_at(blocks, -1)["last"] < n - 1,
                        F.array_append(blocks, block(n - 1))).otherwise(blocks)
    return F.when(n > 0, blocks)


def char_windows(c: Column, window: int = K.WINDOW_CHARS, stride: int = K.STRIDE_CHARS) -> Column:
    """Plain character windows for a text without turns."""
    more = F.ceil(F.greatest(F.length(c) - window, F.lit(0)) / stride).cast("int")
    return F.when(F.length(c) > 0, F.transform(
        F.sequence(F.lit(0), more), lambda k: F.substring(c, k * stride + 1, F.lit(window))))


def longest_run(text: Column, query: Column, gap: int = 2) -> Column:
    """struct<start,end,hits> of the longest run of query words in a text.

    Up to ``gap`` other words may lie between two hits, but no ; . or :
    Two hits are needed unless the query has a single content word.  Words and
    those marks are read once; hits are only followed where there are enough,
    and offsets only worked out where a run is found.
    """
    def of_words(wanted, toks):
        enough = F.least(F.lit(2), F.size(wanted))
        hits = F.filter(F.transform(toks, lambda w, i: F.when(w.isin(*";.:"), -1).when(F.array_contains(wanted, F.lower(w)), i)), lambda i: i.isNotNull())
        return T.let(hits, lambda found: F.when(F.size(F.filter(found, lambda i: i >= 0)) >= enough, T.let(
            _best_run(found, gap), lambda best: F.when(best["best"] >= enough, _run_offsets(text, best)))))

    return T.let(F.array_distinct(T.content_words(query)), lambda wanted: F.when(F.size(wanted) > 0, T.let(
        F.regexp_extract_all(text, F.lit(f"({RUN_TOKEN})"), 1), lambda toks: F.when(
            F.arrays_overlap(wanted, F.transform(toks, F.lower)), of_words(wanted, toks)))))


RUN_TOKEN = "[a-zA-Z0-9']+|[;.:]"


def _best_run(hits: Column, gap: int) -> Column:
    """The longest run by the places of its first and last word; the first of equal ones.  A place of -1 is a mark."""
    zero = F.struct(*[F.lit(v).alias(n) for n, v in (("i", -100), ("first", 0), ("n", 0), ("best", 0), ("bf", 0), ("bl", 0))])

    def step(acc, i):
        near = i - acc["i"] <= gap + 1
        first = F.when(near, acc["first"]).otherwise(i)
        n = F.when(near, acc["n"]).otherwise(0) + 1
        longer = n > acc["best"]
        return F.struct(F.when(i < 0, -100).otherwise(i).alias("i"), first.alias("first"), n.alias("n"), F.when(i < 0, acc["best"]).otherwise(F.greatest(n, acc["best"])).alias("best"),
                        F.when((i >= 0) & longer, first).otherwise(acc["bf"]).alias("bf"), F.when((i >= 0) & longer, i).otherwise(acc["bl"]).alias("bl"))

    return F.aggregate(hits, zero, step)


def _run_offsets(text: Column, best: Column) -> Column:
    return T.let(T.match_spans(text, RUN_TOKEN), lambda at: F.struct(
        F.get(at, best["bf"])["start"].alias("start"), F.get(at, best["bl"])["end"].alias("end"), best["best"].alias("hits")))


def place_sentences(note: Column, sents: Column) -> Column:
    """array<struct<start,end,mode>>: sentences found behind a moving cursor.

    Exact text first, then an anchor on the first 40, 24 or 16 characters whose
    end is bounded by the same number of closing characters.
    """
    def found(start, end, mode):
        return F.struct(start.alias("start"), end.alias("end"), F.lit(mode).alias("mode"))

    def anchored(s, at, size, otherwise):
        def at_head(head):
            tail = F.position(F.right(s, F.lit(size)), note, head)
            return F.when(head > 0, T.let(tail, lambda t: found(head - 1, F.least(
                F.when(t > 0, t - 1 + size).otherwise(head - 1 + F.length(s)), F.length(note)), "fuzzy"))).otherwise(otherwise)

        return F.when(F.length(s) >= size, T.let(F.position(F.left(s, F.lit(size)), note, at + 1), at_head)).otherwise(otherwise)

    def step(acc, s):
        at = acc["cursor"]
        none = F.lit(None).cast("int")
        loose = found(none, none, "fail")
        for size in (16, 24, 40):
            loose = anchored(s, at, size, loose)
        spot = T.let(F.position(s, note, at + 1), lambda p: F.when(
            p > 0, found(p - 1, p - 1 + F.length(s), "exact")).otherwise(loose))
        return T.let(spot, lambda x: F.struct(
            F.coalesce(x["end"], at).alias("cursor"), F.array_append(acc["out"], x).alias("out")))

    return F.aggregate(sents, F.struct(
        F.lit(0).alias("cursor"), F.array().cast("array<struct<start:int,end:int,mode:string>>").alias("out")), step)["out"]


def words_before(text: Column, starts: Column) -> Column:
    """Runs of white space before each start, NULL for a NULL one; starts never go back.

    Each stretch between two starts is read once.
    """
    def step(acc, x):
        at, n = acc["at"], acc["n"]
        more = F.when(at == 0, F.regexp_count(F.substring(text, F.lit(1), x), F.lit("\\s+"))).otherwise(
            F.regexp_count(F.substring(text, at, x - at + 1), F.lit("(?<=\\S)\\s")))
        return F.when(x.isNull(), F.struct(at.alias("at"), n.alias("n"), F.array_append(acc["out"], F.lit(None).cast("int")).alias("out"))).otherwise(
            T.let(n + more, lambda now: F.struct(x.alias("at"), now.alias("n"), F.array_append(acc["out"], now).alias("out"))))

    return F.aggregate(starts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out")), step)["out"]


def sections_by_position(note: Column, sents: Column) -> Column:
    """Section of each sentence by the header block its position falls into."""
    placed = F.aggregate(sents, F.struct(
        F.lit(0).alias("cursor"), F.array().cast("array<int>").alias("out")),
        lambda acc, s: T.let(F.position(s, note, acc["cursor"] + 1), lambda p: F.struct(
            F.when(p > 0, p - 1 + F.length(s)).otherwise(acc["cursor"]).alias("cursor"),
            F.array_append(acc["out"], p - 1).alias("out"))))["out"]
    return T.let(T.header_blocks(note), lambda blocks: F.transform(placed, lambda p: F.coalesce(F.get(F.filter(
        blocks, lambda b: (b["start"] <= p) & (p < b["end"])), F.lit(0))["section"], F.lit("all"))))


def entities(source: Column, target: Column, patterns: list[tuple[str, str]]) -> Column:
    """Pattern matches of the source that the target repeats.

    Overlaps are resolved from left to right, the longest match first at each
    start: array<struct<start,end,text,kind,target_start>>.
    """
    def tagged(kind):
        return lambda x: F.struct(
            x["start"].alias("start"), (-(x["end"] - x["start"])).alias("neg_len"), x["end"].alias("end"),
            x["text"].alias("text"), F.lit(kind).alias("kind"))

    found = F.concat(*[F.transform(T.match_spans(source, p), tagged(kind)) for kind, p in patterns])
    kept = F.aggregate(F.array_sort(found), F.struct(
        F.lit(-1).alias("stop"),
        F.array().cast("array<struct<start:int,neg_len:int,end:int,text:string,kind:string>>").alias("out")),
        lambda acc, x: F.when(x["start"] >= acc["stop"], F.struct(
            x["end"].alias("stop"), F.array_append(acc["out"], x).alias("out"))).otherwise(acc))["out"]
    placed = F.transform(kept, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), x["kind"].alias("kind"),
        (F.position(F.lower(x["text"]), F.lower(target)) - 1).alias("target_start")))
    return F.filter(placed, lambda x: x["target_start"] >= 0)


EDITED = "struct<text:string,spans:array<struct<start:int,end:int,original:string,replacement:string,category:string>>>"


def apply_edits(note: Column, edits: Column, most: int) -> Column:
    """Apply (original, replacement, category) edits in order, with provenance."""
    zero = F.struct(note.alias("text"), F.array().cast(
        "array<struct<start:int,end:int,original:string,replacement:string,category:string>>").alias("spans"))

    def step(acc, e):
        old, new = T.strip(e["original"]), T.strip(e["replacement"])
        exact = F.position(old, acc["text"])
        at = F.when(exact > 0, exact).otherwise(F.position(F.lower(old), F.lower(acc["text"])))
        usable = (F.size(acc["spans"]) < most) & (old != "") & (new != "") & (old != new) & (at > 0)
        return F.when(usable, F.struct(
            F.concat(F.left(acc["text"], at - 1), new,
                     F.substring(acc["text"], at + F.length(old), F.length(acc["text"]))).alias("text"),
            F.array_append(acc["spans"], F.struct(
                (at - 1).alias("start"), (at - 1 + F.length(new)).alias("end"),
                F.substring(acc["text"], at, F.length(old)).alias("original"), new.alias("replacement"),
                e["category"].alias("category"))).alias("spans"))).otherwise(acc)

    return F.aggregate(edits, zero, step)


def swap_once(text: Column, original: Column, replacement: Column) -> Column:
    """The first occurrence of ``original`` replaced; the text itself where there is none."""
    at = F.position(original, text)
    return F.when((original != "") & (at > 0), F.concat(
        F.left(text, at - 1), replacement, F.substring(text, at + F.length(original), F.length(text)))).otherwise(text)


def flip_phrase(text: Column, phrase: Column, negated: Column) -> Column:
    """The first occurrence of a phrase, in any case, replaced by its counterpart."""
    at = F.position(F.lower(phrase), F.lower(text))
    return F.when((phrase != "") & (at > 0), F.concat(
        F.left(text, at - 1), negated, F.substring(text, at + F.length(phrase), F.length(text)))).otherwise(text)


def needed(pattern: str) -> list[str]:
    """Lower-case strings that every match holds, whatever its case; none for patterns of other than plain characters and blanks."""
    if not re.fullmatch(r"(?:[\w /,;:%-]|\\[.,/%-]|\\s[*+]?)+", pattern, re.ASCII):
        return []
    parts = re.split(r"\\s[*+]?", pattern)
    return [p.replace("\\", "").lower() for p in parts if p]


def apply_rules(note: Column, rules: list[tuple[str, str, str]], most: int) -> Column:
    """Pattern edits; a fixed sentence is appended when none applies.

    A pattern is searched for only in texts that hold the plain strings it needs.
    """
    zero = F.struct(note.alias("text"), F.lower(note).alias("low"), F.array().cast(
        "array<struct<start:int,end:int,original:string,replacement:string,category:string>>").alias("spans"))
    listed = F.array(*[F.struct(F.lit(T.ascii_edges(f"(?i)\\b{p}\\b")).alias("p"), F.lit(r).alias("r"), F.lit(c).alias("c"),
                                F.array(*map(F.lit, needed(p))).cast("array<string>").alias("need")) for p, r, c in rules])

    def step(acc, e):
        at = F.regexp_instr(acc["text"], e["p"])
        may = F.forall(e["need"], lambda s: F.contains(acc["low"], s))
        return F.when((F.size(acc["spans"]) < most) & may & (at > 0), edited(acc, e, at)).otherwise(acc)

    def edited(acc, e, at):
        old = F.regexp_substr(acc["text"], e["p"])
        text = F.concat(F.left(acc["text"], at - 1), e["r"], F.substring(acc["text"], at + F.length(old), F.length(acc["text"])))
        return F.struct(text.alias("text"), F.lower(text).alias("low"), F.array_append(acc["spans"], F.struct(
            (at - 1).alias("start"), (at - 1 + F.length(e["r"])).alias("end"), old.alias("original"),
            e["r"].alias("replacement"), e["c"].alias("category"))).alias("spans"))

    tail = K.CORRUPTION_FALLBACK
    return T.let(F.aggregate(listed, zero, step), lambda done: F.when(F.size(done["spans"]) > 0, F.struct(done["text"].alias("text"), done["spans"].alias("spans"))).otherwise(F.struct(
        F.concat(note, F.lit(tail)).alias("text"),
        F.array(F.struct(F.length(note).alias("start"), (F.length(note) + len(tail)).alias("end"), F.lit("").alias("original"),
                         F.lit(tail.strip()).alias("replacement"), F.lit("inserted_hallucination").alias("category")))
        .alias("spans"))))