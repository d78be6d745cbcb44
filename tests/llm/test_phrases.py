"""Collocations by prefix-free parsing against direct counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from attesta.llm import phrases
from attesta.llm.words import span_codes

SCHEMA = "text string, lang string, n long, phrase string"


def pieces(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", text)]


def brute(rows, longest, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = {}
        for p, a in cand.items():
            inside = any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cand.items())
            if not inside:
                kept[p] = a
        rows = []
        for p, a in kept.items():
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top]):
            out.append((lang, rank + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["Été", "ÀB", "x\u00a0y", "日本", "a" * 40, "z" * 1500]
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    out = [(None, "en"), ("", "en"), (" \t.\n", "fr"), ("One", None), ("tail, of one word", None)]
    for _ in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", " : "]) for _ in range(rng.randrange(1, 60)))
        out.append((text + (shared if rng.random() < 0.3 else ""), rng.choice(["en", "en", "fr", None])))
    return out + [out[-1]] * 10 + [("same line again\n" * 300, "en")]


@pytest.mark.parametrize("longest, least, trigger", [(5, 8, 4), (5, 8, 1), (5, 8, 1 << 40), (2, 5, 3), (3, 20, 32)])
def test_against_direct_counting(spark, longest, least, trigger):
    rows = texts(1, 150)
    df = spark.createDataFrame([(*r, 3, "p") for r in rows], SCHEMA).repartition(3)
    got = phrases.collocations(df, longest=longest, least=least, top=25, trigger=trigger).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, longest, least, 25)


def test_chunks_own_every_word_once_and_overlap(spark):
    rows = texts(2, 40)
    df = spark.createDataFrame([(*r, 3, "p") for r in rows], SCHEMA)
    chunks = phrases.parse(df, "text", "lang", 5, 4).collect()
    assert sum(c["owned"] for c in chunks) == sum(len(w) for t, _ in rows for w in pieces(t))
    for c in chunks:
        words = re.split("[ \n]", c["chunk"])
        assert c["owned"] <= len(words) <= c["owned"] + 4


def test_copies_are_one_dictionary_entry(spark):
    df = spark.createDataFrame([(texts(3, 5)[7][0], "en", 1, "p")] * 50, SCHEMA)
    parsed = phrases.parse(df, "text", "lang", 5, 4)
    assert parsed.distinct().count() <= parsed.count() / 40


def test_false_hits_of_a_full_bitmap_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_BITS", 1 << 6)
    monkeypatch.setattr(phrases, "bitmap_of", lambda p, n: np.full(1, 2**64 - 1, np.uint64))
    rows = texts(4, 60)
    df = spark.createDataFrame([(*r, 3, "p") for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in phrases.collocations(df, least=6, top=50).collect()) == brute(rows, 5, 6, 50)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_scores_beyond_64_bits(spark):
    """1000 a n of a small corpus is small; the expression itself is exact for large counts."""
    f, n, left, right = 10**14, 10**18, 10**15 + 7, 3 * 10**14 + 1
    got = spark.sql(f"select (cast(1000 as decimal(4, 0)) * cast({f}L as decimal(15, 0)) * cast({n}L as decimal(19, 0)))"
                    f" div (cast({left}L as decimal(19, 0)) * cast({right}L as decimal(19, 0))) as s").collect()[0]["s"]
    assert got == 1000 * f * n // (left * right)


def test_codes_tell_spans_apart():
    """A Thue-Morse word and its complement collide under any polynomial modulo 2**64, not here."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    text = np.frombuffer((word + word.translate(str.maketrans("ab", "ba")) + "ab" * 20).encode(), np.uint8)
    starts = np.array([0, 2048, 0, 2048, 4096, 4097, 4098])
    ends = np.array([1024, 3072, 2048, 4096, 4104, 4105, 4106])
    codes = span_codes(text, starts, ends)
    assert len(set(codes[:4].tolist())) == 4
    assert codes[4] != codes[5] and codes[4] == codes[6]
    assert (span_codes(text, starts, ends, 1) != codes).all()
