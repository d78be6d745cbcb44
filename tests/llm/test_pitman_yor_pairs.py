"""The whole table of word pairs is learnt and scored, whatever the counts."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta.llm import pitman_yor
from attesta.llm.pitman_yor import discount_of, score_texts


def scores(frame, learnt):
    return {r["doc_id"]: r["score"] for r in score_texts(frame, F.col("doc_id") < learnt).collect()}


def test_rare_words_are_scored_by_the_word_before(docs):
    rng = random.Random(3)
    filler = [(i, " ".join(f"w{rng.randrange(6000)}" for _ in range(60))) for i in range(150)]
    train = [(i, f"{t} zeta omega") for i, t in filler[:4]] + filler[4:]  # 4 of some 9000 tokens
    got = scores(docs(train + [(1000, "zeta omega"), (1001, "omega zeta"), (1002, "zeta zeta")]), 1000)
    assert got[1000] > got[1001] + 2 and got[1000] > got[1002] + 2


def test_one_text_in_closed_form(docs):
    got = scores(docs([(0, "a b C d"), (1, "a B"), (2, "b a"), (3, "a x"), (4, "x a"), (5, "")]), 1)
    d, end = discount_of(5, 0), None
    word = defaultdict(lambda: (1 + 5 * d) / 6 / 6, {w: (1 - d + (1 + 5 * d) / 6) / 6 for w in ["a", "b", "c", "d", end]})
    seen = {(end, "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", end)}

    def p(u, w):
        return ((u, w) in seen) * (1 - d) / 2 + (1 + d) / 2 * word[w] if u in word and u != "x" else word[w]

    for i, t in enumerate(["a b c d", "a b", "b a", "a x", "x a", ""]):
        line = [end, *t.split(), end]
        assert got[i] == pytest.approx(sum(math.log10(p(u, w)) for u, w in zip(line, line[1:])))


def plain(train, probes, sweeps, burn, rng):
    """The same restaurants in dictionaries, customers seated one by one."""
    pairs, word, contexts = Counter(), Counter(), Counter()
    for t in train:
        line = [None, *t.split(), None]
        pairs.update(zip(line, line[1:]))
        word.update(line[1:])
    for (u, _), n in pairs.items():
        contexts[u] += n
    d2, d1 = (discount_of(*[sum(n == k for n in c.values()) for k in (1, 2)]) for c in (pairs, word))

    def seats(n, base, others, d):
        t = 1
        for j in range(1, n):
            fresh = (1 + d * (others + t)) * base
            t += rng.random() < fresh / (fresh + j - d * t)
        return t

    def parents(tables, own):
        served = Counter()
        for (_, w), t in tables.items():
            served[w] += t
        total = sum(own.values()) if own else len(word)
        own = {w: seats(n, 1 / (len(word) + 1), total - own.get(w, 1), d1) for w, n in served.items()}
        rest = (1 + d1 * sum(own.values())) / (len(word) + 1)
        return own, lambda w: (served[w] - d1 * own.get(w, 0) + rest) / (1 + sum(served.values()))

    tables, total = dict.fromkeys(pairs, 1), defaultdict(float)
    own, p1 = parents(tables, {})
    for sweep in range(sweeps):
        opened = Counter()
        for (u, _), t in tables.items():
            opened[u] += t
        tables = {(u, w): seats(n, p1(w), opened[u] - tables[u, w], d2) for (u, w), n in pairs.items()}
        own, p1 = parents(tables, own)
        opened = Counter()
        for (u, _), t in tables.items():
            opened[u] += t
        if sweep >= burn:
            for u, w in probes:
                total[u, w] += (pairs[u, w] - d2 * tables.get((u, w), 0) + (1 + d2 * opened[u]) * p1(w)) / (1 + contexts[u])
    return {k: v / (sweeps - burn) for k, v in total.items()}


def test_seatings_against_single_customers(docs, monkeypatch):
    monkeypatch.setattr(pitman_yor, "OWNED", 200)  # many owners and batches of few texts
    monkeypatch.setattr(pitman_yor, "BATCH", 300)
    rng = random.Random(5)
    train = [" ".join(rng.choice("abcdefgh") if rng.random() < 0.8 else f"v{rng.randrange(30)}" for _ in range(rng.randrange(12))) for _ in range(80)]
    probes = ["a b c", "v1 a", "never a", "h g f e d", ""]
    lines = [[None, *t.split(), None] for t in probes]
    runs = [plain(train, {k for line in lines for k in zip(line, line[1:])}, 4, 2, rng) for _ in range(30)]
    got = [scores(docs([*enumerate(train), *((100 + i, t) for i, t in enumerate(probes))]), 100)]
    for i, line in enumerate(lines):
        want = sum(math.log10(sum(r[k] for r in runs) / len(runs)) for k in zip(line, line[1:]))
        assert got[0][100 + i] == pytest.approx(want, abs=0.05 * (len(line) - 1))


def test_tokens_of_slices():
    column = pa.array([f"W{i} b\x0bc\x1c É " if i % 5 else None for i in range(40)] + ["", " "])
    for a, z in ((0, 42), (20, 1), (21, 1), (3, 9), (40, 2)):
        part = column.slice(a, z)
        words, line, lens = pitman_yor.tokens(part)
        want = [[*(t or "").encode().lower().split(), b""] for t in part.to_pylist()]
        assert [words[i].as_py() for i in line] == sum(want, []) and lens.tolist() == [len(w) for w in want]


def test_packed_columns():
    for top in (0, 1, 255, 256, 70_000, 2**40):
        values = np.arange(5) * top // 4
        assert (pitman_yor.unpack(pitman_yor.pack(values)) == values).all()
    big = np.array([0, 7, 7, 2**63, 2**64 - 1], np.uint64)
    assert (pitman_yor.keys(pitman_yor.pack_keys(big)) == big).all()
    assert not len(pitman_yor.unpack(pitman_yor.pack(np.zeros(0, np.int64))))
