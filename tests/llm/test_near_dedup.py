import random
import re

import numpy as np
import pytest

from attesta.llm import near_dedup
from attesta.llm.near_dedup import drop_near_copies, near_groups, parity_map, superminhash


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingle_set(text, size):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size, percent):
    sets = {i: shingle_set(t, size) for i, t in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                changed = True
    return sorted((i, len(sets[i]), label[i], label[i] == i) for i in ids)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    rows = []
    for g in range(8):
        base = [word() for _ in range(rng.choice([1, 2, 3, 5, 40, 150]))]
        for _ in range(n // 8):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(w.upper() if rng.random() < 0.2 and "é" not in w else w for w in copy))
    # a chain: each text is close to the next one only
    base = [f"w{i}" for i in range(120)]
    for step in range(12):
        base[step * 5:step * 5 + 2] = [f"x{step}", f"y{step}"]
        rows.append("\t".join(base))
    rows += ["", None, " \n ", "one", "one", "One two", "one  two", "very " * 20_000]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_equals_brute_force(docs, size, percent):
    rows = corpus(size)
    got = [tuple(r) for r in near_groups(docs(rows), size=size, percent=percent).collect()]
    assert sorted(got) == brute(rows, size, percent)


def test_links_between_members_far_from_the_smallest(docs):
    # one shared bucket is likely; 0 is far from 1 and 2, which are close to each other
    a = [f"a{i}" for i in range(100)]
    rows = [(0, " ".join(a)), (1, " ".join(a[:75] + [f"b{i}" for i in range(25)])), (2, " ".join(a[:75] + [f"b{i}" for i in range(24)] + ["c"]))]
    assert [r["component_id"] for r in near_groups(docs(rows), size=3, percent=85).orderBy("doc_id").collect()] == [0, 1, 1]


def test_family_around_a_text_that_is_missing(docs):
    # every text differs from its base in places of its own; some reach 85 percent of each other, some don't
    rng = random.Random(9)
    base = [f"w{i}" for i in range(140)]
    rows = []
    for i in range(60):
        w = list(base)
        for at in rng.sample(range(140), rng.randint(1, 6)):
            w[at] = f"x{i}y{at}"
        rows.append((i, " ".join(w)))
    got = [tuple(r) for r in near_groups(docs(rows), size=3, percent=85).collect()]
    assert sorted(got) == brute(rows, 3, 85) and 1 < len({r[2] for r in got}) < 60


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for size in (3, 60, 3000):
        shared, own = rng.integers(1, 2**62, 3 * size, dtype=np.uint64), rng.integers(1, 2**62, 2 * size, dtype=np.uint64)
        a, b = np.concatenate([shared, own[:size]]), np.concatenate([shared, own[size:]])
        sig = superminhash(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 3, 120)
        assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.15 and np.isinf(sig[2]).all() and np.isfinite(sig[:2]).all()
        assert (np.sort(sig[:2] % 1, axis=None) >= 0).all()


def test_parity_maps_never_differ_more_than_the_sets():
    rng = np.random.default_rng(7)
    pool = rng.integers(1, 2**62, 4000, dtype=np.uint64)
    for n in (1, 40, 900):
        a, b = rng.choice(pool, n, replace=False), rng.choice(pool, n, replace=False)
        odd = parity_map(np.repeat([0, 1], [n, n]), np.concatenate([a, b]), 2)
        bits = int(np.bitwise_count((odd[0] ^ odd[1]).view(np.uint64)).sum())
        assert bits <= len(set(a.tolist()) ^ set(b.tolist())) and (odd[0] ^ odd[0] == 0).all()


def test_repeats_nulls_and_empty_table(docs):
    t = " ".join(f"w{i}" for i in range(30))
    got = [tuple(r)[2:] for r in near_groups(docs([(5, t), (5, t), (None, t), (7, t), (9, None)])).orderBy("doc_id").collect()]
    assert got == [(None, True), (5, True), (5, True), (5, False), (9, True)]
    assert near_groups(docs([])).count() == 0
    kept = drop_near_copies(docs([(5, t), (None, t), (7, t), (9, None)]))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 5, 9] and "_id" in kept.columns
    own = " ".join(f"o{i}" for i in range(30))
    kept = drop_near_copies(docs([(5, t), (5, own), (3, t + " more"), (9, None)]))
    assert len({r["text"] for r in kept.collect()}) == 3 and own in {r["text"] for r in kept.collect()}


def test_words_that_share_a_polynomial_hash_are_not_linked(docs):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2**64 whatever the constants."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    got = near_groups(docs([(1, word), (2, other), (3, f"{word} {other} x"), (4, f"{other} {word} x")])).collect()
    assert all(r["kept"] for r in got)


def test_a_family_melts_into_few_components_before_all_pairs(spark, docs, monkeypatch):
    """Members that each differ from a missing base: what the rounds leave for the exact filter grows less than their square."""
    from attesta.llm import near_dedup
    seen = []
    plain = near_dedup.possible_pairs

    def counted(crowd, sets, percent):
        out = plain(crowd, sets, percent)
        seen.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "possible_pairs", counted)
    monkeypatch.setattr(near_dedup, "TURNS", 3)  # one round, as by default, leaves more to the exact filter
    for n in (60, 240):
        rng = random.Random(n)
        base = [f"w{i}" for i in range(140)]
        rows = []
        for i in range(n):
            w = list(base)
            for at in rng.sample(range(140), rng.randint(1, 5)):
                w[at] = f"x{i}y{at}"
            rows.append((i, " ".join(w)))
        got = [tuple(r) for r in near_groups(docs(rows), size=3, percent=85).collect()]
        assert sorted(got) == brute(rows, 3, 85)
    assert seen[1] <= 8 * max(seen[0], 50)


def test_few_rows_leave_few_files(spark):
    """Every partition of every step leaves files; few rows in many partitions must not fill the disk."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 20}x{j}" for j in range(30)) + f" end{i}") for i in range(60)], "doc_id long, text string")
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    steps = []
    cut = near_dedup.cut
    near_dedup.cut = lambda df: steps.append(cut(df)) or steps[-1]
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs).collect()}
    finally:
        near_dedup.cut = cut
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i % 20 for i in range(60)}
    assert max(df.rdd.getNumPartitions() for df in steps) <= max(spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
