"""SimHash fingerprints and anchor covering against brute force."""

import re

import numpy as np
import xxhash

from attesta.llm import simhash


def print_of(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    values = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute(rows):
    prints = [print_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, f"{prints[i]:016x}", least.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def answer(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def family(rng, n, base=400):
    vocabulary = [f"w{i}é" for i in range(300)]
    root = rng.choice(vocabulary, base)
    out = []
    for _ in range(n):
        words = root.copy()
        words[rng.integers(0, base)] = rng.choice(vocabulary)
        out.append(" ".join(words))
    return out


def test_against_brute_force(docs):
    rng = np.random.default_rng(3)
    texts = [None, "", " \t\n", "One", "one", "a b", "A  b", "x y z", "x y z x y z", "q" * 200_000, "Ünï çode here"] + family(rng, 25) + family(rng, 15, 60)
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)] + [(None, "one"), (None, "all alone here"), (3, "one"), (3, "two words")]
    assert answer(simhash.simhash_groups(docs(rows))) == brute(rows)


def test_tiles_give_the_same(docs):
    rng = np.random.default_rng(4)
    rows = list(enumerate(family(rng, 60)))
    assert answer(simhash.simhash_groups(docs(rows), tile=4)) == brute(rows)


def test_empty_table(docs):
    assert simhash.simhash_groups(docs([])).collect() == []


def test_drop_keeps_one(docs):
    rows = [(5, "a b c d"), (2, "a b c d"), (9, "other words are here"), (None, "a b c d")]
    assert sorted(r[0] or 0 for r in simhash.drop_near_copies(docs(rows)).collect()) == [0, 2, 9]


def test_covering_loses_no_pair():
    """Any two words within one bit meet at an anchor, and all anchors are within two bits."""
    rng = np.random.default_rng(5)
    words = rng.integers(0, 2**32, 2000, dtype=np.uint32)
    words[:4] = [0, 2**32 - 1, 2**31, 1]
    mine = {}
    for i, a in zip(*simhash.anchors(words)):
        mine.setdefault(int(i), set()).add(int(a))
        assert (int(a) ^ int(words[i])).bit_count() <= 2
    for bit in range(32):
        who, at = simhash.anchors(words ^ np.uint32(1 << bit))
        met = {int(i) for i, a in zip(who, at) if int(a) in mine[int(i)]}
        assert met == set(range(len(words)))


def test_forest_equals_all_pairs():
    rng = np.random.default_rng(6)
    group = np.sort(rng.integers(0, 8, 120))
    fp = np.array([1 << int(rng.integers(0, 12)) | 1 << int(rng.integers(0, 12)) for _ in group], np.uint64)
    a, b = simhash.forest(group, fp, 1)
    roots = {}

    def find(x):
        while roots.setdefault(x, x) != x:
            x = roots[x]
        return x
    for x, y in zip(a.tolist(), b.tolist()):
        roots[find(x)] = find(y)
    for i in range(len(group)):
        for j in range(i):
            if group[i] == group[j] and (int(fp[i]) ^ int(fp[j])).bit_count() <= 1:
                assert find(int(fp[i])) == find(int(fp[j]))


def test_long_rows_are_counted_in_steps():
    text = b"some words that go on " * 50 + b"end"
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    assert simhash.fingerprint_rows(data, offsets, 3, 7) == simhash.fingerprint_rows(data, offsets, 3) == print_of(text.decode())
