"""The radix tree, and the trie of conversations against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from attesta.llm import prefix_trie as P
from attesta.llm.radix import Node, insert, preorder

SCHEMA = "conv_id long, turn long, role string, text string, lo long, chunk string"


def brute(rows, rebuild=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            convs[c].append(((turn is not None, turn or 0, role, digest), (role, text)))
    convs = {c: [t for _, t in sorted(ts)] for c, ts in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = convs.get(c - int(c - 100 * int(c / 100)), [])
        whole[c] = base[:h] + own[h:] if rebuild else own
    members = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        parts = [below(k) for k in kids[p]]
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        return sum(x for x, _ in parts) + (not parts), sum(y for _, y in parts) + own

    out = set()
    for p, cs in members.items():
        leaves, saved = below(p)
        ends = ",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(p))
        out.add((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(spark, rows, rebuild=True, **options):
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA).repartition(3)
    seqs = P.sequences(df)
    got = P.prefix_trie(P.rebuilt(seqs) if rebuild else seqs, **options).select(*COLUMNS).collect()
    assert len(set(got)) == len(got)
    return {tuple(r) for r in got}


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 420), n):
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["", None, "hé", "b" * 9, "some words"]))
                 for t in range(rng.choice([1, 2, 3, 3, 4, 8]))]
    return rows


@pytest.mark.parametrize("chunk_bytes", [1, 400, 1 << 20])
def test_against_brute_force(spark, chunk_bytes):
    rows = made(1, 120) + [(None, 1, "user", "lost"), (-7, 0, "user", "minus"), (-7, 0, "user", "minus")]
    rows += [(500 + i, 0, "user", "same") for i in range(60)] + [(700, t, "user", f"turn {t % 3}") for t in range(40)] + [(701, t, "user", f"turn {t % 3}") for t in range(30)]
    assert trie(spark, rows, chunk_bytes=chunk_bytes) == brute(rows)


def test_any_sequences(spark):
    rows = made(2, 60)
    assert trie(spark, rows, rebuild=False, chunk_bytes=300) == brute(rows, rebuild=False)


def test_a_conversation_without_turns_is_in_the_root(spark):
    rows = [(i, 0, "user", "only") for i in range(1, 30)]  # most have fewer turns than they give up, and no first conversation
    assert trie(spark, rows) == brute(rows)


def test_packs_of_copies(spark, monkeypatch):
    monkeypatch.setattr(P, "PACK_BYTES", 10)
    rows = [(i, t, "user", f"same {t}") for i in range(80) for t in range(2)]
    assert trie(spark, rows, rebuild=False) == brute(rows, rebuild=False)


def test_empty_table(spark):
    assert trie(spark, []) == set()


def test_texts_of_nodes(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, None, None), (2, 0, "user", "hello")]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA)
    nodes = P.with_turns(P.prefix_trie(P.sequences(df)), df)
    assert {(r["depth"], r["role"], r["text"]) for r in nodes.collect()} == {(0, None, None), (1, "user", "hello"), (2, "", "")}


@pytest.mark.parametrize("width", [2, 4, 5, 16, 17, 48, 49, 256])
def test_radix_layouts(width):
    keys = [bytes([b]) + b"tail" * (b % 3) for b in range(width)] + [b"\x00tailing", b"", b"\x01" * 50]
    random.Random(width).shuffle(keys)
    root = Node()
    for k in keys:
        insert(root, k, k)
    found = [n.value for n, _, _ in preorder(root) if n.value is not None]
    assert found == sorted(set(keys))
    assert root.kind == (4 if width <= 4 else 16 if width <= 16 else 48 if width <= 48 else 256)
