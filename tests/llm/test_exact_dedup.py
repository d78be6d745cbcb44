import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm.exact_dedup import drop_copies, exact_groups, rice_decode, rice_encode


@settings(deadline=None, max_examples=60)
@given(st.sets(st.integers(0, 2**48 - 1), max_size=200), st.integers(30, 45))
def test_rice_round_trip(values, k):
    v = np.array(sorted(values), np.int64)
    assert (rice_decode(rice_encode(v, k), len(v), k) == v).all()


def test_rice_small_parameters():
    for k in (0, 1, 5):
        v = np.array([0, 1, 2, 9, 40, 1000])
        assert (rice_decode(rice_encode(v, k), len(v), k) == v).all()


def brute(rows):
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in by[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(by[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "a b"), (2, "a b"), (3, "A b"), (4, None), (5, ""), (6, "é" * 50_000), (7, "é" * 50_000), (8, "alone"), (None, "a b"),
        (None, "lost"), (9, " a b"), (10, "x"), (10, "x")] + [(100 + i, "hot") for i in range(50)]


def test_matches_brute_force_with_many_owners(docs):
    for per_owner in (1 << 20, 5):
        got = [tuple(r) for r in exact_groups(docs(ROWS), per_owner=per_owner).collect()]
        assert sorted(got, key=repr) == brute(ROWS)


def test_empty_table(docs):
    assert exact_groups(docs([])).count() == 0


def test_drop_copies_keeps_columns(docs):
    df = docs(ROWS)
    kept = drop_copies(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [2, 3, 5, 7, 8, 9, 10, 149]  # 10 is there twice, once stays
    assert [r["text"] for r in kept.filter("doc_id is null").collect()] == ["lost"]


def test_an_id_with_two_texts_loses_only_the_copy(docs):
    kept = drop_copies(docs([(1, "a copy"), (1, "a text of its own"), (2, "a copy"), (None, "x"), (None, "x")]))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == [(1, "a text of its own"), (2, "a copy"), (None, "x")]
    assert drop_copies(docs([])).count() == 0
