import random
from collections import Counter

import numpy as np
import pytest

from attesta.llm.mixing import mix_digest, mix_texts, permuted, share_out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], "doc_id long, text string, source string, sid string, start int").repartition(4)


def rows(seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(400):
        s = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "é", None])
        out.append((i, " ".join(f"{i}w{j}" for j in range(rng.choice([0, 1, 7, 60, 300]))), s))
    return out + [(400, None, "a"), (401, "  \n", "zero"), (402, " ".join(f"402w{j}" for j in range(20_000)), "b"), (403, "one", "tiny")]


def want_targets(data):
    sizes = Counter()
    for _, t, s in data:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    return {s: (sizes[s], t) for s, t in zip(order, share_out([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 3))}


def test_targets_and_taken(spark):
    data = rows()
    got = mix_digest(frame(spark, data), block=16).collect()
    again = mix_digest(frame(spark, data[::-1]).repartition(7), block=16).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr) and len(got) == len(data)
    want, taken = want_targets(data), Counter()
    for r in got:
        assert (r["source_size"], pytest.approx(r["target"])) == want[r["source"]]
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, (size, target) in want.items():
        assert abs(taken[s] - target) <= max(0.02 * target, 2 * 16)
    assert {r["doc_id"]: r["size"] for r in got} == {i: len((t or "").split()) for i, t, _ in data}


def test_texts_agree_with_digest(spark):
    data = [r for r in rows(2) if r[1]]
    df = frame(spark, data)
    taken = Counter(w.split("w")[0] for r in mix_texts(df, block=16, per_shard=64).collect() for w in r["text"].split())
    assert {str(r["doc_id"]): r["taken"] for r in mix_digest(df, block=16, per_shard=64).collect() if r["taken"] and r["doc_id"] != 403} == \
        {k: v for k, v in taken.items() if k != "one"}


def test_share_out():
    assert share_out([100, 100, 100], [5, 2, 1], 3) == [187.5, 75, 37.5]
    assert share_out([10, 100], [5, 2], 3) == [30, 80]
    assert share_out([1, 1000, 0], [5, 2, 1], 3) == [3, 998, 0]
    assert share_out([], [], 3) == []


def test_permutation():
    for n in (1, 2, 3, 100, 1000):
        for key in (1, 2):
            got = permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(got) == list(range(n))


def test_no_words_repeated_rows_and_empty_table(spark):
    got = mix_digest(frame(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2
    assert mix_digest(frame(spark, [])).count() == 0
    twins = mix_digest(frame(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")]), block=1).collect()
    assert sorted((r["size"], r["taken"]) for r in twins) == [(1, 1), (2, 2), (2, 2)]
