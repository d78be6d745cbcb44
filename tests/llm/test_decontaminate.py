import random

import numpy as np
import pytest

from attesta.llm.decontaminate import contaminated, drop_contaminated

ALPHABET = "abcdefghij éß"


def text(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def plain(t):
    out = "".join(c if c.isdigit() or c.isalpha() else " " for c in t.lower() if True)
    return " ".join(out.split()).encode()


def best(pattern, data):
    """Least edits of the pattern in any part of the data (full table)."""
    row = np.zeros(len(data) + 1, int)
    for c in pattern:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        for j in range(1, len(row)):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (data[j - 1] != c))
        row = new
    return row.min()


def edited(rng, t, n):
    t = list(t)
    for _ in range(n):
        i, how = rng.randrange(len(t)), rng.random()
        if how < 0.34:
            t[i] = rng.choice("xyz")
        elif how < 0.67:
            del t[i]
        else:
            t.insert(i, rng.choice("xyz"))
    return "".join(t)


def test_equals_full_alignment_for_whole_items(spark, docs):
    rng = random.Random(5)
    items = [(k, text(rng, n)) for k, n in enumerate((30, 60, 90, 118))]
    rows = []
    for i in range(24):
        _, t = items[i % 4]
        rows.append((i, text(rng, 150) + " . " + edited(rng, t, rng.randrange(0, 8)).upper().replace("SS", "ß") + "\n" + text(rng, rng.choice([0, 90]))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs(rows), bench).collect()}
    want = set()
    for i, t in rows:
        for k, item in items:
            p = plain(item)
            e = min(int(len(p) * 0.05), max(0, (len(p) - 12) // 12))
            if best(p, plain(t)) <= e:
                want.add((i, k))
    assert got == want and len(want) > 6


def test_spans_parts_and_edges(spark, docs):
    rng = random.Random(6)
    item = text(rng, 400)
    bench = spark.createDataFrame([(7, item), (8, "short"), (9, None), (10, "")], "item_id long, text string")
    rows = [(1, "Überall " + item + " end"), (2, "x" + item[100:300]), (3, item[:80]), (4, None), (5, ""), (None, item), (6, text(rng, 60_000) + item), (11, "short")]
    got = {r["doc_id"]: r for r in contaminated(docs(rows), bench).collect()}
    assert set(got) == {1, 2, None, 6}
    assert abs(got[1]["start"] - 8) <= 1 and abs(got[1]["end"] - 8 - len(item)) <= 1 and got[1]["edits"] == 0
    assert abs(got[6]["start"] - 60_000) <= 1
    clean = drop_contaminated(docs(rows), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 5, 11] and clean.columns == docs(rows).columns


@pytest.mark.parametrize("most_bytes", [1 << 24, 300])
def test_slices_change_nothing(spark, docs, most_bytes):
    rng = random.Random(7)
    items = [(k, text(rng, 150)) for k in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, text(rng, 50) + items[i % 6][1]) for i in range(12)] + [(20, text(rng, 300))]
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs(rows), bench, most_bytes=most_bytes).collect()}
    assert got == {(i, i % 6) for i in range(12)}


def test_empty_tables(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(docs([(1, "a")]), bench).count() == 0 and drop_contaminated(docs([(1, "a")]), bench).count() == 1
    bench = spark.createDataFrame([(1, "some text that is long enough")], "item_id long, text string")
    assert contaminated(docs([]), bench).count() == 0


def test_every_run_of_thirteen_words_is_found(spark, docs):
    rng = random.Random(8)

    def prose(n, most=10):
        return ["".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(1, most))) for _ in range(n)]

    items = [(k, prose(rng.randint(14, 60), rng.choice([3, 6, 10]))) for k in range(30)]
    rows = []
    for i in range(300):
        k, w = items[i % 30]
        n = rng.randint(13, min(len(w), 20))
        a = rng.randint(0, len(w) - n)
        rows.append((i, " ".join(prose(30) + [x.upper() for x in w[a:a + n]]) + ",\n" + " ".join(prose(rng.choice([0, 30])))))
    solid = "".join(rng.choice("漢字仮名交文日本語大小") for _ in range(120))  # no white space: 27 of these are 81 bytes
    rows += [(1000 + i, " ".join(prose(5)) + solid[a:a + 27] + "z") for i, a in enumerate(rng.randint(0, 93) for _ in range(20))]
    clean = [(2000 + i, " ".join(prose(40) + items[i][1][1:6] + prose(40))) for i in range(8)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(99, solid)], "item_id long, text string")
    want = {(i, i % 30) for i in range(300)} | {(1000 + i, 99) for i in range(20)}
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(docs(rows + clean), bench, words=13).collect()} == want
    assert {r["doc_id"] for r in drop_contaminated(docs(rows + clean), bench, words=13).collect()} == {i for i, _ in clean}


def test_a_changed_pair_of_words_leaves_the_runs_beside_it(spark, docs):
    rng = random.Random(9)
    w = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(30)]
    bench = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    row = (5, "before " + " ".join([*w[:14], "other", "things", *w[16:]]) + " after")
    got = contaminated(docs([row]), bench, words=13).collect()
    assert [r["item_id"] for r in got] and min(r["start"] for r in got) == 7 and max(r["end"] for r in got) == len(row[1]) - 6
    typo = (6, "before " + " ".join([*w[:5], "x" + w[5][1:], *w[6:13]]) + " after")
    assert [1 <= r["edits"] <= 3 for r in contaminated(docs([typo]), bench, words=13).collect()] == [True]
