import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from attesta.functions.digests import md5_heads
from attesta.plans import stand_ins


def test_md5_of_spans():
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in [*range(70), 200]]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    got = md5_heads(data, ends - [len(p) for p in parts], ends)
    assert [int(x).to_bytes(4, "little") for x in got] == [hashlib.md5(p).digest()[:4] for p in parts]
    assert not len(md5_heads(data[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)))


def counts(text):
    w, v = (text or "").lower().encode().split(), [0] * 64
    for three in zip(w, w[1:], w[2:]):
        h = hashlib.md5(b" ".join(three)).hexdigest()
        v[int(h[:2], 16) % 64] += 1 if h[2] < "8" else -1
    return v


def test_vectors_of_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stand_ins, "SLICE", 100)
    rng = random.Random(2)
    texts = [None, "", "  ", "a b", "a b c", " A\tb \n c\x0bÉté\x1cx   y", "x" * 80 + " y z w"]
    texts += [" ".join(rng.choice(["Über", "in", "the", "w" * rng.randrange(1, 40)]) for _ in range(rng.randrange(60))) for _ in range(30)]
    rows = [(i, "en" if i % 2 else None, t) for i, t in enumerate(texts)] + [(4, None, "d e f g"), (None, "en", "p q r s"), (4, "en", "p q r s")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, lang, t in rows:
        want[i, lang] = [a + b for a, b in zip(want.get((i, lang), [0] * 64), counts(t))]
    made = stand_ins.document_vectors(spark, str(tmp_path))
    assert dict(made.dtypes)["v"] == "array<double>" and "md5(" not in made._jdf.queryExecution().executedPlan().toString()
    got = made.collect()
    assert {(r["doc_id"], r["lang"]): r["v"] for r in got} == {k: v for k, v in want.items() if any(v)} and len(got) == sum(map(any, want.values()))
    part = pa.array(["a", "b c d e", "f g h i", None]).slice(1, 3)
    assert stand_ins.shingle_counts(part).to_pylist() == [counts("b c d e"), counts("f g h i"), counts("")]
