"""Porter's stemmer on a word list, and METEOR on worked cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from attesta.functions import stem as M

# word, stem: examples of the rules as published, irregular words and edge cases
WORDS = """caresses caress|ponies poni|ties tie|caress caress|cats cat|feed feed|agreed agre|plastered plaster|bled bled|motoring motor|sing sing
conflated conflat|troubled troubl|sized size|hopping hop|tanned tan|falling fall|hissing hiss|fizzed fizz|failing fail|filing file|happy happi|sky sky
relational relat|conditional condit|rational ration|valenci valenc|hesitanci hesit|digitizer digit|conformabli conform|radicalli radic|differentli differ
vileli vile|analogousli analog|vietnamization vietnam|predication predic|operator oper|feudalism feudal|decisiveness decis|hopefulness hope
callousness callous|formaliti formal|sensitiviti sensit|sensibiliti sensibl|triplicate triplic|formative form|formalize formal|electriciti electr
electrical electr|hopeful hope|goodness good|revival reviv|allowance allow|inference infer|airliner airlin|gyroscopic gyroscop|adjustable adjust
defensible defens|irritant irrit|replacement replac|adjustment adjust|dependent depend|adoption adopt|homologou homolog|communism commun|activate activ
angulariti angular|homologous homolog|effective effect|bowdlerize bowdler|probate probat|rate rate|cease ceas|controll control|roll roll
dying die|news news|innings inning|proceed proceed|is is|by by|died die|flies fli|conditionally condit|nationally nation|biology biolog|hopefully hope
enjoy enjoy|saying say|employed employ|sayyid sayyid|1,200mg 1,200mg|été été|generalizations gener|oscillators oscil|crying cri|owed owe|using use"""
PAIRS = [p.split() for line in WORDS.split("\n") for p in line.split("|")]


def test_stems_of_columns(spark):
    got = spark.createDataFrame([([w for w, _ in PAIRS],)], ["w"]).select(M.stems(F.col("w"))).collect()[0][0]
    assert list(zip((w for w, _ in PAIRS), got)) == [tuple(p) for p in PAIRS]


def test_stems_of_sql():
    words = "[" + ", ".join(f"'{w}'" for w, _ in PAIRS) + "]"
    assert duckdb.sql(f"select {M.stems_sql(words)}").fetchall()[0][0] == [s for _, s in PAIRS]


def plain(hyp, ref, stem):
    """METEOR by popping the last equal words of two lists, as its definition says."""
    h, r = list(enumerate(hyp)), list(enumerate(ref))
    pairs = []
    for key in (lambda w: w, stem):
        for i in range(len(h) - 1, -1, -1):
            for j in range(len(r) - 1, -1, -1):
                if key(h[i][1]) == key(r[j][1]):
                    pairs.append((h.pop(i)[0], r.pop(j)[0]))
                    break
    if not pairs:
        return 0.0
    pairs.sort()
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(pairs, pairs[1:]))
    p, q = len(pairs) / len(hyp), len(pairs) / len(ref)
    return (1 - 0.5 * (chunks / len(pairs)) ** 3) * p * q / (0.9 * p + 0.1 * q)


@pytest.mark.parametrize("hyp, ref", [
    ("the cat sat on the mat", "the cat sat on the mat"), ("on the mat sat the cat", "the cat sat on the mat"),
    ("cats sitting", "the cat sits"), ("a b a b a", "b a b"), ("running runs run", "run running"), ("", "x y"), ("x", ""), ("q", "z")])
def test_meteor(spark, hyp, ref):
    known = dict(PAIRS) | {"cats": "cat", "sitting": "sit", "sits": "sit", "running": "run", "runs": "run"}
    got = spark.createDataFrame([(hyp.split(), ref.split())], "h array<string>, r array<string>").select(M.meteor(F.col("h"), F.col("r"))).collect()[0][0]
    assert got == pytest.approx(plain(hyp.split(), ref.split(), lambda w: known.get(w, w)), abs=1e-12)


def test_rouge_tokens(spark):
    got = spark.createDataFrame([("The CATS' running, was 120 ponies",)], ["t"]).select(M.rouge_tokens(F.col("t"))).collect()[0][0]
    assert got == ["the", "cat", "run", "was", "120", "poni"]
