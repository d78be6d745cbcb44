import random
import re

import numpy as np
import pytest

from attesta.llm.license_scan import aligned, scan, winnowed
from attesta.llm.license_texts import TEMPLATES


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("name", list(TEMPLATES))
def test_finds_each_template_and_its_span(docs, name):
    text = "Überall nothing of note.\n" + TEMPLATES[name].replace("\n", "  ").upper() + "\nfurther words follow"
    got = scan(docs([(3, text)])).collect()
    assert [(r["license"], r["coverage"]) for r in got] == [(name, 1.0)]
    assert words(text[got[0]["start"]:got[0]["end"]]) == words(TEMPLATES[name].upper())


def test_edited_templates_against_full_alignment(docs):
    rng = random.Random(4)
    rows, want = [], {}
    names = ["MIT", "Apache-2.0", "ISC", "MPL-2.0"]
    for i in range(24):
        name = names[i % 4]
        w = words(TEMPLATES[name])
        for _ in range(int(len(w) * (i % 6) * 0.02)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, "before this " + " ".join(w) + " after that"))
        share = longest_common(words(TEMPLATES[name]), words(rows[-1][1])) / len(words(TEMPLATES[name]))
        if share >= 0.8:
            want[i, name] = share
    got = {(r["doc_id"], r["license"]): r["coverage"] for r in scan(docs(rows)).collect()}
    assert {k: got.get(k) for k in want} == want and set(got) == set(want)


def test_edges(docs):
    line = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, "the mit"), (None, line), (5, line), (5, line), (6, ("x " * 50_000) + line + " and " + line), (7, "Released under the MIT"), (8, line * 2)]
    got = [tuple(r)[:2] for r in scan(docs(rows)).collect()]
    assert sorted(got, key=repr) == sorted([(None, "MIT line")] + [(5, "MIT line")] * 2 + [(6, "MIT line")] * 2 + [(7, "MIT line")] + [(8, "MIT line")] * 2, key=repr)
    assert scan(docs([])).count() == 0


def test_winnowing_keeps_one_of_every_window():
    grams = np.random.default_rng(2).integers(0, 50, 200).astype(np.uint64)
    kept = set(winnowed(grams, 4).tolist())
    assert all(kept & set(range(i, i + 4)) for i in range(197)) and len(winnowed(grams[:0], 4)) == 0


def test_alignment():
    assert aligned([1, 2, 3, 4], [9, 1, 2, 8, 4, 9], 1, 2) == (3, 1, 4)
    assert aligned([1, 2], [], 0, 1) == (0, -1, -1)


RELATIVES = {
    "Licensed under CC BY 4.0.": "CC-BY-4.0 short line", "Licensed under a CC-BY-SA 4.0 licence": "CC-BY-SA-4.0 line", "Licensed under CC BY-NC-ND 4.0": "CC-BY-NC-ND-4.0 line",
    "Licensed under CC BY-NC 3.0.": "CC-BY-NC-3.0 line", "Licensed under CC BY-NC 2.5.": None, "Licensed under CC BY 2.0.": None,
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0 line", "This work is licensed under the GNU General Public License, version 1.": None,
    "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0 line", "This work is licensed under the GNU Lesser General Public License, version 2.1": "LGPL-2.1 line",
    "This work is licensed under the GNU Lesser General Public License, version 2.": None, "Released under the BSD License.": None, "Licensed under the Apache License, Version 1.1.": None,
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "CC-BY-NC-SA-4.0 sentence",
    "This work is licensed under the GNU General Public License, version 3.0.": "GPL-3.0 line",
    TEMPLATES["GPL-3.0"].replace("version 3", "version 4"): None, TEMPLATES["GPL-3.0"].replace("GNU General", "GNU Affero General"): "AGPL-3.0",
}


def test_relatives_are_told_apart(docs):
    got = {}
    for r in scan(docs(list(enumerate("so it is. " + t + " Thanks" for t in RELATIVES)))).collect():
        got.setdefault(r["doc_id"], []).append(r["license"])
    assert {t: got.get(i) for i, t in enumerate(RELATIVES)} == {t: [n] if n else None for t, n in RELATIVES.items()}
