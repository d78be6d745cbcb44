"""Licence scans: winnowed fingerprints in an inverted index, then banded sequence alignment.

Every template's word k-grams are winnowed: of each window of consecutive
k-gram hashes the smallest is kept.  A text looks up all of its k-grams, so any
run of window + k - 1 common words is seen.  Hits of one template on nearby
diagonals make a candidate, which a banded alignment of words turns into
matched coverage and a span.  The templates are a fixed, small dictionary; each
text is read once, where it lies, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import SEPARATOR, lower_bytes
from .license_texts import BEFORE_VERSION, LICENCE_NAMES, TELLING, TELLING_PAIRS, TEMPLATES
from .words import IS_SPACE, mix, small_batches, word_hashes, word_spans


def word_list(data: np.ndarray, offsets: np.ndarray):
    """Hash, first byte, end byte and row of all words: runs of letters, digits and bytes of other scripts."""
    flat = np.where(SEPARATOR[data] & ~IS_SPACE[data], np.uint8(32), data)
    starts, ends, row = word_spans(flat, offsets)
    return word_hashes(flat, starts, ends), starts, ends, row


NUMBER = re.compile(rb"v?([0-9]+)")
#: Templates of fewer words must meet each of their telling words.
SHORT = 40


def telling(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[Counter, Counter]:
    """Version numbers and variants that some words name (``4.0`` is 4, ``2.1`` is 2 and 1), and the names of licences."""
    words = [data[a:z].tobytes() for a, z in zip(starts.tolist(), ends.tolist())]
    kinds, names, version = Counter(), Counter(w for w in words if w in LICENCE_NAMES), False
    for i, w in enumerate(words):
        before = words[i - 1] if i else b""
        kind = TELLING.get(w) or TELLING_PAIRS.get((before, w))
        number = NUMBER.fullmatch(w)
        joined = bool(i) and version and dotted(data, starts, ends, i)
        version = bool(number) and (joined or before in BEFORE_VERSION)
        if version and not (joined and w == b"0"):
            kind = number[1].decode()
        if kind:
            kinds[kind] += 1
    return kinds, names


def dotted(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: int) -> bool:
    """Whether word ``i`` follows the one before after a full stop alone, as in 2.1."""
    return starts[i] == ends[i - 1] + 1 and data[ends[i - 1]] == 46


def kgrams(words: np.ndarray, k: int) -> np.ndarray:
    if len(words) < k:
        return np.zeros(0, np.uint64)
    value = np.full(len(words) - k + 1, 11, np.uint64)
    for j in range(k):
        value = mix(value * np.uint64(3) + words[j:len(words) - k + 1 + j])
    return value


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash (the last of equals) of every window."""
    if not len(grams):
        return np.zeros(0, np.int64)
    window = min(window, len(grams))
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(1))


class Index:
    """Inverted index from fingerprints to (template, position)."""

    def __init__(self, templates: dict[str, str], k: int, window: int):
        self.k, self.names, self.words = k, list(templates), []
        self.telling: list[tuple[Counter, Counter]] = []
        posting = []
        for t, text in enumerate(templates.values()):
            data, offsets = lower_bytes(pa.array([text], pa.large_string()))
            words, starts, ends, _ = word_list(data, offsets)
            grams = kgrams(words, k)
            self.telling.append(telling(data, starts, ends))
            self.words.append(words.tolist())
            # a short notice keeps every k-gram: one changed word may leave it only one
            posting += [(int(grams[p]), t, int(p)) for p in winnowed(grams, window if len(words) >= 8 * window else 1)]
        posting.sort()
        self.keys = np.array([p[0] for p in posting], np.uint64)
        self.template = np.array([p[1] for p in posting], np.int64)
        self.pos = np.array([p[2] for p in posting], np.int64)

    def same_licence(self, t: int, kinds: Counter, names: Counter) -> bool:
        """Whether a text with these telling words can be template ``t``: none is added; in a short template none is missing either."""
        if len(self.words[t]) < SHORT:
            return (kinds, names) == self.telling[t]
        return not self.telling[t][0] or not set(kinds) - set(self.telling[t][0])

    def hits(self, grams: np.ndarray):
        low, high = np.searchsorted(self.keys, grams), np.searchsorted(self.keys, grams, "right")
        place = np.flatnonzero(high > low)
        n = (high - low)[place]
        at = np.repeat(low[place], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(place, n), self.template[at], self.pos[at]


def aligned(template: list[int], text: list[int], shift: int, slack: int) -> tuple[int, int, int]:
    """Most template words met in order by the text, whose word i + d faces template word i, |d - shift| <= slack.

    Also the first and the last text word met.  The least skipped words win a tie.
    """
    none = (0, 0, -1, -1)  # met, minus skipped, first, last
    row = {}
    for i, w in enumerate(template):
        new, left = {}, none
        for j in range(max(0, i + shift - slack), min(len(text), i + shift + slack + 1)):
            best = max(row.get(j, none), left)
            if text[j] == w:
                met, skipped, first, last = row.get(j - 1, none)
                gap = j - last - 1 if met else 0
                best = max(best, (met + 1, skipped - gap, first if met else j, j))
            new[j] = left = best
        top = max(row) if row else -1
        row = new if new else {top: max(row.values(), default=none)} if row else {}
    met, _, first, last = max(row.values(), default=none)
    return met, first, last


def scan_rows(index: Index, data: np.ndarray, offsets: np.ndarray, least: float):
    """(row, template, coverage, matched words, first byte, end byte) of every accepted alignment."""
    words, starts, ends, row = word_list(data, offsets)
    place, template, pos = index.hits(kgrams(words, index.k))
    good = row[place] == row[np.minimum(place + index.k - 1, len(row) - 1)] if len(place) else np.zeros(0, bool)
    place, template, pos = place[good], template[good], pos[good]
    first = np.searchsorted(row, np.arange(len(offsets) - 1))
    last = np.searchsorted(row, np.arange(len(offsets) - 1), "right")
    order = np.lexsort((place - pos, template, row[place]))
    found, runs = [], []
    for r, t, d in zip(row[place[order]].tolist(), template[order].tolist(), (place - pos)[order].tolist()):
        slack = max(2, len(index.words[t]) // 8)
        if runs and runs[-1][:2] == [r, t] and d - runs[-1][3] <= slack and d - runs[-1][2] <= 2 * slack:
            runs[-1][3] = d
        else:
            runs.append([r, t, d, d])
    for r, t, low, high in runs:
        slack = max(2, len(index.words[t]) // 8)
        a = max(int(first[r]), low - slack)
        z = min(int(last[r]), high + len(index.words[t]) + slack)
        met, f, e = aligned(index.words[t], words[a:z].tolist(), (low + high) // 2 - a, slack + (high - low + 1) // 2)
        if met < least * len(index.words[t]):
            continue
        z = a + e + 1
        while z < last[r] and words_of_digits(data, starts, ends, z) and dotted(data, starts, ends, z):
            z += 1  # the rest of a version number
        if index.same_licence(t, *telling(data, starts[a + f:z], ends[a + f:z])):
            found.append((r, t, met / len(index.words[t]), met, int(starts[a + f]), int(ends[a + e])))
    return strongest(found)


def words_of_digits(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: int) -> bool:
    return NUMBER.fullmatch(data[starts[i]:ends[i]].tobytes()) is not None


def strongest(found: list[tuple]) -> list[tuple]:
    """Of overlapping matches in a row the one with the most matched words stays, then the better covered, then the first name."""
    kept: list[tuple] = []
    for x in sorted(found, key=lambda x: (x[0], -x[3], -x[2], x[4], x[1])):
        if not any(x[0] == y[0] and x[4] < y[5] and y[4] < x[5] for y in reversed(kept) if y[0] == x[0]):
            kept.append(x)
    return sorted(kept, key=lambda x: (x[0], x[4]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", k: int = 3,
         window: int = 3, least: float = 0.8) -> DataFrame:
    """(id, license, coverage, matched_words, start, end), one row per licence text found.

    Words are runs of letters and digits in lower case.  ``coverage`` is the
    share of the template's words that the text meets in order; from ``least``
    on it is a match, unless the words that tell relatives apart (version, NC, SA,
    ND, Lesser, Affero) differ: none may be added, and a template of fewer than
    ``SHORT`` words must meet all of them and its licence's name.  ``start`` and ``end`` count characters of the text.
    Overlapping matches leave the one with the most words.  NULL and empty
    texts have none; repeated rows are reported again; other columns aren't read.
    """
    index = Index(templates or TEMPLATES, k, window)
    names = index.names

    def run(batches):
        for batch in small_batches(batches, "_text"):
            data, offsets = lower_bytes(batch.column(1))
            rows = scan_rows(index, data, offsets, least)
            if rows:
                chars = [(int(((data[offsets[r]:a] & 0xC0) != 0x80).sum()), int(((data[offsets[r]:z] & 0xC0) != 0x80).sum())) for r, _, _, _, a, z in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([x[0] for x in rows])), pa.array([names[x[1]] for x in rows]), pa.array([x[2] for x in rows]),
                     pa.array([x[3] for x in rows], pa.int64()), pa.array([c[0] for c in chars], pa.int64()), pa.array([c[1] for c in chars], pa.int64())],
                    names=[id_col, "license", "coverage", "matched_words", "start", "end"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind}, license string, coverage double, matched_words long, start long, end long")
