"""Numpy helpers for Arrow batches: columns as bytes, word boundaries, 64-bit word hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b" \t\n\v\f\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_powers = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, b in (("up", BASE), ("down", BASE_INVERSE)):
            run = np.full(size, b, np.uint64)
            run[0] = 1
            _powers[name] = np.cumprod(run, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and its row offsets (NULL is empty)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def small_batches(batches, text: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most_bytes`` of text, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes that are no ``gaps`` (words ``[^\\x20\\x09-\\x0D]+``); words never cross rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~gaps[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial over coded bytes, and the inverse powers that ``span_hashes`` needs."""
    up, down = powers(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[:-1], out=run[1:])
    return run, down


def span_hashes(rolled: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, mixed with its length."""
    run, down = rolled
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(rolling(data), starts, ends)


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct ``size``-word shingles, ordered by row and hash.

    A row with fewer words has its whole sequence as one shingle; a row without
    words has none.
    """
    count = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(count) - count
    at = np.arange(len(words)) - first[rows]
    length = np.minimum(size, count)
    keep = at <= (count - length)[rows]
    pos, row = np.flatnonzero(keep), rows[keep]
    value = length[row].astype(np.uint64) * BASE
    for j in range(size):
        has = j < length[row]
        nxt = words[np.minimum(pos + j, len(words) - 1)] if len(words) else words
        value = np.where(has, mix(value * np.uint64(3) + nxt), value)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if len(row):
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        row, value = row[fresh], value[fresh]
    return row, value


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, separator: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The spans one after another, each followed by one separator byte, and where each begins."""
    lens = ends - starts
    first = np.cumsum(lens) - lens
    begin = first + np.arange(len(lens))
    out = np.full(int(lens.sum()) + len(lens), separator, np.uint8)
    each = np.arange(int(lens.sum()))
    out[each + np.repeat(begin - first, lens)] = data[each + np.repeat(starts - first, lens)]
    return out, begin


LONG_WORD = 1024
TAIL = np.array([2 ** (8 * n) - 1 for n in range(9)], np.uint64)


def span_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of the bytes of each span, eight at a time, every block mixed before the next.

    Unlike a polynomial modulo 2**64 it has no strings that collide whatever
    the constants are.  Spans above ``LONG_WORD`` bytes are digested one by one.
    """
    lens = ends - starts
    code = mix(lens.astype(np.uint64) * BASE + np.uint64(seed))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    on, at = np.flatnonzero((lens > 0) & (lens <= LONG_WORD)), 0
    while len(on):
        block = padded[(starts[on] + at)[:, None] + np.arange(8)].view(np.uint64).ravel() & TAIL[np.minimum(lens[on] - at, 8)]
        code[on] = mix((code[on] ^ block) * BASE + np.uint64(seed + 1))
        at += 8
        on = on[lens[on] > at]
    for i in np.flatnonzero(lens > LONG_WORD):
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8, key=str(seed).encode()).digest()
        code[i] = np.frombuffer(digest, np.uint64)[0]
    return code


def sliced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """String column of spans that may overlap; the bytes are valid UTF-8 between them."""
    lens = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lens)])
    picked = data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lens)]
    return pa.LargeStringArray.from_buffers(len(lens), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(picked)).cast(pa.string())
