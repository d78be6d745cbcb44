"""Token counts: lengths of tokenizer encodings, in batches balanced by bytes.

Only lengths leave the tasks.  Long texts are split where no token can cross:
before a single space between two characters that are not white space, which a
byte-level pre-tokenizer always puts at the head of the next piece.  A text
without such a place stays whole.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import small_batches

#: A space that always starts a piece: exactly one, between two characters that aren't white space.
SAFE = re.compile(r"(?<=\S) (?=\S)")
BATCH_BYTES = 4 << 20
_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per Python worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _loaded[path] = found
    return _loaded[path]


def safe_pieces(text: str, most_chars: int) -> list[str]:
    """Pieces of about ``most_chars``, cut at safe places only; together they are the text."""
    pieces, first = [], 0
    while len(text) - first > most_chars:
        found = SAFE.search(text, first + most_chars)
        if not found:
            break
        pieces.append(text[first:found.start()])
        first = found.start()
    pieces.append(text[first:])
    return pieces


def balanced(pieces: list[tuple[int, str]], most_bytes: int):
    """Runs of (row, piece) with about equal bytes."""
    run, size = [], 0
    for row, piece in pieces:
        run.append((row, piece))
        size += len(piece.encode())
        if size >= most_bytes:
            yield run
            run, size = [], 0
    if run:
        yield run


def lengths(texts: list[str | None], path: str, most_chars: int, most_bytes: int) -> list[int]:
    tok = tokenizer(path)
    total = [0] * len(texts)
    pieces = [(i, p) for i, t in enumerate(texts) if t for p in safe_pieces(t, most_chars)]
    for run in balanced(pieces, most_bytes):
        for (i, _), got in zip(run, tok.encode_batch_fast([p for _, p in run], add_special_tokens=False)):
            total[i] += len(got)
    return total


def count_tokens(docs: DataFrame, path: Column | str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024,
                 most_chars: int = 16_384, most_bytes: int = 262_144) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row per row of ``docs``.

    NULL and empty texts have no tokens.  Rows repeat as they do in ``docs``, a
    NULL id stays NULL, an empty table gives an empty one, other columns are not
    read.  Very long texts are split at safe boundaries only, so that their
    tokens stay the same.
    """
    def run(batches):
        for batch in small_batches(batches, "_text", BATCH_BYTES):
            counts = lengths(batch.column(2).to_pylist(), path, most_chars, most_bytes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())],
                                             names=[id_col, "n_bytes", "n_tokens"])

    given = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                        F.col(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return given.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
