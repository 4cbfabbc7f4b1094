"""Token counts: texts are encoded in Arrow batches and only the lengths come back.

A batch for the tokenizer holds about ``batch_bytes``, whatever the number of
texts: long texts are cut into pieces and short ones are put together. A cut is
made only before a single space between two letters or digits. The byte-level
pre-tokenizer always starts a word at such a space, and no special token holds
one, so that the pieces' lengths add up to the whole text's.

Nulls count as empty texts, empty texts have no token, texts of any length are
counted whole, repeated rows each; there are no ties to settle; other columns of
the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, small_batches

SAFE = re.compile(r"[^\W_] (?=[^\W_])")


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(text: str, size: int) -> Iterator[str]:
    """``text`` cut at safe boundaries into pieces of at least ``size`` characters."""
    start = 0
    while len(text) - start > size and (cut := SAFE.search(text, start + size)):
        yield text[start : cut.start() + 1]
        start = cut.start() + 1
    yield text[start:]


def lengths(texts: list[str], path: str, batch_bytes: int, piece_chars: int) -> list[int]:
    """The number of tokens of each text."""
    encode = _tokenizer(path).encode_batch_fast
    counts, batch, owners, held = [0] * len(texts), [], [], 0

    def flush() -> None:
        for k, encoded in zip(owners, encode(batch, add_special_tokens=False), strict=True):
            counts[k] += len(encoded)
        batch.clear()
        owners.clear()

    for k, text in enumerate(texts):
        for piece in pieces(text, piece_chars):
            batch.append(piece)
            owners.append(k)
            held += len(piece) if piece.isascii() else len(piece.encode("utf-8", "replace"))
            if held >= batch_bytes:
                flush()
                held = 0
    flush()
    return counts


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20, piece_chars: int = 1 << 16
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text; ``tokenizer`` is the path of a tokenizers file."""
    small_batches(docs.sparkSession)
    os_env = {"TOKENIZERS_PARALLELISM": "false"}  # Spark has a task for each core

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.update(os_env)
        for b in batches:
            found = lengths([x or "" for x in b.column(1).to_pylist()], tokenizer, batch_bytes, piece_chars)
            yield pa.record_batch({id_col: b.column(0), "n_bytes": b.column(2), "n_tokens": pa.array(found, pa.int64())})

    rows = columns(docs, id_col, text_col).withColumn("n_bytes", F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long"))
    counted = rows.mapInArrow(count, f"`{id_col}` {dict(rows.dtypes)[id_col]}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
