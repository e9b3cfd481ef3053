"""Packing by power-of-two decomposition.

A document of n tokens is cut into full windows and then into the powers of two of
what is left, longest first. Each piece is a sequence of its own, so that none
crosses documents and none needs padding; equal lengths form a bucket.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Remembered, byte_level
from .common import map_batches, texts

SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary"


def lengths(n: int, window: int) -> list[int]:
    """Full windows, then the binary digits of the rest."""
    rest = n % window
    return [window] * (n // window) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def encoder(source: str):
    """text -> its ids as little-endian unsigned 32-bit integers."""
    tok = byte_level(source)

    def encode(chunk: str) -> bytes:
        if chunk in tok.special:
            return np.array([tok.special[chunk]], "<u4").tobytes()
        return np.array([i for p in tok.pieces(chunk) for i in tok.merge(p)], "<u4").tobytes()

    memo = Remembered(encode)
    return lambda text: b"".join([memo[c] for c in tok.chunks(text)])


_encoders: dict = {}


def pack(docs: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of every document: ``doc_id, start, length, doc_tokens, ids, bucket, sequence_id, offset``.

    docs: has ``doc_id`` and ``text``; other columns are not read. ``ids`` holds
    little-endian unsigned 32-bit ids, ``bucket`` is log2 of the length, ``window``
    must be a power of two. A null or empty text is the end id alone. Rows that
    repeat a doc_id are packed each on its own; a null doc_id stays null. An empty
    table gives no pieces. No row is shuffled: a sequence is made where its document
    is read, and sequence_id numbers the pieces by task and place.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    source = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if source.value not in _encoders:
            _encoders[source.value] = encoder(source.value)
        encode, end = _encoders[source.value], np.array([end_id], "<u4").tobytes()
        out: list[list] = [[], [], [], [], []]
        for doc, text in zip(batch.column(0).to_pylist(), texts(batch)):
            ids = encode(text) + end
            n, at = len(ids) // 4, 0
            for size in lengths(n, window):
                for column, value in zip(out, (doc, at, size, n, ids[4 * at : 4 * (at + size)])):
                    column.append(value)
                at += size
        return pa.record_batch([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    pieces = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)
    return pieces.select("*", F.log2("length").cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each length, as curricula by length read them. pieces: what ``pack`` gives; without pieces there are no folders."""
    pieces.write.partitionBy("bucket").parquet(path)
