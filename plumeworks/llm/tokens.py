"""Token counts with the whole-token shortcut.

Offline, every vocabulary string is encoded by the merges; those that come out as
one token are proven. A pre-token that is proven counts one; only the rest is merged.
"""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteLevel, Remembered, byte_level
from .common import map_batches, texts

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def prove(source: str) -> frozenset[bytes]:
    """The vocabulary strings that encode alone as their own single token."""
    tok = ByteLevel(source)
    start = tok.letter_ids
    strings = ((tok.raw(s), i) for s, i in tok.vocab.items())
    return frozenset(raw for raw, i in strings if tok.merges.apply([start[b] for b in raw]) == [i])


def counter(source: str, proven: frozenset[bytes]):
    """text -> its number of tokens."""
    tok = byte_level(source)

    def count(chunk: str) -> int:
        if chunk in tok.special:
            return 1
        return sum([1 if p in proven else len(tok.merge(p)) for p in tok.pieces(chunk)])

    memo = Remembered(count)
    return lambda text: sum([memo[c] for c in tok.chunks(text)])


_counters: dict = {}


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` (n_tokens > limit) of every document.

    docs: has ``doc_id`` and ``text``; other columns are not read. A null text
    counts as empty: no bytes, no tokens. Special strings in a text count one token
    each. Repeated rows give a row each, an empty table none.
    """
    source = Path(vocabulary).read_text(encoding="utf-8")
    shared = docs.sparkSession.sparkContext.broadcast((source, prove(source)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if shared.value[0] not in _counters:
            _counters[shared.value[0]] = counter(*shared.value)
        count, of = _counters[shared.value[0]], texts(batch)
        n = [count(t) for t in of]
        return pa.record_batch([batch.column(0), pa.array([len(t.encode()) for t in of], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)
