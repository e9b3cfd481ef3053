"""Quality rules in a bitmask ledger.

Every rule is evaluated once. The ledger keeps the measurements and one bit for each
rule that a document fails; policies are versioned masks over these bits, and
ablations of any policy come from bitwise aggregation, without reading a text again.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACES, _SYMBOLS, _BLANK = " \t\n\v\f\r", "#*$%&|<>", " \t\v\f\r"
#: name -> SQL condition over the measurements under which a document fails. A rule's bit is its place here; new rules go last.
RULES = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "many_words": "n_words > 1000000",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE = ("few_words", "repeats")
#: version -> the rules that it enforces.
POLICIES = {"base": BASE, "v1": tuple(RULES)}


def mask(rules: tuple[str, ...]) -> int:
    """The bits of these rules."""
    names = list(RULES)
    return sum(1 << names.index(r) for r in set(rules))


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """The measurements of a text, and its lines that have a word."""
    words = text.encode().split()  # bytes are split at ASCII white space only
    n = len(words)
    chars = len(text) - sum([text.count(c) for c in _SPACES])
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        times = Counter(windows)
        if len(times) < len(windows):
            twice = np.array([times[w] > 1 for w in windows])
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeated = int(covered.sum())
    return n, chars, sum([text.count(c) for c in _SYMBOLS]), len(lines) - len(set(lines)), repeated, len(lines)


def failed(bits: Column, rules: tuple[str, ...]) -> Column:
    """Whether any of these rules is failed."""
    return bits.bitwiseAND(F.lit(mask(rules)).cast("long")) != 0


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements, ``n_lines`` and ``failed_bits`` of every document.

    docs: has ``doc_id`` and ``text``; other columns are not read. A null or empty
    text has measurements of zero and fails few_words only. Repeated rows give a row
    each, an empty table none.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measure(t) for t in texts(batch)]
        return pa.record_batch([batch.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(6))], names=["doc_id", *MEASURES, "n_lines"])

    measured = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", n_lines long")
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << k}L ELSE 0L END" for k, rule in enumerate(RULES.values()))
    return measured.withColumn("failed_bits", F.expr(bits))


def apply_policy(of: DataFrame, version: str) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy: a row for each of the ledger's, so that repeats stay and an empty ledger gives none. A policy that is not known raises."""
    base = failed(F.col("failed_bits"), BASE)
    return of.select("*", base.alias("base_failed"), (~base & ~failed(F.col("failed_bits"), POLICIES[version])).alias("kept"))


def ablations(of: DataFrame, version: str) -> DataFrame:
    """``rule, n_failed, n_only``: documents failing each rule of a policy, and those failing no other of it.

    One pass of sums over the bits; n_only more documents would stay without the rule.
    Repeated rows each count; an empty ledger gives every rule with zeros.
    """
    bits = F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long"))
    names = [r for r in RULES if r in POLICIES[version]]
    sums = [F.struct(F.lit(r).alias("rule"), F.coalesce(F.sum((bits.bitwiseAND(F.lit(mask((r,))).cast("long")) != 0).cast("long")), F.lit(0)).alias("n_failed"), F.coalesce(F.sum((bits == F.lit(mask((r,))).cast("long")).cast("long")), F.lit(0)).alias("n_only")) for r in names]
    return of.agg(F.array(*sums).alias("rows")).select(F.inline("rows"))
