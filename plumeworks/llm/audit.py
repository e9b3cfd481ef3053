"""Audit of how filters interact: what each removes in every order of application.

A fingerprint-routed RDD finds repeated texts. Rows are partitioned by the xxhash64 of
their text; a partition keeps, for the fingerprint at hand, a chain of the different
texts that share it, each in full with its minimum id, and gives out the ids that are
not the minimum. Before that, a task keeps chains over its own rows, so that of a text
with any number of copies it sends no more than one row for each of its chains' fillings.
Then each row is a mask of the filters that it fails, combineByKey merges the vectors of
mask counts by part, and every order, step and count of the report follows from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
E = 1 << FILTERS.index("E")
#: Characters of text that a task's own chains hold before they are sent on, and rows that go in one list.
CHAINS, LIST = 32 << 20, 500
#: Bytes of text that a partition of fingerprints gets, about.
PART = 64 << 20
MASKS = "doc_id long, part string, mask int"
COUNTS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def masks(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: few words, few different words, many capitals, symbols."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [n < 200, 100 * kinds < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


class Chains:
    """Fingerprint -> chain of [text, minimum id, its rows]; a text is compared in full."""

    def __init__(self):
        self.of, self.size = {}, 0

    def link(self, fingerprint: int, text: str) -> list:
        """The link of a text, a new one with no id yet."""
        chain = self.of.setdefault(fingerprint, [])
        for link in chain:
            if link[0] == text:
                return link
        chain.append(link := [text, None, []])
        self.size += len(text)
        return link

    def sent(self) -> Iterator[tuple]:
        for fingerprint, chain in self.of.items():
            for text, i, rows in chain:
                yield (fingerprint, i), (text, rows)


def _own_minima(rows: Iterator, most: int) -> Iterator[tuple]:
    """(key, (text, rows)): each text that a task holds with its smallest id, keyed by (fingerprint, id), and its rows (id, part, mask).

    Rows that a chain shows not to be the minimum fail E here, and rows without an id
    cannot fail it: both go in lists without a text, dealt out evenly.
    """
    chains, done, n = Chains(), [], 0
    for i, part, mask, fingerprint, text in rows:
        if i is None:
            done.append((i, part, mask))
        else:
            link = chains.link(fingerprint, text)
            if link[1] is None or i < link[1]:
                done += [(j, p, m | E) for j, p, m in link[2]]
                link[1:] = i, [(i, part, mask)]
            elif i > link[1]:
                done.append((i, part, mask | E))
            elif len(link[2]) < LIST:
                link[2].append((i, part, mask))
            else:
                yield (fingerprint, i), (text, [(i, part, mask)])
        if len(done) >= LIST:
            yield (n, 0), (None, done)
            done, n = [], n + 1
        if chains.size >= most:
            yield from chains.sent()
            chains = Chains()
    yield from chains.sent()
    yield (n, 0), (None, done)


def _routed(records: Iterator[tuple]) -> Iterator[tuple]:
    """(id, part, mask) of all rows of a partition in the order of (fingerprint, id): the first id of a text is its minimum, others fail E."""
    at, chains = None, Chains()
    for (fingerprint, i), (text, rows) in records:
        if text is None:
            yield from rows
            continue
        if fingerprint != at:
            at, chains = fingerprint, Chains()
        link = chains.link(fingerprint, text)
        if link[1] is None:
            link[1] = i
        for j, part, mask in rows:
            yield j, part, mask | (E if i > link[1] else 0)


def failed(docs: DataFrame, ident: str = "doc_id", text: str = "text", part: str = "source", most: int = CHAINS, partitions: int | None = None) -> DataFrame:
    """``doc_id, part, mask``: of every row, the bits of the filters A to E that it fails, each by itself.

    A null text is empty, a null part the empty string. A row fails E if its text equals
    that of any row with a smaller id; rows equal in id and text do not fail each other,
    and a null id is neither smaller nor larger. An empty table gives none. The number of
    partitions follows from the bytes of all texts, which are summed first.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{ident}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), masks(body).alias("mask"), F.xxhash64(body).alias("fingerprint"), body.alias("text"))
    own = rows.rdd.mapPartitions(lambda some: _own_minima(some, most))
    if partitions is None:
        size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`"))).alias("size")).first()["size"] or 0
        partitions = max(own.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism, -(-size // PART))
    routed = own.repartitionAndSortWithinPartitions(partitions, lambda key: key[0]).mapPartitions(_routed)
    return docs.sparkSession.createDataFrame(routed, MASKS)


def _one(kind: tuple) -> np.ndarray:
    v = np.zeros((3, 32), np.int64)
    return _with(v, kind)


def _with(v: np.ndarray, kind: tuple) -> np.ndarray:
    mask, good, toxic = kind
    v[0, mask] += 1
    v[1, mask] += good
    v[2, mask] += toxic
    return v


def _both(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    v += w
    return v


def counted(rows: DataFrame) -> RDD:
    """(part, counts of all, good and toxic rows by mask) from ``part, mask, good, toxic``."""
    return rows.select("part", "mask", "good", "toxic").rdd.map(lambda r: (r[0], (r[1], r[2], r[3]))).combineByKey(_one, _with, _both)


def report(part: str, counts: np.ndarray) -> list[tuple]:
    """The rows of COUNTS of one part: all orders, all steps."""
    every, all_ = np.arange(32), int(counts[0].sum())
    unique = [int(counts[0, 1 << f]) for f in range(len(FILTERS))]
    steps, total = [], dict.fromkeys(range(len(FILTERS)), 0)
    for order in permutations(range(len(FILTERS))):
        before, left = 0, all_
        for k, f in enumerate(order):
            fails = every & (1 << f) != 0
            here = fails & (every & before == 0)
            removed, good, toxic = (int(x) for x in counts[:, here].sum(1))
            left -= removed
            total[f] += removed
            steps.append((order, k + 1, f, left, removed, int(counts[0, fails & ~here].sum()), unique[f], good, toxic))
            before |= 1 << f
    return [(part, "".join(FILTERS[x] for x in o), k, left, *more, total[f]) for o, k, f, left, *more in steps]


def audit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", part: str = "source", **options) -> DataFrame:
    """COUNTS: for each part, each of the 120 orders of the filters and each step, what is kept, removed and lost.

    labels: ``doc_id, quality, toxic``; a document is good if any of its labels has
    quality 1, toxic if any has toxic 1. Texts are shuffled once, without labels, which
    join the masks. Nulls, repeats and empty tables as in ``failed``: an empty table has
    no parts and no rows. Other columns are not read.
    """
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(f"is_{c}")
    of = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    rows = failed(docs, ident, text, part, **options).join(of, "doc_id", "left")
    rows = rows.select("part", "mask", F.coalesce("is_quality", F.lit(0)).alias("good"), F.coalesce("is_toxic", F.lit(0)).alias("toxic"))
    reports = counted(rows).flatMap(lambda kv: report(*kv))
    return docs.sparkSession.createDataFrame(reports, COUNTS)
