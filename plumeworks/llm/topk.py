"""Exact top-k inner products by ball-tree branch and bound.

Candidates are packed into shards of a bounded size where they are read; each shard is
one row with a ball tree over its vectors. Queries go in blocks and shards in groups,
and each block meets each group in a task of its own. There nodes are visited by the
upper bound ``q . centre + |q| * radius``, largest first, and those are dropped that no
query of the block can use. The kth score that a first, bounded shard gives is where
all tasks of a query start; in a group the current one goes on from shard to shard.
The k best of each group are merged at the end.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches

K, EVERY, SCALE = 20, 20, 64.0
SHARD, LEAF, BLOCK = 2048, 64, 1024
#: Vectors in a group of shards.
GROUP = 16_384
#: Shuffle partitions at most; beyond, a partition has several blocks' meetings with groups, one after another.
PARTITIONS = 20_000
PARTS = {"ids": "binary", "data": "binary", "dim": "int", "tree": "binary", "bounds": "binary"}


def integers(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of each component; vectors with null or non-finite components are left out."""
    x = F.col("embedding").cast("array<double>")
    usable = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))


def matrix(rows: list) -> np.ndarray:
    """The vectors as rows; shorter ones are filled with zeros."""
    dim = max(map(len, rows), default=0)
    out = np.zeros((len(rows), dim))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def build(ids: np.ndarray, data: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, data) in the order of the tree, and its nodes (first, last, left child, right child) with (centre, radius)."""
    order, nodes, balls = np.arange(len(ids)), [], []
    todo = [(0, len(ids), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        part = data[order[a:b]]
        centre = part.mean(0)
        away = np.sqrt(((part - centre) ** 2).sum(1))
        at = len(nodes)
        nodes.append([a, b, -1, -1])
        balls.append(np.r_[centre, away.max(initial=0.0)])
        if parent >= 0:
            nodes[parent][2 + side] = at
        if b - a > leaf:
            far = part[away.argmax()]
            other = part[((part - far) ** 2).sum(1).argmax()]
            cut = np.argsort(part @ (other - far), kind="stable")
            order[a:b] = order[a:b][cut]
            middle = (a + b) // 2
            todo += [(a, middle, at, 0), (middle, b, at, 1)]
    return ids[order], data[order], np.array(nodes, np.int32).reshape(-1, 4), np.array(balls).reshape(-1, data.shape[1] + 1)


def packed(df: DataFrame, size: int) -> DataFrame:
    """Rows of up to ``size`` vectors, made where they are read."""
    small_batches(df.sparkSession)

    def row(ids: list, rows: list) -> pa.RecordBatch:
        i, data = np.array(ids, np.int64), matrix(rows)
        i, data, nodes, balls = build(i, data)
        small = data.size == 0 or np.abs(data).max() < 32768
        blob = data.astype("<i2" if small else "<f8").tobytes()
        return pa.record_batch([*(pa.array([x], pa.binary()) for x in (i.tobytes(), blob)), pa.array([data.shape[1]], pa.int32()), pa.array([nodes.tobytes()], pa.binary()), pa.array([balls.tobytes()], pa.binary())], names=list(PARTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            rows += batch.column(1).to_pylist()
            while len(ids) >= size:
                yield row(ids[:size], rows[:size])
                ids, rows = ids[size:], rows[size:]
        if ids:
            yield row(ids, rows)

    return df.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in PARTS.items()))


def _unpack(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    wide = len(data) == 8 * len(i) * dim
    return i, np.frombuffer(data, "<f8" if wide else "<i2").astype(float).reshape(len(i), dim)


def _opened(ids: bytes, data: bytes, dim: int, tree: bytes, bounds: bytes) -> tuple[np.ndarray, ...]:
    """A packed shard as ids, vectors, nodes and balls."""
    return *_unpack(ids, data, dim), np.frombuffer(tree, np.int32).reshape(-1, 4), np.frombuffer(bounds, float).reshape(-1, dim + 1)


class Search:
    """The best k so far of each query of a block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, queries, k
        self.norm = np.sqrt((queries**2).sum(1))
        self.kth = np.full(len(ids), -math.inf)
        self.owner, self.found, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.visited = self.pruned = 0

    def forget(self) -> None:
        """Keep the kth scores only, as bounds; what they come from is met again."""
        self.owner, self.found, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def shard(self, ids: np.ndarray, data: np.ndarray, nodes: np.ndarray, balls: np.ndarray) -> None:
        dim = max(self.q.shape[1], data.shape[1])
        q = np.pad(self.q, ((0, 0), (0, dim - self.q.shape[1])))
        data = np.pad(data, ((0, 0), (0, dim - data.shape[1])))
        centre = np.pad(balls[:, :-1], ((0, 0), (0, dim - balls.shape[1] + 1)))
        top = q @ centre.T + self.norm[:, None] * balls[:, -1]
        top += 1e-9 * (1 + np.abs(top)) + 1e-9 * self.norm[:, None] * np.sqrt((centre**2).sum(1))
        most = float((np.abs(q).max(initial=0.0) * np.abs(data).max(initial=0.0)) * max(1, dim))
        exact = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object
        if exact is object:
            q, data = (np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (q, data))
        else:
            q, data = q.astype(exact), data.astype(exact)
        heap = [(-float(top[:, 0].max()), 0)] if len(nodes) and len(q) else []
        while heap:
            _, at = heapq.heappop(heap)
            live = np.flatnonzero(top[:, at] >= self.kth)
            if not len(live):
                self.pruned += 1
                continue
            a, b, left, right = nodes[at].tolist()
            if left >= 0:
                for child in (left, right):
                    heapq.heappush(heap, (-float(top[live, child].max()), child))
                continue
            self.visited += 1
            scores = q[live] @ data[a:b].T
            self._take(live, ids[a:b], scores)

    def _take(self, live: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        hit = (scores >= self.kth[live][:, None]) & (ids[None, :] != self.ids[live][:, None])
        row, column = np.nonzero(hit)
        if not len(row):
            return
        changed = np.zeros(len(self.ids), bool)
        changed[live[row]] = True
        old = changed[self.owner]
        kind = self.score.dtype if scores.dtype != object else object
        owner = np.r_[self.owner[old], live[row]]
        found = np.r_[self.found[old], ids[column]]
        score = np.r_[self.score[old].astype(kind), scores[row, column].astype(kind)]
        order = np.lexsort((found, -score, owner)) if kind != object else np.array(sorted(range(len(owner)), key=lambda i: (owner[i], -score[i], found[i])), np.int64)
        owner, found, score = owner[order], found[order], score[order]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        rank = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
        last = rank == self.k - 1
        self.kth[owner[last]] = score[last].astype(float)
        keep = rank < self.k
        self.owner, self.found, self.score = np.r_[self.owner[~old], owner[keep]], np.r_[self.found[~old], found[keep]], np.r_[self.score[~old].astype(kind), score[keep]]

    def rows(self) -> pa.RecordBatch:
        order = np.array(sorted(range(len(self.owner)), key=lambda i: (self.owner[i], -self.score[i], self.found[i])), np.int64)
        owner, found = self.owner[order], self.found[order]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, np.int64)
        rank = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)])) + 1
        return pa.record_batch([pa.array(self.ids[owner]), pa.array(rank, pa.int32()), pa.array(found), pa.array([int(s) for s in self.score[order]], pa.int64())], names=["query_id", "rank", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: float = SCALE, block: int = BLOCK, shard: int = SHARD, group: int = GROUP, partitions: int = PARTITIONS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of each query, ties to the smaller vec_id.

    vectors: has ``vec_id`` and ``embedding``; other columns are not read. Queries are
    the rows whose vec_id is divisible by ``every``, candidates all rows with another
    vec_id than the query's. Rows with a null vec_id, a null vector, or null or
    non-finite components take no part. Vectors of different lengths are compared as
    if filled with zeros. Rows that repeat a vec_id are candidates each on its own; as
    queries they are asked once, by their largest vector. An empty table gives no rows.
    Each block of queries meets each group of shards: N * Q / block vectors and
    Q * N / group queries are sent, over at most ``partitions`` partitions, and a task
    holds one block and one shard.
    """
    of = integers(vectors, scale)
    asked = of.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("v").alias("v"))
    n, sc = of.count(), vectors.sparkSession.sparkContext
    blocks, groups = max(1, -(-asked.count() // block)), max(1, -(-n // max(group, shard)))
    # a bounded sample: what a query's kth score is among these, it is at least among all
    first = sc.broadcast([tuple(r) for r in packed(of.limit(shard), shard).collect()])
    number = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("long")
    everywhere = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    queries = asked.select(number.alias("block"), everywhere(groups).alias("group"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "v", *[F.lit(None).cast(t).alias(n) for n, t in PARTS.items()])
    shards = packed(of, shard).withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("long"))
    sent = shards.select(everywhere(blocks).alias("block"), "group", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v"), *PARTS)
    both = queries.union(sent).select((F.col("block") * groups + F.col("group")).alias("task"), "kind", "id", "v", *PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, rows, search = None, [], [], None
        for batch in batches:
            for r in range(batch.num_rows):
                number, kind = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                if number != at:
                    if search is not None:
                        yield search.rows()
                    at, ids, rows, search = number, [], [], None
                if kind == 0:
                    ids.append(batch.column(2)[r].as_py())
                    rows.append(batch.column(3)[r].as_py())
                elif ids:
                    if search is None:
                        search = Search(np.array(ids, np.int64), matrix(rows), k)
                        for parts in first.value:
                            search.shard(*_opened(*parts))
                        search.forget()
                    search.shard(*_opened(*(batch.column(c)[r].as_py() for c in range(4, 9))))
        if search is not None:
            yield search.rows()

    # by number: a partition gets several only by chance, or where there are more of them than partitions
    dealt = both.repartition(min(blocks * groups, partitions), "task") if blocks * groups > 1 else both.repartition(1)
    found = dealt.sortWithinPartitions("task", "kind").mapInArrow(run, "query_id long, rank int, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
