"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most 4 of their 8
bytes, so that they share at least 4 positional bytes. The index has a posting list
for each byte at each position; in a list the shared positional bytes of each pair are
tallied, pairs that reach the minimum of 4 are retained, and these are verified by
Hamming distance. The first of four shared positions is one of the first five, so that
only these five have lists.

A list over ``LIST`` members is split by a further position and its byte, and one that is
still longer by two more; a pair in a split list shares bytes at later positions too,
so that it meets in one of the parts and no pair is lost. After that the members share
four bytes, and what is still longer is split in the task that has it: of the 8 half
bytes that are left, a pair within the limit shares 4.

Only different fingerprints are indexed, so that copies cost nothing. In a list the
links are walked breadth first over what is not yet reached, and a list gives one edge
for each member that it reaches, never all its pairs; components stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import checkpoint, fresh, map_batches, small_batches, texts

WORDS, BITS, SEED = 4, 4, 42
#: Positional bytes that a pair must share, and members of a list that is not split.
LEAST, LIST = 4, 4096
#: Lists up to this size are compared side by side.
SHORT = 32
#: Shingles hashed at once, which bounds the memory that a long text takes.
BLOCK = 1 << 15


def fingerprint(text: str, words: int = WORDS) -> int:
    """The unsigned fingerprint of a text; 0 if it has no words."""
    w = text.encode().lower().split()  # bytes: only ASCII is lowered, and split at
    if not w:
        return 0
    joined = b" ".join(w)
    sizes = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(sizes + 1) - 1
    k = min(words, len(w))
    first, last = (ends - sizes)[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(first), BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK])], "<u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(first), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, fp`` of every document, fp as the signed long of the same bits."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, words) for t in texts(batch)], np.uint64).view(np.int64)
        return pa.record_batch([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def _key(positions: tuple[int, ...], column: str = "fp") -> Column:
    """The positions as a bit mask, over the bytes there."""
    key = F.lit(sum(1 << p for p in positions)).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned(column, 8 * p).bitwiseAND(F.lit(255).cast("long")))
    return key


def _choices(size: int, least: int = LEAST) -> list[tuple[int, ...]]:
    """Positions that the first ``size`` of ``least`` shared ones can be."""
    return [c for c in combinations(range(8), size) if 8 - c[-1] > least - size]


def _dealt(members: DataFrame, size: int, after: int = 0) -> DataFrame:
    """``key, fp`` for each choice of ``size`` positions; ``after`` of them are given by the members' own key."""
    if not after:
        return members.select("fp", F.explode(F.array(*[_key(c) for c in _choices(size)])).alias("key"))
    given = F.shiftrightunsigned("key", 8 * after)
    longer = F.array(*[F.struct(F.lit(sum(1 << p for p in c[:after])).cast("long").alias("given"), _key(c).alias("key")) for c in _choices(size)])
    return members.select("fp", F.explode(F.transform(F.filter(longer, lambda x: x["given"] == given), lambda x: x["key"])).alias("key"))


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """The tally of equal bytes from the exclusive or of two fingerprints."""
    x = x | x >> np.uint64(4)
    x = x | x >> np.uint64(2)
    x = (x | x >> np.uint64(1)) & np.uint64(0x0101010101010101)
    return 8 - np.bitwise_count(x)


def reached(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fp, the smallest fp that it is linked to) for what a list's links reach; fps is sorted. The tally comes first, then the distance of what it retains."""
    left, child, root = fps, [], []
    while len(left) > 1:
        start, left = left[0], left[1:]
        frontier = [left[:0]]
        front = np.array([start], left.dtype)
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            step = max(1, (1 << 20) // len(left))
            for at in range(0, len(front), step):
                near |= _near(left[None, :] ^ front[at : at + step, None], bits).any(0)
            front, left = left[near], left[~near]
            frontier.append(front)
        got = np.concatenate(frontier)
        child.append(got)
        root.append(np.full(len(got), start, fps.dtype))
    none = fps[:0]
    return np.concatenate(child or [none]), np.concatenate(root or [none])


def long_list(fps: np.ndarray, free: list[int], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a list whose members differ only at the ``free`` four positions, by choices of 4 of their 8 half bytes.

    A part has equal bits but for 16, so that it has 65536 members at most.
    """
    halves = np.stack([fps >> np.uint64(8 * p + h) & np.uint64(15) for p in free for h in (0, 4)])
    for chosen in combinations(range(len(halves)), len(halves) - 4):
        key = np.zeros(len(fps), np.uint64)
        for k in chosen:
            key = key << np.uint64(4) | halves[k]
        order = np.argsort(key, kind="stable")
        yield from _edges(key[order], fps[order], bits)


def _near(x: np.ndarray, bits: int) -> np.ndarray:
    """Where an exclusive or has enough equal bytes and, of these, a distance within the limit."""
    near = shared_bytes(x) >= LEAST
    near[near] = np.bitwise_count(x[near]) <= bits
    return near


def pairs(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The links of a list, or where they are many edges with the same components."""
    found, n, step = [], 0, max(1, (1 << 20) // len(fps))
    for at in range(0, len(fps), step):
        rows = fps[at : at + step]
        i, j = np.nonzero(_near(rows[:, None] ^ fps[None, at:], bits))
        later = j > i
        found.append((fps[at + j[later]], rows[i[later]]))
        n += len(found[-1][0])
        if n > 16 * len(fps):
            return reached(np.sort(fps), bits)
    return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))


def _edges(key: np.ndarray, fp: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of the lists that follow one another in key."""
    if not len(key):
        return
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    short = np.where(sizes <= SHORT, sizes, 0)
    left = np.repeat(short, sizes) - (np.arange(len(key)) - np.repeat(starts, sizes))  # members from here to the list's end
    for apart in range(1, int(short.max(initial=0))):
        at = np.flatnonzero(left > apart)
        at = at[_near(fp[at] ^ fp[at + apart], bits)]
        if len(at):
            yield fp[at + apart], fp[at]
    for at, n in zip(starts[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist()):
        yield pairs(fp[at : at + n], bits)


def _linked(dealt: DataFrame, bits: int, most: int | None = None) -> DataFrame:
    """``u, v`` of the lists ``key, fp``; lists over ``most`` members share four bytes and are split here."""
    small_batches(dealt.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            large = sizes > most if most else np.zeros(len(sizes), bool)
            plain = ~np.repeat(large, sizes)
            edges = [*_edges(key[plain], fp[plain], bits)]
            for at, n in zip(starts[large].tolist(), sizes[large].tolist()):
                mask = int(key[at]) >> 32
                for edge in long_list(fp[at : at + n], [p for p in range(8) if not mask >> p & 1], bits):
                    edges.append(edge)
                    if len(edges) > 1 << 14:
                        yield rows(edges)
                        edges = []
            yield rows(edges)

        def rows(edges: list) -> pa.RecordBatch:
            a, b = (np.concatenate([np.empty(0, np.uint64), *(e[k] for e in edges)]) for k in (0, 1))
            return pa.record_batch([pa.array(np.minimum(a, b).view(np.int64)), pa.array(np.maximum(a, b).view(np.int64))], names=["u", "v"])

        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            n += batch.num_rows
            if n < 1 << 16 or held[-1][0][-1] == held[0][0][0]:  # one list so far
                continue
            key, fp = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            cut = int(np.searchsorted(key, key[-1]))  # the last list may go on
            held, n = [(key[cut:], fp[cut:])], len(key) - cut
            yield from done(key[:cut], fp[:cut])
        if held:
            yield from done(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))

    return dealt.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def links(nodes: DataFrame, bits: int = BITS, most: int = LIST) -> DataFrame:
    """``u, v`` (u < v as unsigned): edges whose components are those of all links between fingerprints.

    There are 1280 lists by one byte and 655,360 by two at most, so that the keys of the
    long ones have a proven bound and are broadcast.
    """
    if not 0 <= bits <= 8 - LEAST:
        raise ValueError("bits must be 0 to 4: four shared bytes are then guaranteed")
    out, members, after = None, nodes, 0
    for size in (1, 2):
        dealt = checkpoint(_dealt(members, size, after))
        long = checkpoint(dealt.groupBy("key").count().where(F.col("count") > most).select("key"))
        now = _linked(dealt.join(F.broadcast(long), "key", "left_anti"), bits)
        out = now if out is None else out.union(now)
        members, after = dealt.join(F.broadcast(long), "key", "left_semi"), size
    return out.union(_linked(_dealt(members, LEAST, after), bits, most)).distinct()


def _signature(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges, and for others only by a collision of 64 bits."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` of every node of the edges ``u, v``: the smallest node (as a signed long) that it can reach.

    Large-star and small-star steps in turn; each keeps the components, and they end
    in stars after about log2 of the longest path. Each round is checkpointed.
    """
    now = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    signature = _signature(now)
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpoint(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = checkpoint(small.where("u <> v").distinct())
        before, signature = signature, _signature(after)
        now = after
        if before == signature:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """``doc_id, fp, component_id, keeper`` of every document.

    docs: has ``doc_id`` and ``text``; other columns are not read. component_id is the
    smallest doc_id that links of at most ``bits`` differing bits reach, null where
    all ids of the component are null. Null, empty and wordless texts have the
    fingerprint zero and link as any other. keeper marks the rows that stand for their
    component: those with its component_id and, among these, the smallest fp; repeated
    rows of one doc_id and text are all marked. An empty table gives no rows.
    """
    of = checkpoint(fingerprints(docs, words))
    nodes = checkpoint(of.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), bits))
    linked = nodes.join(roots, nodes["fp"] == roots["node"])
    best = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp"))["fp"].alias("kept_fp"))
    named = linked.join(best, "root").select("fp", "component_id", "kept_fp")
    alone = nodes.join(named.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"), F.col("fp").alias("kept_fp"))
    classes = checkpoint(named.union(alone))
    keeper = (F.col("fp") == F.col("kept_fp")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    return of.join(classes, "fp").select("doc_id", "fp", "component_id", keeper.alias("keeper"))


def hex_digits(fp: str) -> Column:
    """16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row of docs, with all its columns, of each component: that of its smallest doc_id, a null id only where there is no other.

    Of rows that share doc_id and fingerprint the one whose columns have the smallest
    hash stays, so that the choice does not depend on the order of rows. Null, empty and
    wordless texts are near duplicates of one another. The texts are hashed again where
    they are read and shuffled once, by (doc_id, fp). An empty table stays empty.
    """
    kept = near_duplicates(docs, words, bits).where("keeper").select("doc_id", "fp").distinct()
    id_, known, fp, order, last = fresh(docs, "id", "known", "fp", "order", "last")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, words) for t in texts(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=[*batch.schema.names, fp])

    key = F.col("doc_id").cast("long")
    hashed = map_batches(docs, run, StructType([*docs.schema.fields, StructField(fp, LongType())]))
    hashed = hashed.withColumns({id_: F.coalesce(key, F.lit(0).cast("long")), known: key.isNotNull()})
    kept = kept.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias(id_), F.col("doc_id").isNotNull().alias(known), F.col("fp").alias(fp))
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    joined = hashed.join(kept, [id_, known, fp]).withColumn(order, F.xxhash64(*plain))
    of = joined.withColumn(last, F.row_number().over(W.partitionBy(id_, known, fp).orderBy(order)))
    return of.where(F.col(last) == 1).select(*[f"`{c}`" for c in docs.columns])
