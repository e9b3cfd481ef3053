"""Centroid clustering with adaptive lower bounds: exact Lloyd rounds over whole numbers.

Every vector keeps the centroid it is assigned to with an upper bound of its distance,
a lower bound for each of several next centroids, and one lower bound for all the rest.
When centroids move, bounds move by as much. While the bound of the rest stays above the
upper bound, the nearest centroid is the assigned one or one of the few whose bound is
not above it, and only those are measured; else the vector is measured against all.
The number of bounds kept shrinks to what certified vectors have needed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import checkpoint_folder, small_batches

K, ROUNDS, DIM, SCALE, SALT = 16, 3, 64, 64.0, 1
#: Components beyond this, in either direction, are refused: squared distances of up to 512 components would not fit a long.
LARGEST = 1 << 26
#: Bounds are kept this much on the safe side of what floating point gives.
SAFE = 1e-12
STATE = "vec array<int>, at int, before int, upper double, bounds array<double>, order array<int>, rest double, distance long, measured int, needed int"


def integers(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: float = SCALE) -> DataFrame:
    """``id, vec``: floor(scale * x) of each component. Vectors that are null, of another length, or hold null or non-finite components are left out."""
    x = F.col(f"`{vector}`").cast("array<double>")
    usable = x.isNotNull() & (F.size(x) == dim) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * scale))
    fits = F.forall(whole, lambda c: F.abs(c) <= LARGEST)
    checked = F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling")).cast("array<bigint>"))
    return vectors.where(usable).select(F.col(f"`{ident}`").alias("id"), checked.cast("array<int>").alias("vec"))


def seeds(kept: DataFrame, k: int, salt: int = SALT) -> np.ndarray:
    """The k vectors (all, if fewer) with the smallest sha256 of ``salt:id``; equal ids are ordered by their vectors, a null id counts as empty."""
    text = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = kept.select("vec", F.sha2(text, 256).alias("hash")).orderBy("hash", "vec").limit(k).collect()
    return np.array([r.vec for r in rows], np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of pairs of rows."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def all_squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every centroid; in floating point only where its whole numbers are exact."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * x.shape[1] * int(most) ** 2 < 1 << 53:
        f, g = x.astype(float), c.astype(float)
        return (np.einsum("ij,ij->i", f, f)[:, None] + np.einsum("ij,ij->i", g, g)[None] - 2 * f @ g.T).astype(np.int64)
    return np.stack([squares(x, np.broadcast_to(one, x.shape)) for one in c], 1)


def scan(x: np.ndarray, c: np.ndarray, b: int) -> dict[str, np.ndarray]:
    """The state of vectors that are measured against all centroids."""
    d2 = all_squares(x, c)
    ranked = np.argsort(d2, 1, kind="stable")  # equal distances: the smaller number first
    near = np.take_along_axis(d2, ranked[:, : b + 2], 1)
    root, n = np.sqrt(near.astype(float)), len(x)
    rest = root[:, b + 1] * (1 - SAFE) if len(c) > b + 1 else np.full(n, np.inf)
    return {"at": ranked[:, 0], "upper": root[:, 0] * (1 + SAFE), "bounds": root[:, 1 : b + 1] * (1 - SAFE), "order": ranked[:, 1 : b + 1], "rest": rest, "distance": near[:, 0], "measured": np.full(n, len(c)), "needed": np.zeros(n, int)}


def step(x: np.ndarray, s: dict[str, np.ndarray], c: np.ndarray, drift: np.ndarray, b: int, exact: bool) -> dict[str, np.ndarray]:
    """The state after centroids have moved to ``c`` by at most ``drift``; with ``exact``, every distance is measured."""
    upper = (s["upper"] + drift[s["at"]]) * (1 + SAFE)
    moved = drift[s["order"]]
    bounds = s["bounds"] - moved - SAFE * (np.abs(s["bounds"]) + moved)
    rest = s["rest"] - drift.max() - SAFE * np.where(np.isinf(s["rest"]), 0, np.abs(s["rest"]) + drift.max())
    order, at, distance, measured = s["order"].copy(), s["at"].copy(), np.full(len(x), -1), np.zeros(len(x), int)
    if bounds.shape[1] > b:
        by = np.argsort(bounds, 1, kind="stable")
        bounds, order = np.take_along_axis(bounds, by, 1), np.take_along_axis(order, by, 1)
        rest = np.minimum(rest, bounds[:, b])
        bounds, order = bounds[:, :b], order[:, :b]
    open_ = np.minimum(bounds.min(1, initial=np.inf), rest) <= upper
    look = np.flatnonzero(open_ | exact)
    distance[look] = squares(x[look], c[at[look]])
    upper[look] = np.sqrt(distance[look].astype(float)) * (1 + SAFE)
    measured[look] += 1
    full = open_ & (rest <= upper)
    few = (bounds <= upper[:, None]) & (open_ & ~full)[:, None]
    needed = few.sum(1)
    r, j = np.nonzero(few)
    d2 = squares(x[r], c[order[r, j]])
    np.add.at(measured, r, 1)
    bounds[r, j] = np.sqrt(d2.astype(float)) * (1 - SAFE)
    # the best of each vector's few: smallest distance, then smallest number
    best = np.lexsort((order[r, j], d2, r))
    first = best[np.flatnonzero(np.r_[True, r[best][1:] != r[best][:-1]])] if len(r) else best
    v, p, d = r[first], j[first], d2[first]
    wins = (d < distance[v]) | ((d == distance[v]) & (order[v, p] < at[v]))
    v, p, d = v[wins], p[wins], d[wins]
    bounds[v, p] = np.sqrt(distance[v].astype(float)) * (1 - SAFE)
    at[v], order[v, p] = order[v, p], at[v]
    distance[v], upper[v] = d, np.sqrt(d.astype(float)) * (1 + SAFE)
    out = {"at": at, "upper": upper, "bounds": bounds, "order": order, "rest": rest, "distance": distance, "measured": measured, "needed": needed}
    if full.any():
        anew = scan(x[full], c, bounds.shape[1])
        anew["measured"] += 1
        for name, values in anew.items():
            out[name][full] = values
    return out


def _matrix(column: pa.Array, n: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(n, -1)


def _assigned(state: DataFrame, c: np.ndarray, drift: np.ndarray | None, b: int, exact: bool) -> DataFrame:
    """state (``id, vec`` at first) after the assignment to centroids ``c``."""
    shared = state.sparkSession.sparkContext.broadcast((c, drift))
    names = [x.split()[0] for x in STATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, moved = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
            x = _matrix(col["vec"], n, np.int64)
            if moved is None:
                before, new = np.full(n, -1), scan(x, centres, b)
            else:
                before = col["at"].to_numpy(zero_copy_only=False)
                old = {k: col[k].to_numpy(zero_copy_only=False) for k in ("at", "upper", "rest")} | {"bounds": _matrix(col["bounds"], n, float), "order": _matrix(col["order"], n, np.int64)}
                new = step(x, old, centres, moved, b, exact)
            width = new["bounds"].shape[1]
            at = pa.array(np.arange(n + 1) * width, pa.int32())
            lists = {"bounds": pa.ListArray.from_arrays(at, pa.array(new["bounds"].ravel(), pa.float64())), "order": pa.ListArray.from_arrays(at, pa.array(new["order"].ravel(), pa.int32()))}
            flat = {"before": pa.array(before, pa.int32()), "upper": pa.array(new["upper"], pa.float64()), "rest": pa.array(new["rest"], pa.float64()), "distance": pa.array(new["distance"], pa.int64())}
            own = {"vec": col["vec"]} | lists | flat | {k: pa.array(new[k], pa.int32()) for k in ("at", "measured", "needed")}
            yield pa.record_batch([col["id"]] + [own[k] for k in names], names=["id", *names])

    schema = StructType([StructField("id", state.schema["id"].dataType), *StructType.fromDDL(STATE).fields])
    return state.mapInArrow(run, schema)


def _changes(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """By centroid, what the sums and counts of its vectors change by: summed in each task, then by Spark. Only vectors that have changed centroids are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            n = batch.num_rows
            x = np.c_[_matrix(batch.column(0), n, np.int64), np.ones(n, np.int64)] if n else np.zeros((0, dim + 1), np.int64)
            at, before = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            np.add.at(total, at, x)
            np.subtract.at(total, before[before >= 0], x[before >= 0])
        c, p = np.nonzero(total)
        yield pa.record_batch([pa.array(c, pa.int32()), pa.array(p, pa.int32()), pa.array(total[c, p], pa.int64())], names=["c", "p", "v"])

    some = state.where(F.col("at") != F.col("before")).select("vec", "at", "before").mapInArrow(run, "c int, p int, v long")
    total = np.zeros((k, dim + 1), object)
    for r in some.groupBy("c", "p").agg(F.sum("v").alias("v")).collect():  # k * (dim + 1) rows at most
        total[r.c, r.p] = r.v
    return total[:, :dim], total[:, dim]


def cluster(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: float = SCALE, folder: str | None = None) -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256, measured`` of every usable vector after ``rounds`` rounds and a last assignment.

    Vectors that are null, not of ``dim`` components, or hold null or non-finite
    components are left out; components beyond LARGEST after scaling raise an error.
    Centroids are the seeds, k or as many as there are vectors; a round assigns each
    vector to the nearest (ties: the smaller number) and moves every centroid that has
    vectors to the floor of their mean. Repeated rows each count, ids may be null or
    repeat, an empty table gives an empty result, other columns are not read.
    ``measured`` is the number of exact distances of the last assignment.

    Each round writes vectors with their bounds to a Parquet table in ``folder`` (a new
    one under the checkpoint folder), so that a lost executor repeats one round's tasks.
    The driver holds k * dim numbers.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    folder = folder or f"{checkpoint_folder(spark)}/clusters-{uuid.uuid4().hex}"
    state = integers(vectors, ident, vector, dim, scale)
    c = seeds(state, k)
    if not len(c):
        return state.select("id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(n) for n in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"), F.lit(0).alias("measured")).limit(0)
    k, drift, b = len(c), None, max(1, len(c) // 4)
    sums, counts = np.zeros((k, dim), object), np.zeros(k, object)
    for n in range(rounds + 1):
        _assigned(state, c, drift, b, n == rounds).write.parquet(f"{folder}/{n}")
        state = spark.read.parquet(f"{folder}/{n}")
        if n == rounds:
            break
        more, many = _changes(state, k, dim)
        sums, counts = sums + more, counts + many
        new = np.array([[v // counts[i] for v in sums[i]] if counts[i] else c[i].tolist() for i in range(k)], np.int64)
        drift = np.sqrt(squares(new, c).astype(float)) * (1 + SAFE)
        c = new
        if n:
            b = min(b, max(1, k // 8, state.agg(F.max("needed")).first()[0]))
    inertia = {r.at: r.d for r in state.groupBy("at").agg(F.sum("distance").alias("d")).collect()}  # k rows at most
    sha = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    of = spark.createDataFrame([(i, inertia.get(i, 0), sum(inertia.values()), sha[i]) for i in range(k)], "at int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(of), "at").select("id", F.col("at").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256", "measured")
