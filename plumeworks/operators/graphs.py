"""Graphs as edge tables."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share; a folder of our own only where a local session names none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def simple_edges(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected edges ``a, b`` once each, smaller end first; loops stay."""
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """``node, component``: the smallest node that each can reach. Labels spread to neighbours and then jump to their label's label."""
    edges = cut_lineage(edges.select("a", "b").distinct())
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).where("node <> other")
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b"))
    every = (ends if nodes is None else ends.union(nodes.toDF("node"))).distinct()
    label = cut_lineage(every.select("node", F.col("node").alias("component")))
    for _ in range(rounds):
        offered = both.join(label.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("m"))
        near = label.join(offered, "node", "left").select("node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        jump = near.select(F.col("node").alias("component"), F.col("component").alias("j"))
        after = cut_lineage(near.join(jump, "component", "left").select("node", F.least("component", "j").alias("component"), "old"))
        label = after.select("node", "component")
        if not after.where("component <> old").limit(1).count():
            return label
    raise RuntimeError("components did not settle")


def largest_component(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``node`` of the largest component; of equal ones, that of the smallest node."""
    of = connected_components(edges, nodes)
    best = of.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return of.join(F.broadcast(best.select("component")), "component", "left_semi").select("node")


def street_measures(edges: DataFrame, unit: str) -> DataFrame:
    """``unit, n_edges, n_nodes, connectivity, meshedness`` of each unit's simple graph.

    Connectivity is the mean degree, where a loop counts 2; meshedness (e - v + 1) / (2 v - 5).
    """
    simple = edges.select(unit, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = simple.groupBy(unit).agg(F.count("*").alias("n_edges"))
    v = simple.select(unit, F.explode(F.array("a", "b")).alias("n")).groupBy(unit).agg(F.countDistinct("n").alias("n_nodes"))
    c, m = F.try_divide(2 * F.col("n_edges"), F.col("n_nodes")), F.try_divide(F.col("n_edges") - F.col("n_nodes") + 1, 2 * F.col("n_nodes") - 5)
    return e.join(v, unit).select(unit, "n_edges", "n_nodes", c.alias("connectivity"), m.alias("meshedness"))


def merge_lists(df: DataFrame, key: str, items: str) -> DataFrame:
    """``group, items``: the union of lists that overlap, directly or through others, as components of a bipartite graph."""
    pairs = df.select(F.concat(F.lit("l:"), F.col(key).cast("string")).alias("a"), F.explode(F.col(items).cast("array<string>")).alias("item"))
    of = connected_components(pairs.select("a", F.concat(F.lit("x:"), "item").alias("b")))
    return pairs.join(of, pairs["a"] == of["node"]).groupBy(F.col("component").alias("group")).agg(F.array_sort(F.collect_set("item")).alias("items"))
