"""The driver's tables as points, units, counts, names and networks, by the same arithmetic in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import table

#: DuckDB: events as points in a metric plane.
POINTS = """p AS (SELECT event_id, ts, user_id, event_type, value, ((event_id * 7919) % 20011)::DOUBLE / 20011::DOUBLE * 20000::DOUBLE AS x,
 ((event_id * 104729) % 20021)::DOUBLE / 20021::DOUBLE * 15500::DOUBLE AS y FROM events)"""
#: DuckDB: embeddings as units with a place and a value.
UNITS = "u AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS v, embedding[4]::DOUBLE AS w FROM embeddings)"
#: DuckDB: a network with one graph for each order priority.
NETWORK = "e AS (SELECT DISTINCT o_orderpriority AS unit, least(o_custkey % 50, o_orderkey % 53) AS a, greatest(o_custkey % 50, o_orderkey % 53) AS b FROM orders)"


def points(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    x = (F.col("event_id") * 7919 % 20011).cast("double") / 20011.0 * 20000.0
    y = (F.col("event_id") * 104729 % 20021).cast("double") / 20021.0 * 15500.0
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", x.alias("x"), y.alias("y"))


def units(spark: SparkSession, sf: str) -> DataFrame:
    c = lambda k: F.col("embedding")[k].cast("double")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), c(0).alias("x"), c(1).alias("y"), c(2).alias("v"), c(3).alias("w"))


def network(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    a, b = F.col("o_custkey") % 50, F.col("o_orderkey") % 53
    return o.select(F.col("o_orderpriority").alias("unit"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def districts(spark: SparkSession) -> DataFrame:
    """20 square districts over the points' plane; the outermost points lie in none."""
    of = spark.range(20).select(F.col("id").alias("district"), ((F.col("id") % 5) * 3900.0 + 100).alias("a"), (F.floor(F.col("id") / 5) * 3800.0 + 100).alias("b"))
    corner = lambda dx, dy: F.struct((F.col("a") + dx).alias("x"), (F.col("b") + dy).alias("y"))
    return of.select("district", F.array(corner(0.0, 0.0), corner(3900.0, 0.0), corner(3900.0, 3800.0), corner(0.0, 3800.0), corner(0.0, 0.0)).alias("ring"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """``id, line``: a bent line of three points for each supplier."""
    k = F.col("s_suppkey")
    at = lambda m, n: F.struct((k * m % 1999).cast("double").alias("x"), (k * n % 1511).cast("double").alias("y"))
    return table(spark, sf, "supplier").select(k.alias("id"), F.array(at(37, 91), at(53, 71), at(83, 29)).alias("line"))


LINES = """l AS (SELECT s_suppkey AS id, ((s_suppkey * 37) % 1999)::DOUBLE AS x1, ((s_suppkey * 91) % 1511)::DOUBLE AS y1, ((s_suppkey * 53) % 1999)::DOUBLE AS x2, ((s_suppkey * 71) % 1511)::DOUBLE AS y2,
 ((s_suppkey * 83) % 1999)::DOUBLE AS x3, ((s_suppkey * 29) % 1511)::DOUBLE AS y3 FROM supplier)"""


#: DuckDB: a square of each supplier.
SQUARES = "q AS (SELECT s_suppkey AS id, ((s_suppkey * 37) % 1999)::DOUBLE AS x, ((s_suppkey * 91) % 1511)::DOUBLE AS y, (10 + s_suppkey * 13 % 190)::DOUBLE AS s FROM supplier)"


def ring(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A rectangle's closed ring."""
    return F.array(*[F.struct((x + dx * w).cast("double").alias("x"), (y + dy * h).cast("double").alias("y")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])


def squares(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("id"), ring(k * 37 % 1999, k * 91 % 1511, 10 + k * 13 % 190, 10 + k * 13 % 190).alias("ring"))
