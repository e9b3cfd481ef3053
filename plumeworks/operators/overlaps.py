"""Lines that run along one another, found by the straight lines that their segments lie on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import segments


#: Sine of the angle up to which a line goes straight on at a point.
STRAIGHT = 1e-9


def turns(line: Column) -> Column:
    """A line's ends and the points where it turns, without repeats in a row."""
    p = F.filter(line, lambda p, k: (k == 0) | (p["x"] != F.get(line, k - 1)["x"]) | (p["y"] != F.get(line, k - 1)["y"]))

    def kept(q: Column, b: Column, k: Column) -> Column:
        a, c = F.get(q, k - 1), F.get(q, k + 1)
        dx, dy, ex, ey = b["x"] - a["x"], b["y"] - a["y"], c["x"] - b["x"], c["y"] - b["y"]
        on = (F.abs(dx * ey - dy * ex) <= STRAIGHT * F.sqrt((dx * dx + dy * dy) * (ex * ex + ey * ey))) & (dx * ex + dy * ey > 0)
        return ~F.coalesce(on, F.lit(False))

    # as a lambda's variable the points are made once, not anew for each of them
    return F.get(F.transform(F.array(p), lambda q: F.filter(q, lambda b, k: kept(q, b, k))), 0)


def overlapping_lines(lines: DataFrame, key: str, line: str, close: float = 1e-6, drawn: bool = True) -> tuple[DataFrame, DataFrame]:
    """(pairs ``a, b, shared, relation``, members ``key, representative``).

    Lines with the same points in either direction are one, by their smallest key; pairs
    (a < b) are of representatives. Without ``drawn``, points where a line goes straight
    on make no difference: lines that turn at the same places are one. ``shared`` is the length that both have in common;
    relation is ``equal`` (other points, the same places), ``within`` (all of a runs
    along b), ``contains`` (all of b along a) or ``overlaps``. Lines that only cross or
    touch share no length and give no pair. Places within ``close`` count as one; lines
    are taken to be simple. Lines of fewer than two points and nulls have no length and
    no pair; an empty table gives empty results.

    A segment is cut at cells along its longer axis. In a cell, segments on one straight
    line have the same height at the cell's middle, so that only these are compared.
    """
    at = F.col(line) if drawn else turns(F.col(line))
    known = lines.where(F.col(line).isNotNull()).select(F.col(key).alias("__key"), F.least(at, F.reverse(at)).alias("__line"))
    distinct = known.groupBy("__line").agg(F.min("__key").alias("__rep"))
    members = known.join(distinct, "__line").select(F.col("__key").alias(key), F.col("__rep").alias("representative"))
    segs = segments(distinct.select("__rep", "__line"), "__rep", "__line")
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    segs = segs.withColumn("__l", F.sqrt(dx * dx + dy * dy)).where("__l > 0")
    lengths = segs.groupBy("__rep").agg(F.sum("__l").alias("__len"))
    wide = segs.agg(F.avg("__l")).first()[0] or 1.0
    # flat segments have their place along x and their height in y, steep ones the other way round; those at 45 degrees are both
    flat, steep = dx >= dy * (1 - 1e-9), dy >= dx * (1 - 1e-9)
    pick = lambda a, b, steep_: F.struct(F.lit(steep_).alias("steep"), F.col(a).alias("t1"), F.col(b).alias("h1"), F.col(a.replace("1", "2")).alias("t2"), F.col(b.replace("1", "2")).alias("h2"), (flat & steep).alias("both"))
    way = F.filter(F.array(F.when(flat, pick("x1", "y1", False)), F.when(steep, pick("y1", "x1", True))), lambda s: s.isNotNull())
    one = segs.select("__rep", "n", F.explode(way).alias("s")).select("__rep", "n", "s.*")
    one = one.withColumns({"slope": (F.col("h2") - F.col("h1")) / (F.col("t2") - F.col("t1")), "low": F.least("t1", "t2"), "high": F.greatest("t1", "t2")})
    one = one.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / wide), F.floor(F.col("high") / wide))))
    at = lambda t: F.col("h1") + F.col("slope") * (t - F.col("t1"))
    one = one.withColumns({"h": at((F.col("cell") + 0.5) * wide), "low": F.greatest("low", F.col("cell") * wide), "high": F.least("high", (F.col("cell") + 1) * wide)})
    step = 1e3 * close  # heights within half a step are in one of two bins, which are half a step apart
    bins = F.array(*[F.struct(F.lit(k).alias("shift"), F.floor(F.col("h") / step + k / 2).alias("bin")) for k in (0, 1)])
    keyed = one.where("high > low").withColumn("k", F.explode(bins)).select("__rep", "n", "steep", "both", "cell", "k.shift", "k.bin", "slope", "h", "low", "high")
    l, r = keyed.alias("l"), keyed.alias("r")
    c = lambda s, n: F.col(f"{s}.{n}")
    found = l.join(r, [c("l", n) == c("r", n) for n in ("steep", "cell", "shift", "bin")]).where((c("l", "__rep") < c("r", "__rep")) & ~(c("l", "both") & c("r", "both") & c("l", "steep")))
    low, high, middle = F.greatest(c("l", "low"), c("r", "low")), F.least(c("l", "high"), c("r", "high")), (c("l", "cell") + 0.5) * wide
    apart = lambda t: F.abs(c("l", "h") - c("r", "h") + (c("l", "slope") - c("r", "slope")) * (t - middle))
    along = F.sqrt(1 + c("l", "slope") * c("l", "slope"))
    hits = found.where((high - low > 0) & (F.greatest(apart(low), apart(high)) <= close * along))
    parts = hits.select(c("l", "__rep").alias("a"), c("r", "__rep").alias("b"), c("l", "n").alias("m"), c("r", "n").alias("n"), c("l", "cell").alias("cell"), ((high - low) * along).alias("d")).dropDuplicates(["a", "b", "m", "n", "cell"])
    shared = parts.groupBy("a", "b").agg(F.sum("d").alias("shared")).where(F.col("shared") > 10 * close)
    both = shared.join(lengths.toDF("a", "la"), "a").join(lengths.toDF("b", "lb"), "b")
    all_a, all_b = F.col("la") - F.col("shared") <= 10 * close, F.col("lb") - F.col("shared") <= 10 * close
    relation = F.when(all_a & all_b, "equal").when(all_a, "within").when(all_b, "contains").otherwise("overlaps")
    return both.select("a", "b", "shared", relation.alias("relation")), members
