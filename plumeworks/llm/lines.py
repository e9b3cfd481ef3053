"""Line dedup by site-relative frequency, in DataFrame functions only.

By host, the pages that contain a line are divided by the host's pages; lines above
the ratio are boilerplate and are dropped. Pages of one host with the same text count
once, so that copies of a page do not make its own lines boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh

#: A line is boilerplate on more than this share of a host's pages, and on this many at least: fewer cannot be told from chance.
RATIO, PAGES = 0.05, 3
#: Boilerplate lines up to this number (16 bytes each) are broadcast; beyond, they are joined by host and one of SALTS parts of its pages.
BROADCAST, SALTS = 100_000, 64
#: A host's lines are kept in so many lists by hash, of which one is searched.
LISTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _blank(line: Column) -> Column:
    return ~line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, pages: int = PAGES) -> DataFrame:
    """``host, line``: the xxhash64 of each host's boilerplate lines.

    A host has at most (lines of a page) / ratio of them, on average over its pages.
    Only hashes are shuffled, and counts are summed before each shuffle.
    """
    hashes = F.transform(F.filter(_lines(F.col(text)), lambda x: ~_blank(x)), lambda x: F.xxhash64(x))
    page = docs.where(F.col(text).isNotNull()).select(F.col(host).cast("string").alias("host"), F.xxhash64(text).alias("page"), F.array_distinct(hashes).alias("lines"))
    total = page.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("one").alias("total"))
    pairs = page.select("host", "page", F.explode("lines").alias("line")).groupBy("host", "line", "page").agg(F.lit(1).alias("one"))
    counts = pairs.groupBy("host", "line").agg(F.count("one").alias("n")).where(F.col("n") >= pages)
    joined = counts.alias("c").join(total.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    return joined.where(F.col("n") > ratio * F.col("total")).select("c.host", "line")


def _by_host(bad: DataFrame) -> DataFrame:
    """``host, bad``: a host's lines in LISTS lists by hash, so that a line is looked for in one short list."""
    parts = bad.groupBy("host", F.pmod("line", F.lit(LISTS)).alias("part")).agg(F.collect_set("line").alias("some"))
    by = parts.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("part", "some"))).alias("of"))
    none = F.array().cast("array<bigint>")
    return by.select("host", F.transform(F.sequence(F.lit(0), F.lit(LISTS - 1)), lambda k: F.coalesce(F.try_element_at(F.col("of"), k.cast("long")), none)).alias("bad"))


def drop_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, pages: int = PAGES, counts: tuple[str, str] | None = None) -> DataFrame:
    """docs, with all their columns and in place of ``text`` what is left without their hosts' boilerplate lines.

    counts: names of two more columns, the numbers of lines before and after (columns
    of docs by these names are replaced). A null host is a host of its own; a null text
    stays null and has no lines; blank lines are never boilerplate and stay. A document
    may lose all its lines and then has an empty text; no document is dropped. Repeated
    rows of one host count as one page. An empty table stays empty.
    """
    bad = checkpoint(boilerplate(docs, host, text, ratio, pages))
    h, known, b, salt, left = fresh(docs, "host", "known", "bad", "salt", "left")
    of = _by_host(bad).select(F.coalesce("host", F.lit("")).alias(h), F.col("host").isNotNull().alias(known), F.col("bad").alias(b))
    own = F.col(f"`{host}`").cast("string")
    keyed = docs.withColumns({h: F.coalesce(own, F.lit("")), known: own.isNotNull()})
    if bad.count() <= BROADCAST:
        joined = keyed.join(F.broadcast(of), [h, known], "left")
    else:
        of = of.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn(salt, F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(SALTS)).cast("int")).join(of, [h, known, salt], "left")
    t = F.col(f"`{text}`")
    is_bad = lambda x: F.array_contains(F.element_at(F.col(b), (F.pmod(F.xxhash64(x), F.lit(LISTS)) + 1).cast("int")), F.xxhash64(x))
    joined = joined.withColumn(left, F.when(F.col(b).isNotNull(), F.filter(_lines(t), lambda x: _blank(x) | ~is_bad(x))))
    before = F.when(t.isNull(), 0).otherwise(F.size(_lines(t)))
    after = F.when(F.col(left).isNull(), before).otherwise(F.size(left))
    more = {n: c.cast("long") for n, c in zip(counts or (), (before, after))}
    clean = F.when(F.col(left).isNull(), t).otherwise(F.array_join(left, "\n"))
    out = joined.withColumns(more | {text: clean})
    return out.select(*[f"`{c}`" for c in docs.columns], *[f"`{c}`" for c in more if c not in docs.columns])
