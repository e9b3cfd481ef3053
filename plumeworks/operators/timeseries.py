"""Trajectories and their temporal outliers. Every window is partitioned by vehicle and trajectory."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graphs import cut_lineage
from .rows import fresh, joined_by

#: Rows of a vehicle or trajectory that one task orders; of more, parts of this size are ordered apart.
PART = 1_000_000


def seconds(ts: Column) -> Column:
    """Microseconds since the epoch, in seconds."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def mask_nonpositive(df: DataFrame, value: str) -> DataFrame:
    """Values of 0 and less become null; rows stay."""
    return df.withColumn(value, F.when(F.col(value) > 0, F.col(value)))


def parse_points(df: DataFrame, ts: str, lat: str, lon: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows with a readable time and both coordinates, in the inclusive range if both bounds are given."""
    out = df.withColumn(ts, F.try_to_timestamp(F.col(ts).cast("string"))).dropna(subset=[ts, lat, lon])
    if start is not None and end is not None:
        out = out.where(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return out.withColumn("point", F.struct(F.col(lon).alias("x"), F.col(lat).alias("y")))


def is_hot(df: DataFrame, by: list[str], rows: int) -> bool:
    """Whether any group has more rows than one task should order."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows).limit(1).count() > 0


def parted(df: DataFrame, by: list[str], order: list[str], halo: int, rows: int, part: str, own: str) -> DataFrame:
    """The rows with columns ``part, own``: parts of ``rows`` in the order of groups and ``order``, each with copies (not own) of up to ``halo`` rows before and after it.

    A window by part and group sees for its own rows what one by group sees within
    ``halo`` rows, so that a group of any size is spread over tasks.
    """
    g, c = fresh(df, "g", "c")
    number, place = F.floor(F.col(g) / rows), F.col(g) % rows
    copy = lambda p, mine: F.struct(p.alias(part), F.lit(mine).alias(own))
    copies = F.filter(F.array(copy(number, True), F.when(place < halo, copy(number - 1, False)), F.when(place >= rows - halo, copy(number + 1, False))), lambda x: x.isNotNull())
    return dense_ids(df, [*by, *order], g).withColumn(c, F.explode(copies)).select(*[f"`{n}`" for n in df.columns], f"{c}.*")


def split_by_gaps(df: DataFrame, ts: str, gap_s: float, by: list[str], order: str, out: str = "traj", rows: int = PART) -> DataFrame:
    """Numbers the trajectories of each vehicle from 0; a step longer than the gap begins a new one.

    The first row's step counts as the second's; a single row makes no break. Ties in
    time go by ``order``. If a vehicle has more than ``rows`` rows, all are ordered in
    parts and the breaks of earlier parts are carried on.
    """
    hot = is_hot(df, by, rows)
    part, own, broken, total, carry = fresh(df, "part", "own", "break", "total", "carry")
    of = parted(df, by, [ts, order], 1, rows, part, own) if hot else df
    w = W.partitionBy(*([part] if hot else []), *by).orderBy(ts, order)
    t = seconds(F.col(ts))
    step = F.coalesce(t - F.lag(t).over(w), F.lead(t).over(w) - t)
    breaks = of.withColumn(broken, F.when(step > gap_s, 1).otherwise(0))
    number = F.sum(broken).over(w.rowsBetween(W.unboundedPreceding, 0))
    if not hot:
        return breaks.withColumn(out, number.cast("string")).drop(broken)
    mine = breaks.where(own)
    sums = mine.groupBy(*by, part).agg(F.sum(broken).alias(total))  # a row for each group and part
    earlier = F.sum(total).over(W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    before = sums.withColumn(carry, F.coalesce(earlier, F.lit(0))).drop(total)
    return joined_by(mine.withColumn(out, number), before, [part, *by]).withColumn(out, (F.col(out) + F.col(carry)).cast("string")).drop(broken, carry, part, own)


def hampel(df: DataFrame, value: str, by: list[str], order: list[str], window: int = 31, sensitivity: float = 3.0, out: str = "hampel", rows: int = PART) -> DataFrame:
    """Flags values further from their centred window's median than sensitivity times its MAD; short or holed windows flag nothing. A group of more than ``rows`` rows is done in parts."""
    if window % 2 == 0:
        raise ValueError("a centred window needs an odd number of rows")
    half, hot = window // 2, is_hot(df, by, rows)
    part, own, middle, around, count = fresh(df, "part", "own", "median", "around", "count")
    of = parted(df, by, order, half, max(rows, 2 * half), part, own) if hot else df
    w = W.partitionBy(*([part] if hot else []), *by).orderBy(*order).rowsBetween(-half, half)
    v = F.col(value)
    of = of.withColumns({middle: F.percentile(v, F.lit(0.5)).over(w), around: F.collect_list(v).over(w), count: F.count(v).over(w)})
    away = F.array_sort(F.transform(around, lambda x: F.abs(x - F.col(middle))))
    mad = F.element_at(away, half + 1)
    flagged = of.withColumn(out, F.coalesce((F.col(count) == window) & (F.abs(v - F.col(middle)) > sensitivity * mad), F.lit(False)))
    return (flagged.where(own) if hot else flagged).drop(middle, around, count, part, own)


def group_quantile(df: DataFrame, by: list[str], value: str, quantile: float, out: str, rows: int = PART) -> DataFrame:
    """``<by>, out``: the exact quantile of each group with linear interpolation, as ``percentile`` gives it; null without values.

    If a group has more than ``rows`` values, a mergeable sketch brackets both ranks of
    each group, values below are counted, and only those in the bracket are ordered,
    each different one once; where the sketch misses a rank it is bracketed by all.
    """
    if not is_hot(df, by, rows):
        return df.groupBy(*by).agg(F.percentile(value, F.lit(quantile)).alias(out))
    v, slack = F.col(value), 1e-3
    of = df.where(v.isNotNull())
    ends = of.groupBy(*by).agg(F.percentile_approx(v, F.array(*[F.lit(min(1.0, max(0.0, quantile + e))) for e in (-slack, slack)]), F.lit(10_000)).alias("__e"), F.count(F.lit(1)).alias("__n"))
    ends = ends.withColumns({"__low": F.col("__e")[0], "__high": F.col("__e")[1], "__at": F.lit(quantile) * (F.col("__n") - 1)})

    def ranked(bracket: DataFrame) -> DataFrame:
        joined = joined_by(of.select(*by, v.alias("__v")), bracket, by)
        kept = joined.where("__v <= __high").groupBy(*by, "__n", "__at", F.when(F.col("__v") >= F.col("__low"), F.col("__v")).alias("__v")).agg(F.count(F.lit(1)).alias("__k"))
        upto = F.sum("__k").over(W.partitionBy(*by).orderBy(F.col("__v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
        placed = kept.withColumn("__u", upto).where("__v IS NOT NULL")
        pick = lambda rank: F.min(F.when((F.col("__u") > rank) & (F.col("__u") - F.col("__k") <= rank), F.col("__v")))
        at, low = F.first("__at"), F.floor(F.col("__at"))
        sums = placed.groupBy(*by).agg(pick(low).alias("__a"), pick(F.ceil(F.col("__at"))).alias("__b"), (at - F.floor(at)).alias("__f"))
        return sums.select(*by, F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(F.col("__a") * (1 - F.col("__f")) + F.col("__b") * F.col("__f")).alias(out))

    found = cut_lineage(ranked(ends))
    missed = found.where(F.col(out).isNull()).select(*by)
    if missed.limit(1).count():
        again = joined_by(ends, missed, by, "left_semi").withColumns({"__low": F.lit(float("-inf")), "__high": F.lit(float("inf"))})
        found = found.where(F.col(out).isNotNull()).union(ranked(again))
    return found


def rate_of_change(df: DataFrame, ts: str, value: str, by: list[str], order: str, quantile: float = 0.99, max_gap_s: float = 60, out: str = "roc", rows: int = PART) -> DataFrame:
    """Flags steps of at most max_gap_s whose rate is above their trajectory's quantile of such rates; a step of no time is infinite. A trajectory of more than ``rows`` rows is done in parts."""
    hot = is_hot(df, by, rows)
    part, own, dt, dv, r, q = fresh(df, "part", "own", "dt", "dv", "rate", "limit")
    of = parted(df, by, [ts, order], 1, rows, part, own) if hot else df
    w = W.partitionBy(*([part] if hot else []), *by).orderBy(ts, order)
    t, v = seconds(F.col(ts)), F.col(value)
    of = of.withColumns({dt: t - F.lag(t).over(w), dv: F.abs(v - F.lag(v).over(w))})
    rate = F.when(F.col(dt) == 0, F.when(F.col(dv) > 0, F.lit(float("inf")))).otherwise(F.try_divide(F.col(dv), F.col(dt)))
    of = of.withColumn(r, F.when(F.col(dt) <= max_gap_s, rate))
    if hot:
        of = cut_lineage(of.where(own).drop(part, own))
        limits = group_quantile(of, by, r, quantile, q, rows)
        of = joined_by(of, limits, by, "left")
    else:
        of = of.withColumn(q, F.percentile(F.col(r), F.lit(quantile)).over(W.partitionBy(*by)))
    return of.withColumn(out, F.coalesce(F.col(r) > F.col(q), F.lit(False))).drop(dt, dv, r, q)


def temporal_outliers(df: DataFrame, ts: str, value: str, vehicle: list[str], order: str, gap_s: float = 120, window: int = 31, sensitivity: float = 3.0, quantile: float = 0.99, max_gap_s: float = 60, rows: int = PART) -> DataFrame:
    """The rows with ``traj``, ``hampel``, ``roc`` and ``is_temporal_outlier``; a vehicle or trajectory of more than ``rows`` rows is spread over tasks."""
    of = split_by_gaps(df, ts, gap_s, vehicle, order, rows=rows)
    by = [*vehicle, "traj"]
    of = rate_of_change(hampel(of, value, by, [ts, order], window, sensitivity, rows=rows), ts, value, by, order, quantile, max_gap_s, rows=rows)
    return of.withColumn("is_temporal_outlier", F.col("hampel") | F.col("roc"))


def chunk_sizes(n: int, most: int = 16_000, least: int = 10) -> list[int]:
    """The sizes of the parts that a trajectory of n points is cut into."""
    big = 2 * most / 3
    if n <= most:
        return [n] if n < big else [n // 2, n - n // 2]
    count = math.ceil(n / most)
    out: list[int] = []
    for size in [most] * (count - 1) + [n - most * (count - 1)]:
        if size >= big:
            out += [size // 2, size - size // 2]
        elif size < least and out:
            both = out.pop() + size
            out += [both // 2, both - both // 2] if both >= 2 * least else [both]
        else:
            out.append(size)
    return out


def chunk_ids(df: DataFrame, by: list[str], order: list[str], most: int = 16_000, least: int = 10, out: str = "chunk") -> DataFrame:
    """``<traj>_<i>`` of each row, where chunk_sizes cuts its trajectory; by arithmetic over a row's place and its trajectory's length."""
    w = W.partitionBy(*by)
    rows = df.withColumns({"__i": (F.row_number().over(w.orderBy(*order)) - 1).cast("long"), "__n": F.count("*").over(w)})
    i, n, half = F.col("__i"), F.col("__n"), most // 2
    whole = F.floor((n - 1) / most)  # full parts before the last
    rest = n - whole * most
    one = F.when(3 * n < 2 * most, 0).otherwise((i >= F.floor(n / 2)).cast("long"))
    full = 2 * F.floor(i / most) + (i % most >= half).cast("long")
    at, joined = i - whole * most, most - half + rest  # a short rest goes to the half before it
    after = i - ((whole - 1) * most + half)
    last = F.when(3 * rest >= 2 * most, 2 * whole + (at >= F.floor(rest / 2)).cast("long")).otherwise(2 * whole)
    short = F.when(after < 0, full).when(joined >= 2 * least, 2 * whole - 1 + (after >= F.floor(joined / 2)).cast("long")).otherwise(2 * whole - 1)
    part = F.when(n <= most, one).when(rest < least, short).when(i < whole * most, full).otherwise(last)
    return rows.withColumn(out, F.concat_ws("_", F.col(by[-1]).cast("string"), part.cast("string"))).drop("__i", "__n")


def split_by_date(df: DataFrame, ts: str, path: str) -> None:
    """One folder for each day, which map matching reads on its own."""
    df.withColumn("day", F.to_date(ts)).write.partitionBy("day").parquet(path)


def placed(df: DataFrame, by: str, order: list[Column], out: str) -> DataFrame:
    """A number from 1 in each group's order."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(by).orderBy(*order)))


def dense_ids(df: DataFrame, order: list[str], out: str = "obsID") -> DataFrame:
    """Numbers from 0 in a total order. Ranges are sorted apart and each begins after the rows of those before; one row by range is summed at once."""
    m, p, n, s = fresh(df, "m", "p", "n", "s")
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(m, F.monotonically_increasing_id()))
    part = F.shiftright(m, 33)
    sizes = placed.groupBy(part.alias(p)).agg(F.count("*").alias(n))
    starts = sizes.select(p, (F.sum(n).over(W.orderBy(p)) - F.col(n)).alias(s))
    return placed.withColumn(p, part).join(F.broadcast(starts), p).withColumn(out, F.col(s) + F.col(m).bitwiseAND(F.lit((1 << 33) - 1))).drop(p, m, s)


def hourly_boxes(df: DataFrame, ts: str, value: str, rows: int = PART) -> DataFrame:
    """Quartiles and whiskers (the extreme values within 1.5 IQR) by hour of day; of more than ``rows`` values in an hour by sketch and bracket."""
    q = df.withColumn("hour", F.hour(ts)).where(F.col(value).isNotNull())
    if is_hot(q, ["hour"], rows):
        a, b, c = (group_quantile(q, ["hour"], value, at, f"p{k}", rows) for k, at in enumerate((0.25, 0.5, 0.75)))
        box = a.join(b, "hour").join(c, "hour").select("hour", F.array("p0", "p1", "p2").alias("p"))
    else:
        box = q.groupBy("hour").agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"))
    iqr = F.col("p")[2] - F.col("p")[0]
    inside = F.col(value).between(F.col("p")[0] - 1.5 * iqr, F.col("p")[2] + 1.5 * iqr)
    return q.join(F.broadcast(box), "hour").groupBy("hour").agg(F.first("p")[0].alias("q1"), F.first("p")[1].alias("median"), F.first("p")[2].alias("q3"), F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"))


def hour_by_month(df: DataFrame, ts: str, value: str, months: list[str]) -> DataFrame:
    """Mean value by hour of day, a column for each year and month."""
    return df.withColumns({"hour": F.hour(ts), "month": F.date_format(ts, "yyyy-MM")}).groupBy("hour").pivot("month", months).agg(F.avg(value))


def daily_medians(df: DataFrame, ts: str, value: str, rows: int = 5) -> DataFrame:
    """``day, median, smooth``: the median of hourly medians, and its mean over the last rows (days present).

    The last window has one row for each day of the study, so that it stays small.
    """
    hourly = df.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.median(value).alias("m")).where(F.col("m").isNotNull())
    daily = hourly.groupBy(F.to_date("hour").alias("day")).agg(F.median("m").alias("median"))
    return daily.withColumn("smooth", F.avg("median").over(W.orderBy("day").rowsBetween(-(rows - 1), 0)))
