"""All registered queries over the driver's tables, and the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import projection
from ..functions import strings as S
from ..operators import covariates as C
from ..operators import figures, graphs, nodes, outliers, roads, spatial, stats, traffic, units
from ..operators import timeseries as T
from ..sources.files import table
from .stand_ins import LINES, NETWORK, POINTS, SQUARES, UNITS, districts, lines, network, points, squares
from .stand_ins import units as unit_points

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
R = 5
GAP = 7200
HEX = 2500.0


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, R) for n in names})


# points and time series

@query(f"WITH {POINTS} SELECT event_id, event_id AS obs_id, CASE WHEN value - 5 > 0 THEN round(value - 5, 5) END AS v, round(x, 5) AS x FROM p WHERE ts BETWEEN '2024-01-03' AND '2024-01-20'")
def f1_f5_air_points(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf).withColumns({"lat": F.col("y"), "lon": F.col("x"), "v": F.col("value") - 5.0})
    p = T.mask_nonpositive(T.parse_points(p, "ts", "lat", "lon", "2024-01-03", "2024-01-20"), "v")
    return rounded(p.select("event_id", F.col("event_id").alias("obs_id"), "v", F.col("point.x").alias("x")), "v", "x")


_SPLIT = f"""{POINTS}, d AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER o), epoch_us(lead(ts) OVER o) - epoch_us(ts)) / 1e6 AS step FROM p WINDOW o AS (PARTITION BY event_type ORDER BY ts, event_id)),
t AS (SELECT *, (sum(CASE WHEN step > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT::VARCHAR AS traj FROM d)"""
_FLAGS = f"""{_SPLIT}, r AS (SELECT *, epoch_us(ts) / 1e6 - lag(epoch_us(ts)) OVER o / 1e6 AS dt, abs(value - lag(value) OVER o) AS dv, median(value) OVER h AS m, list(value) OVER h AS a, count(value) OVER h AS n FROM t
 WINDOW o AS (PARTITION BY event_type, traj ORDER BY ts, event_id), h AS (PARTITION BY event_type, traj ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
s AS (SELECT *, CASE WHEN dt <= 900 THEN CASE WHEN dt = 0 THEN CASE WHEN dv > 0 THEN 'inf'::DOUBLE END ELSE dv / dt END END AS rate FROM r),
q AS (SELECT event_type, traj, quantile_cont(rate, 0.99) AS lim FROM s GROUP BY ALL),
f AS (SELECT s.*, coalesce(n = 7 AND abs(value - m) > 3 * list_median(list_transform(a, lambda z: abs(z - m))), false) AS hampel, coalesce(rate > lim, false) AS roc FROM s JOIN q USING (event_type, traj))"""
_FLAGS = _FLAGS.replace("list_median(", "list_aggregate(").replace("abs(z - m)))", "abs(z - m)), 'median')")


@query(f"WITH {_SPLIT} SELECT event_id, traj FROM t")
def w1_split_by_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return T.split_by_gaps(points(spark, sf), "ts", GAP, ["event_type"], "event_id").select("event_id", "traj")


@query(f"WITH {_FLAGS} SELECT event_id, hampel, roc, hampel OR roc AS is_temporal_outlier FROM f")
def w2_w5_temporal_outliers(spark: SparkSession, sf: str) -> DataFrame:
    of = T.temporal_outliers(points(spark, sf), "ts", "value", ["event_type"], "event_id", GAP, 7, 3.0, 0.99, 900)
    return of.select("event_id", "hampel", "roc", "is_temporal_outlier")


@query(f"""WITH {_SPLIT}, n AS (SELECT event_type, traj, count(*) AS n FROM t GROUP BY ALL), k AS (SELECT t.event_id, t.traj, n, row_number() OVER (PARTITION BY t.event_type, t.traj ORDER BY ts, event_id) AS i FROM t JOIN n USING (event_type, traj)),
z AS (SELECT event_id, traj, n, i, ceil(n / 300.0)::BIGINT AS c FROM k)
SELECT event_id, traj || '_' || (CASE WHEN n < 200 THEN 0 WHEN n <= 300 THEN CASE WHEN i <= n // 2 THEN 0 ELSE 1 END
 ELSE CASE WHEN i <= 300 * (c - 1) THEN 2 * ((i - 1) // 300) + CASE WHEN (i - 1) % 300 < 150 THEN 0 ELSE 1 END
  WHEN n - 300 * (c - 1) >= 200 THEN 2 * (c - 1) + CASE WHEN i - 300 * (c - 1) <= (n - 300 * (c - 1)) // 2 THEN 0 ELSE 1 END
  ELSE 2 * (c - 1) END END)::BIGINT::VARCHAR AS chunk FROM z""")
def w6_chunks(spark: SparkSession, sf: str) -> DataFrame:
    of = T.split_by_gaps(points(spark, sf), "ts", GAP, ["event_type"], "event_id")
    return T.chunk_ids(of, ["event_type", "traj"], ["ts", "event_id"], 300, 1).select("event_id", "chunk")


@query("""WITH q AS (SELECT hour(ts)::INTEGER AS hour, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT q.hour, round(q1, 5) AS q1, round(q.median, 5) AS median, round(q3, 5) AS q3, round(min(value), 5) AS low, round(max(value), 5) AS high FROM events e JOIN q ON hour(e.ts) = q.hour WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""")
def w7_hourly_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.hourly_boxes(points(spark, sf), "ts", "value"), "q1", "median", "q3", "low", "high")


@query("SELECT hour(ts)::INTEGER AS hour, round(avg(value) FILTER (strftime(ts, '%Y-%m') = '2024-01'), 5) AS \"2024-01\", round(avg(value) FILTER (strftime(ts, '%Y-%m') = '2024-02'), 5) AS \"2024-02\" FROM events GROUP BY 1")
def w8_hour_by_month(spark: SparkSession, sf: str) -> DataFrame:
    of = T.hour_by_month(points(spark, sf), "ts", "value", ["2024-01", "2024-02"])
    return of.select("hour", *[F.round(f"`{m}`", R).alias(m) for m in ("2024-01", "2024-02")])


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS h, median(value) AS m FROM events GROUP BY 1), d AS (SELECT h::DATE AS day, median(m) AS m FROM h GROUP BY 1)
SELECT day::VARCHAR AS day, round(m, 5) AS median, round(avg(m) OVER (ORDER BY day ROWS 4 PRECEDING), 5) AS smooth FROM d""")
def w9_w10_daily_medians(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.daily_medians(points(spark, sf), "ts", "value").withColumn("day", F.col("day").cast("string")), "median", "smooth")


# units

_HEX = f"""{POINTS}, a AS (SELECT *, (sqrt(3::DOUBLE) / 3 * x - y / 3) / {HEX} AS q, (2::DOUBLE / 3 * y) / {HEX} AS r FROM p), b AS (SELECT *, -q - r AS s, floor(q + 0.5) AS rq, floor(r + 0.5) AS rr, floor(-q - r + 0.5) AS rs FROM a),
c AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM b),
g AS (SELECT *, (CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END)::BIGINT || ':' || (CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END)::BIGINT AS hex FROM c)"""


def _hexed(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).withColumn("hex", G.hex_cell(F.col("x"), F.col("y"), HEX))


@query(f"WITH {_HEX} SELECT event_id, hex FROM g")
def j2_hex_of_point(spark: SparkSession, sf: str) -> DataFrame:
    return _hexed(spark, sf).select("event_id", "hex")


@query(f"WITH {_HEX}, d AS (SELECT hex, ts::DATE AS day, avg(value) AS m FROM g GROUP BY ALL) SELECT hex, round(avg(m), 5) AS value FROM d GROUP BY hex")
def a1_typical_day(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(units.typical_day_mean(_hexed(spark, sf), "hex", "ts", "value"), "value")


@query(f"WITH {_HEX}, n AS (SELECT hex, count(value) AS n_obs FROM g GROUP BY hex) SELECT hex, n_obs, round(100.0::DOUBLE * n_obs / sum(n_obs) OVER (), 5) AS pct FROM n")
def a3_observation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(units.observation_counts(_hexed(spark, sf), "hex", "value"), "pct")


@query(f"WITH {_HEX}, n AS (SELECT hex, count(value) AS n FROM g GROUP BY hex) SELECT event_id, hex FROM g WHERE hex IN (SELECT hex FROM n WHERE n > (SELECT quantile_cont(n, 0.25) FROM n))")
def a4_well_sampled(spark: SparkSession, sf: str) -> DataFrame:
    return units.well_sampled(_hexed(spark, sf), "hex", "value", 0.25).select("event_id", "hex")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def a29_first_rows(spark: SparkSession, sf: str) -> DataFrame:
    return units.first_rows(points(spark, sf), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


def flagship(spark: SparkSession, sf: str, gap: float = GAP) -> DataFrame:
    """Masked points without temporal outliers, in hexagons with enough of them, as typical-day means."""
    p = T.mask_nonpositive(points(spark, sf), "value")
    clean = T.temporal_outliers(p, "ts", "value", ["event_type"], "event_id", gap, 7, 3.0, 0.99, 900).where(~F.col("is_temporal_outlier"))
    of = clean.withColumn("hex", G.hex_cell(F.col("x"), F.col("y"), HEX))
    return rounded(units.typical_day_mean(units.well_sampled(of, "hex", "value", 0.1), "hex", "ts", "value"), "value")


@query(f"""WITH {_FLAGS.replace(POINTS, _HEX.replace('p AS', 'p0 AS').replace('FROM p)', 'FROM p0)') + ', p AS (SELECT event_id, ts, user_id, event_type, value, hex FROM g)')},
n AS (SELECT hex, count(value) AS n FROM f WHERE NOT (hampel OR roc) GROUP BY hex), dd AS (SELECT hex, ts::DATE AS day, avg(value) AS m FROM f WHERE NOT (hampel OR roc) AND hex IN (SELECT hex FROM n WHERE n > (SELECT quantile_cont(n, 0.1) FROM n)) GROUP BY ALL)
SELECT hex, round(avg(m), 5) AS value FROM dd GROUP BY hex""")
def a2_units_of_clean_points(spark: SparkSession, sf: str) -> DataFrame:
    return flagship(spark, sf)


# traffic

@query("SELECT event_id FROM events WHERE ts BETWEEN '2024-01-05' AND '2024-01-25' AND hour(ts) >= 0 AND hour(ts) < 9 AND isodow(ts) < 6")
def f6_f8_time_filters(spark: SparkSession, sf: str) -> DataFrame:
    return traffic.time_filters(points(spark, sf), "ts", "2024-01-05", "2024-01-25", 0, 9, weekday=True).select("event_id")


@query("WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem) SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem, q WHERE l_extendedprice > lo AND l_extendedprice < hi")
def f9_quantile_trim(spark: SparkSession, sf: str) -> DataFrame:
    return traffic.quantile_trim(table(spark, sf, "lineitem").select("l_extendedprice"), "l_extendedprice").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT date_trunc('hour', l_shipdate) AS hour, l_suppkey, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL")
def a5_hourly_sums(spark: SparkSession, sf: str) -> DataFrame:
    return traffic.hourly_sums(table(spark, sf, "lineitem"), "l_shipdate", "l_suppkey", "l_quantity")


@query("SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING avg((l_discount = 0)::INT) > 0.05")
def a6_faulty_sites(spark: SparkSession, sf: str) -> DataFrame:
    return traffic.faulty_sites(table(spark, sf, "lineitem"), "l_suppkey", "l_discount", 0.05)


_SITES = """h AS (SELECT date_trunc('hour', l_shipdate) AS hour, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), z AS (SELECT l_suppkey FROM h GROUP BY 1 HAVING avg((q = 0)::INT) > 0.8),
k AS (SELECT * FROM h WHERE l_suppkey NOT IN (SELECT l_suppkey FROM z)), b AS (SELECT quantile_cont(q, 0.01) AS lo, quantile_cont(q, 0.99) AS hi FROM k), s AS (SELECT l_suppkey, avg(q) AS avg_traffic FROM k, b WHERE q > lo AND q < hi GROUP BY 1)"""


def _sites(spark: SparkSession, sf: str) -> DataFrame:
    return traffic.site_means(table(spark, sf, "lineitem"), "l_shipdate", "l_suppkey", "l_quantity")


@query(f"WITH {_SITES} SELECT l_suppkey, round(avg_traffic, 5) AS avg_traffic FROM s")
def a7_site_means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_sites(spark, sf), "avg_traffic")


@query(f"WITH {_SITES} SELECT l_suppkey, s_nationkey, round(avg_traffic, 5) AS avg_traffic FROM s JOIN supplier ON s_suppkey = l_suppkey")
def j9_georeference(spark: SparkSession, sf: str) -> DataFrame:
    places = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return rounded(traffic.with_places(_sites(spark, sf), places, "l_suppkey"), "avg_traffic")


_UNITS = "units_(n_nationkey, x, y) AS (SELECT n_nationkey, (n_nationkey % 5)::DOUBLE, (n_nationkey // 5)::DOUBLE FROM nation UNION ALL SELECT r_regionkey + 100, r_regionkey::DOUBLE, 6 FROM region)"


def _units(spark: SparkSession, sf: str) -> DataFrame:
    """Nations and, as units that nothing lies in, regions."""
    n = table(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") % 5).cast("double").alias("x"), F.floor(F.col("n_nationkey") / 5).cast("double").alias("y"))
    return n.union(table(spark, sf, "region").select(F.col("r_regionkey") + 100, F.col("r_regionkey").cast("double"), F.lit(6.0)))


@query(f"""WITH {_SITES}, {_UNITS}, a AS (SELECT n_nationkey, x, y, avg(avg_traffic) AS v FROM units_ LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN s ON s_suppkey = l_suppkey GROUP BY ALL),
d AS (SELECT u.n_nationkey, k.v, greatest(sqrt((u.x - k.x) * (u.x - k.x) + (u.y - k.y) * (u.y - k.y)), 1e-12) AS d, k.n_nationkey AS o FROM a u JOIN a k ON u.v IS NULL AND k.v IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY d, o) AS r FROM d), i AS (SELECT n_nationkey, sum(v / (d * d)) / sum(1 / (d * d)) AS w FROM r WHERE r <= 5 GROUP BY 1)
SELECT a.n_nationkey, round(v, 5) AS avg_traffic, round(coalesce(v, w), 5) AS avg_traffic_idw FROM a LEFT JOIN i USING (n_nationkey)""")
def a9_g4_traffic_to_units(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").alias("l_suppkey")).join(_sites(spark, sf), "l_suppkey")
    return rounded(nodes.traffic_by_unit(s, _units(spark, sf), "n_nationkey", "x", "y", "avg_traffic"), "avg_traffic", "avg_traffic_idw")


@query("SELECT l_suppkey AS site, l_returnflag AS place, round(avg(l_quantity), 5) AS avg_traffic FROM lineitem WHERE l_shipdate BETWEEN '1994-01-01' AND '1997-12-31' AND isodow(l_shipdate) < 6 GROUP BY ALL")
def a8_aggregated_traffic(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("site"), F.col("l_returnflag").alias("place"), "l_shipdate", "l_quantity")
    return rounded(traffic.aggregated_sites(li, "l_shipdate", "site", "place", "l_quantity", start_day="1994-01-01", end_day="1997-12-31", weekday=True), "avg_traffic")


# covariates

@query(f"WITH {_UNITS} SELECT n_nationkey, round(avg(c_custkey), 5) AS compactness, round(coalesce(sum(c_acctbal), 0), 2) AS build_cover_area, round(coalesce(sum(c_acctbal), 0), 2) AS total_trees_area, count(*) AS count_trees, round(100 * coalesce(sum(c_acctbal), 0) / 700, 2) AS canopy_cover FROM units_ LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def a10_a11_unit_sums(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").alias("compactness"), F.col("c_acctbal").alias("footprint_area"))
    u = _units(spark, sf).withColumn("area", F.lit(700.0))
    b = rounded(nodes.buildings_by_unit(c, u, "n_nationkey", ["compactness"]), "compactness")
    t = nodes.trees_by_unit(c, u, "n_nationkey", "footprint_area", "area")
    return b.join(t, "n_nationkey").withColumns({n: F.round(n, 2) for n in ("build_cover_area", "total_trees_area", "canopy_cover")})


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("SELECT p_brand, " + ", ".join(f"coalesce(sum(p_size) FILTER (p_type = '{t}'), 0)::BIGINT AS {t}" for t in _TYPES) + " FROM part GROUP BY 1")
def a12_a13_pivot_sum(spark: SparkSession, sf: str) -> DataFrame:
    return C.pivot_sum(table(spark, sf, "part"), "p_brand", "p_type", "p_size", _TYPES)


@query("WITH a AS (SELECT p_brand, sum(p_retailprice) AS area, " + ", ".join(f"coalesce(sum(p_size) FILTER (p_type = '{t}'), 0) AS {t}" for t in _TYPES) + " FROM part GROUP BY 1) SELECT p_brand, " + ", ".join(f"round(100.0::DOUBLE * {t} / area, 5) AS {t.lower()}" for t in _TYPES) + " FROM a")
def a14_landuse_shares(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumn("kind", S.class_name(F.col("p_type")))
    names = [S.column_name(t) for t in _TYPES]
    total = p.groupBy("p_brand").agg(F.sum("p_retailprice").alias("total"))
    return rounded(nodes.landuse_by_unit(p, "p_brand", "kind", "p_size", total, names), *names)


@query("SELECT o_orderpriority AS unit, round(q, 5) AS density FROM (SELECT o_orderpriority, sum(o_totalprice) / (count(*) / 1e6::DOUBLE) AS q FROM orders GROUP BY 1)")
def a15_a16_density(spark: SparkSession, sf: str) -> DataFrame:
    of = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("unit")).agg(F.sum("o_totalprice").alias("l"), F.count("*").alias("a"))
    return of.select("unit", F.round(nodes.density(F.col("l"), F.col("a") / 1e6), R).alias("density"))


@query("""WITH a AS (SELECT c_nationkey AS k, round(avg(c_acctbal), 5) AS a FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, round(avg(s_acctbal), 5) AS b FROM supplier GROUP BY 1), c AS (SELECT n_nationkey AS k, n_regionkey AS c FROM nation UNION ALL SELECT r_regionkey + 100, r_regionkey FROM region)
SELECT k, a, b, c FROM a FULL JOIN b USING (k) FULL JOIN c USING (k) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL""")
def j10_f16_merge_units(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.avg("c_acctbal"), R).alias("a"))
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.avg("s_acctbal"), R).alias("b"), F.lit(1).alias("a"))
    c = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("c")).union(table(spark, sf, "region").select(F.col("r_regionkey") + 100, "r_regionkey"))
    return C.merge_units([a, b, c], "k")


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 5) AS r FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]))
def a25_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.correlation_table(table(spark, sf, "lineitem"), _NUM), "r")


@query("SELECT round(min(l_quantity), 2) AS low, round(max(l_quantity), 2) AS high, round(avg(l_quantity), 2) AS mean, round(median(l_quantity), 2) AS mid, round(stddev_pop(l_quantity), 5) AS sd, round(stddev_samp(l_quantity) / abs(avg(l_quantity)), 5) AS cv FROM lineitem")
def a23_a26_a32_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(nodes.summary(table(spark, sf, "lineitem"), "l_quantity"), "sd", "cv")


@query("SELECT 'l_quantity' AS name, least(30, floor((l_quantity - a) / ((b - a) / 30)) + 1)::BIGINT AS bin, count(*) AS n FROM lineitem, (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem) GROUP BY ALL UNION ALL SELECT 'l_tax', least(30, floor((l_tax - a) / ((b - a) / 30)) + 1)::BIGINT, count(*) FROM lineitem, (SELECT min(l_tax) AS a, max(l_tax) AS b FROM lineitem) GROUP BY ALL")
def v12_variable_distributions(spark: SparkSession, sf: str) -> DataFrame:
    return figures.variable_distributions(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"], 30)


@query(f"WITH {UNITS}, q AS (SELECT quantile_cont(v, [0.2, 0.4, 0.6, 0.8]) AS q, quantile_cont(w, [0.2, 0.4, 0.6, 0.8]) AS r FROM u) SELECT id, len(list_filter(q, lambda b: b < v))::INTEGER AS traffic_class, len(list_filter(r, lambda b: b < w))::INTEGER AS value_class FROM u, q")
def v10_traffic_and_value(spark: SparkSession, sf: str) -> DataFrame:
    return figures.traffic_and_value(unit_points(spark, sf), "id", "v", "w")


@query(f"WITH {_HEX}, n AS (SELECT hex, count(value) AS n_obs FROM g GROUP BY hex), cc AS (SELECT hex, n_obs, 100.0::DOUBLE * n_obs / sum(n_obs) OVER () AS pct FROM n) SELECT 'n_obs' AS name, round(min(n_obs), 4)::DOUBLE AS low, round(max(n_obs), 4)::DOUBLE AS high, round(median(n_obs), 4) AS mid, round(avg(n_obs), 4) AS mean FROM cc UNION ALL SELECT 'pct', round(min(pct), 4), round(max(pct), 4), round(median(pct), 4), round(avg(pct), 4) FROM cc")
def v3_a24_sampling(spark: SparkSession, sf: str) -> DataFrame:
    return figures.sampling(_hexed(spark, sf), "hex", "value")[2].withColumns({n: F.col(n).cast("double") for n in ("low", "high", "mid", "mean")})


@query(f"WITH {_HEX}, k AS (SELECT *, event_id % 3 = 0 AS is_temporal_outlier, event_id % 5 = 0 AS is_spatial_outlier, event_id % 15 = 0 AS is_spatiotemp_outlier FROM g) " + " UNION ALL ".join(f"SELECT '{f}' AS flag, hex, count(*) AS n FROM k WHERE {f} GROUP BY hex" for f in figures.FLAGS))
def v1_outlier_bins(spark: SparkSession, sf: str) -> DataFrame:
    e = points(spark, sf)
    _, flagged = outliers.combine(e, "event_id", e.where("event_id % 3 = 0"), e.where("event_id % 5 = 0"))
    return figures.outlier_bins(flagged, "x", "y", HEX)[0]


@query("WITH b AS (SELECT min(value) AS a, max(value) AS b FROM events) SELECT least(40, floor((value - a) / ((b - a) / 40)) + 1)::BIGINT AS bin, count(*) AS n FROM events, b GROUP BY 1")
def v2_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return C.histogram(table(spark, sf, "events"), "value", 40)


@query(f"WITH {UNITS}, q AS (SELECT quantile_cont(v, [0.2, 0.4, 0.6, 0.8]) AS q FROM u) SELECT id, len(list_filter(q, lambda b: b < v))::INTEGER AS class FROM u, q")
def v5_quantile_classes(spark: SparkSession, sf: str) -> DataFrame:
    return stats.quantile_classes(unit_points(spark, sf), "v", 5).select("id", "class")


@query(f"WITH {UNITS}, q AS (SELECT median(v) AS m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS i, avg(w) AS a, stddev_pop(w) AS s FROM u) SELECT id, round((v - m) / i, 5) AS v, round((w - a) / s, 5) AS w FROM u, q")
def t1_t13_scaling(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.z_scores(outliers.robust_scale(unit_points(spark, sf), ["v"]), ["w"]).select("id", "v", "w"), "v", "w")


@query()
def t10_t11_selected_covariates(spark: SparkSession, sf: str) -> DataFrame:
    of = table(spark, sf, "lineitem").select(*_NUM, (F.col("l_quantity") * 2 + F.col("l_tax")).alias("twin"))
    kept = C.select_covariates(of, "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "twin"], 0.0, 0.5, 0.1)
    return spark.createDataFrame([(c, c in kept, c in C.reduce_multicollinearity(of, ["l_quantity", "twin", "l_tax"])) for c in ("l_quantity", "l_discount", "l_tax", "twin")], "name string, kept boolean, after_vif boolean")


# sets

@query("SELECT event_id, event_id % 3 = 0 AS t, event_id % 5 = 0 AS s, event_id % 15 = 0 AS both FROM events WHERE event_id % 3 = 0 OR event_id % 5 = 0")
def u2_u3_t3_combined_outliers(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id")
    _, flagged = outliers.combine(e, "event_id", e.where("event_id % 3 = 0"), e.where("event_id % 5 = 0"))
    return flagged.select("event_id", F.col("is_temporal_outlier").alias("t"), F.col("is_spatial_outlier").alias("s"), F.col("is_spatiotemp_outlier").alias("both"))


@query("SELECT event_id FROM events WHERE event_id % 15 <> 0")
def u4_j15_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id")
    return outliers.combine(e, "event_id", e.where("event_id % 3 = 0"), e.where("event_id % 5 = 0"))[0]


@query("SELECT c_custkey AS k, c_acctbal AS bal, NULL::VARCHAR AS name FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def u1_union(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    return a.unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), allowMissingColumns=True)


# strings and lists

def _case(column: str) -> str:
    """The name without punctuation, directions and words of road types; written out here so that the lists are checked too."""
    plain = f"regexp_split_to_array(regexp_replace(lower({column}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+')"
    return f"array_to_string(list_filter({plain}, lambda w: w NOT IN ('', 'upper', 'lower', 'street', 'st', 'road', 'rd', 'square', 'ave', 'avenue', 'drive')), ' ')"


@query(f"SELECT p_partkey, {_case(chr(39) + 'Upper St. ' + chr(39) + ' || p_name || ' + chr(39) + ' Ave. Boulevard' + chr(39))} AS name FROM part")
def x1_x2_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", S.remove_words(S.standardize_name(F.concat(F.lit("Upper St. "), "p_name", F.lit(" Ave. Blvd")))).alias("name"))


@query(f"SELECT p_type, array_to_string(list_sort(list_distinct(list({_case('p_name')}))), ',') AS names FROM part GROUP BY 1")
def x3_a19_name_lists(spark: SparkSession, sf: str) -> DataFrame:
    return nodes.names_by(table(spark, sf, "part"), "p_type", S.road_names(F.array("p_name"))).select("p_type", F.array_join("names", ",").alias("names"))


@query("SELECT o_orderkey, o_orderkey % 5 IN (1, 2, 3, 4) AS bridge, o_orderkey % 3 IN (1, 2) AS tunnel, CASE WHEN o_orderkey % 2 = 0 THEN 3 END::BIGINT AS max_lanes, CASE WHEN o_orderkey % 2 = 0 THEN 2 END::BIGINT AS min_lanes, 50::BIGINT AS max_speed, 30::BIGINT AS min_speed, 'primary' AS highway, CASE o_orderkey % 2 WHEN 0 THEN 'patricks' ELSE 'abbey,patricks' END AS names FROM orders")
def x10_tag_columns(spark: SparkSession, sf: str) -> DataFrame:
    k, pick = F.col("o_orderkey"), lambda n, *v: F.array(F.element_at(F.array(*map(F.lit, v)), (F.col("o_orderkey") % n + 1).cast("int")))
    of = table(spark, sf, "orders").select("o_orderkey", pick(5, "no", "yes", "movable", "viaduct", "aqueduct").alias("bridge"), pick(3, "no", "yes", "building_passage").alias("tunnel"), F.when(k % 2 == 0, F.array(F.lit("2"), F.lit("3"))).otherwise(F.array(F.lit("many"))).alias("lanes"), F.array(F.lit("30 mph"), F.lit("signals"), F.lit("50")).alias("maxspeed"), F.array(F.lit("unclassified"), F.lit("primary")).alias("highway"), F.when(k % 2 == 0, F.array(F.lit("Upper St. Patrick's Ave."))).otherwise(F.array(F.lit("Patrick's Rd"), F.lit("Abbey Square"))).alias("name"))
    out = roads.tag_columns(of)
    return out.select("o_orderkey", "bridge", "tunnel", "max_lanes", "min_lanes", "max_speed", "min_speed", F.array_join("highway", ",").alias("highway"), F.array_join("names", ",").alias("names"))


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_retailprice::VARCHAR WHEN 2 THEN 'None' ELSE p_size || ' mph' END AS t FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'float' WHEN 2 THEN 'null' ELSE 'string' END AS kind, CASE WHEN p_partkey % 4 IN (0, 3) THEN regexp_extract(t, '^\\d+')::BIGINT END AS num FROM t""")
def x4_x5_x12_typed(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    t = F.when(k == 0, F.col("p_size").cast("string")).when(k == 1, F.col("p_retailprice").cast("string")).when(k == 2, "None").otherwise(F.concat("p_size", F.lit(" mph")))
    return table(spark, sf, "part").withColumn("t", t).select("p_partkey", S.typed(F.col("t")).alias("kind"), S.largest(S.integers(F.col("t"))).alias("num"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'major_road' ELSE 'low_access' END AS class, o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS bridge, CASE WHEN o_orderkey % 3 = 0 THEN 'primary_link' ELSE 'residential' END AS tags FROM orders""")
def x8_x9_x13_road_class(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    h = F.array(F.when(k % 3 == 0, "primary_link").otherwise("residential"), F.lit("unclassified"))
    b = F.array(F.when((k % 3 == 0) & (k % 2 == 0), "viaduct").otherwise("no"))
    clean = S.without_unclassified(h)
    return table(spark, sf, "orders").select("o_orderkey", S.road_class(clean).alias("class"), S.any_in(b, ["yes", "viaduct"]).alias("bridge"), F.array_join(clean, ",").alias("tags"))


@query("SELECT vec_id, round_even(embedding[1]::DOUBLE, 3) + 0 AS x FROM embeddings")
def x14_round_point(spark: SparkSession, sf: str) -> DataFrame:
    return unit_points(spark, sf).select(F.col("id").alias("vec_id"), (S.round_half_even(F.col("x"), 3) + 0.0).alias("x"))


@query("SELECT event_id, hour(ts)::INTEGER AS hour, ts::DATE::VARCHAR AS day, (isodow(ts) - 1)::INTEGER AS weekday, date_trunc('hour', ts) AS floor, strftime(ts, '%Y-%m') AS month, strptime(strftime(ts, '%Y%m%d%H%M%S'), '%Y%m%d%H%M%S') AS parsed FROM events")
def x15_x17_dates(spark: SparkSession, sf: str) -> DataFrame:
    of = nodes.date_parts(table(spark, sf, "events"), "ts")
    return of.select("event_id", "hour", "day", "weekday", "floor", "month", nodes.parsed_time(F.date_format("ts", "yyyyMMddHHmmss"), "yyyyMMddHHmmss").alias("parsed"))


@query("SELECT o_custkey, bool_and(o_orderkey % 2 = 0) AS oneway, bool_or(o_orderkey % 7 = 0) AS bridge, bool_or(o_orderkey % 11 = 0) AS tunnel, max(o_orderkey % 5)::BIGINT AS max_lanes, min(o_orderkey % 5)::BIGINT AS min_lanes, max(o_orderkey % 9)::BIGINT AS max_speed, min(o_orderkey % 9)::BIGINT AS min_speed, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS names FROM orders GROUP BY 1")
def a18_a21_tag_merging(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    of = table(spark, sf, "orders").select("o_custkey", (k % 5).alias("max_lanes"), (k % 5).alias("min_lanes"), (k % 9).alias("max_speed"), (k % 9).alias("min_speed"), F.array("o_orderpriority").alias("names"), F.array(F.lit("primary")).alias("highway"), (k % 2 == 0).alias("oneway"), (k % 11 == 0).alias("tunnel"), (k % 7 == 0).alias("bridge"))
    return roads.merged_tags(of, "o_custkey").withColumn("names", F.array_join("names", ",")).drop("highway")


@query("SELECT o_orderpriority AS unit, coalesce(sum(o_totalprice) FILTER (o_orderkey % 4 IN (1, 2)), 0) AS low_access, coalesce(sum(o_totalprice) FILTER (o_orderkey % 4 = 3), 0) AS major_road FROM orders GROUP BY 1".replace("coalesce(", "round(coalesce(").replace(", 0) AS", ", 0), 2) AS"))
def g20_road_class_lengths(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    tag = F.when(k == 1, F.array(F.lit("residential"))).when(k == 2, F.array(F.lit("service"), F.lit("living_street"))).when(k == 3, F.array(F.lit("trunk_link"), F.lit("service")))
    of = nodes.road_class_lengths(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("unit"), "o_totalprice", tag.alias("highway")), "unit", "o_totalprice")
    return of.select("unit", F.round("low_access", 2).alias("low_access"), F.round("major_road", 2).alias("major_road"))


# spatial

@query(f"WITH {POINTS}, d AS (SELECT i AS district, (i % 5) * 3900.0::DOUBLE + 100 AS a, (i // 5) * 3800.0::DOUBLE + 100 AS b FROM range(20) r(i)) SELECT event_id, district FROM p JOIN d ON x >= a AND x < a + 3900 AND y >= b AND y < b + 3800")
def j1_points_in_polygons(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.within(points(spark, sf), districts(spark), "x", "y", "ring", 2000.0).select("event_id", "district")


@query(f"""WITH {POINTS}, d AS (SELECT i AS district, (i % 5) * 3900.0::DOUBLE + 100 AS a, (i // 5) * 3800.0::DOUBLE + 100 AS b FROM range(20) r(i)) SELECT district, count(event_id) AS n, round(avg(value), 5) AS value FROM d LEFT JOIN p ON x >= a AND x < a + 3900 AND y >= b AND y < b + 3800 GROUP BY 1""")
def j5_j7_units_with_points(spark: SparkSession, sf: str) -> DataFrame:
    of = nodes.points_by_unit(points(spark, sf), districts(spark), "district", "x", "y", "ring", 2000.0, ["event_id", "value"])
    return rounded(of.groupBy("district").agg(F.count("event_id").alias("n"), F.avg("value").alias("value")), "value")


_DISTRICTS = "d AS (SELECT i AS district, (i % 5) * 3900.0::DOUBLE + 100 AS a, (i // 5) * 3800.0::DOUBLE + 100 AS b FROM range(20) r(i))"


@query(f"WITH {POINTS}, {_DISTRICTS}, m AS (SELECT district, ts::DATE AS day, avg(value) AS m FROM p JOIN d ON x >= a AND x < a + 3900 AND y >= b AND y < b + 3800 GROUP BY ALL) SELECT district, round(avg(m), 5) AS value FROM m GROUP BY 1")
def a2_districts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(nodes.aggregate_to_units(points(spark, sf), "district", "ts", "value", size=2000.0, shapes=districts(spark), key="district"), "value")


@query(f"WITH {SQUARES} SELECT l.id AS a, r.id AS b FROM q l JOIN q r ON l.id < r.id AND l.x <= r.x + r.s AND r.x <= l.x + l.s AND l.y <= r.y + r.s AND r.y <= l.y + l.s")
def g6_j19_unit_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Squares of suppliers; some lie inside others."""
    return roads.unit_graph(squares(spark, sf), "id", "ring")


@query(f"WITH {_DISTRICTS}, f AS (SELECT c_custkey AS k, (c_custkey * 7919) % 19000 AS x, (c_custkey * 104729) % 14000 AS y, 200 + c_custkey % 900 AS s FROM customer), o AS (SELECT district, k, greatest(least(a + 3900, x + s) - greatest(a, x), 0::DOUBLE) * greatest(least(b + 3800, y + s) - greatest(b, y), 0::DOUBLE) AS area FROM f JOIN d ON x < a + 3900 AND x + s > a AND y < b + 3800 AND y + s > b) SELECT district, k, round(area, 3) AS area FROM o WHERE area > 0")
def g23_j21_overlay(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    x, y, side = (k * 7919 % 19000).cast("double"), (k * 104729 % 14000).cast("double"), (F.lit(200) + k % 900).cast("double")
    ring = F.array(*[F.struct((x + dx * side).alias("x"), (y + dy * side).alias("y")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    of = roads.overlay(table(spark, sf, "customer").select(k.alias("k"), ring.alias("ring")), districts(spark), "k", "ring", "district", "ring", 2000.0)
    return of.select("district", "k", F.round("area", 3).alias("area"))


@query(f"""WITH {LINES}, m AS (SELECT id % 7 AS unit, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) + sqrt((x3 - x2) * (x3 - x2) + (y3 - y2) * (y3 - y2)) AS len, sqrt((x3 - x1) * (x3 - x1) + (y3 - y1) * (y3 - y1)) AS ext, least((x1, y1), (x3, y3)) AS p, greatest((x1, y1), (x3, y3)) AS q FROM l),
g AS (SELECT unit, count(*) AS e FROM (SELECT DISTINCT unit, p, q FROM m) GROUP BY 1), h AS (SELECT unit, count(*) AS v FROM (SELECT unit, p AS n FROM m UNION SELECT unit, q FROM m) GROUP BY 1), t AS (SELECT unit, sum(len) AS len, avg(ext) AS ext, avg(ext / nullif(len, 0)) AS lin FROM m GROUP BY 1)
SELECT i AS unit, round(coalesce(len, 0), 5) AS road_length_m, round(coalesce(len, 0) / ((i + 1) * 1e5 / 1e6), 5) AS road_density_m_per_km2, round(ext, 5) AS extension, round(lin, 5) AS linearity, round((e - v + 1) / (2 * v - 5)::DOUBLE, 5) AS meshedness, round(2 * e / v::DOUBLE, 5) AS connectivity FROM range(9) r(i) LEFT JOIN t ON unit = i LEFT JOIN g ON g.unit = i LEFT JOIN h ON h.unit = i""")
def g21_a17_street_indicators(spark: SparkSession, sf: str) -> DataFrame:
    of = nodes.street_indicators(lines(spark, sf).withColumn("unit", F.col("id") % 7), spark.range(9).select(F.col("id").alias("unit"), ((F.col("id") + 1) * 1e5).alias("area")), "unit", "line", "area")
    return rounded(of, *of.columns[1:])


_SEGS = f"{LINES}, s AS (SELECT id, 0 AS n, x1, y1, x2, y2 FROM l UNION ALL SELECT id, 1, x2, y2, x3, y3 FROM l)"


@query(f"""WITH {_SEGS}, p AS (SELECT c_custkey AS k, ((c_custkey * 7919) % 1999)::DOUBLE AS x, ((c_custkey * 104729) % 1511)::DOUBLE AS y FROM customer),
t AS (SELECT k, id, x, y, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM p, s), c AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy) END)) AS t FROM t),
d AS (SELECT k, id, sqrt((x - (x1 + t * dx)) * (x - (x1 + t * dx)) + (y - (y1 + t * dy)) * (y - (y1 + t * dy))) AS d FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, id) AS r FROM d)
SELECT k, round(d, 5) AS dist FROM r WHERE r = 1""")
def j4_nearest_road(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    p = table(spark, sf, "customer").select(k.alias("k"), (k * 7919 % 1999).cast("double").alias("x"), (k * 104729 % 1511).cast("double").alias("y"))
    return spatial.nearest_segment(p, spatial.segments(lines(spark, sf), "id", "line"), "k", "id", "x", "y", 50.0).select("k", F.round("dist", R).alias("dist"))


_KNN = f"{UNITS}, d AS (SELECT a.id AS focal, b.id AS neighbor, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM u a JOIN u b ON a.id <> b.id), n AS (SELECT *, row_number() OVER (PARTITION BY focal ORDER BY dist, neighbor) AS rank FROM d)"


@query(f"WITH {_KNN} SELECT focal, neighbor, round(dist, 5) AS dist, rank::INTEGER AS rank FROM n WHERE rank <= 8")
def j16_w12_nearest_units(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spatial.knn(unit_points(spark, sf), "id", "x", "y", 8), "dist")


@query(f"WITH {_KNN} SELECT focal, neighbor, round(dist, 5) AS dist FROM d WHERE dist <= 0.02")
def j17_distance_band(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spatial.distance_band(unit_points(spark, sf), "id", "x", "y", 0.02), "dist")


@query("WITH b AS (SELECT min(s_acctbal) AS a, max(s_acctbal) AS b, min(s_suppkey) AS c, max(s_suppkey) AS d FROM supplier) SELECT c_custkey FROM customer, b WHERE c_acctbal BETWEEN a AND b AND c_custkey BETWEEN c AND d")
def f10_in_box(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.in_box(table(spark, sf, "customer"), table(spark, sf, "supplier"), "c_acctbal", "c_custkey", "s_acctbal", "s_suppkey").select("c_custkey")


_MORAN = f"{_KNN}, m AS (SELECT id, v - (SELECT avg(v) FROM u) AS z FROM u), g AS (SELECT focal AS id, avg(m.z) AS lag_z FROM n JOIN m ON m.id = n.neighbor WHERE rank <= 6 GROUP BY 1), i AS (SELECT m.id, z, lag_z, (SELECT count(*) - 1 FROM m) * z * lag_z / (SELECT sum(z * z) FROM m) AS moran FROM m JOIN g USING (id))"


@query(f"WITH {_MORAN} SELECT id, round(z, 5) AS z, round(lag_z, 5) AS lag_z, round(moran, 5) AS moran, (CASE WHEN z > 0 AND lag_z > 0 THEN 1 WHEN z <= 0 AND lag_z > 0 THEN 2 WHEN z <= 0 AND lag_z <= 0 THEN 3 ELSE 4 END)::INTEGER AS quadrant FROM i")
def t5_t6_w11_local_moran(spark: SparkSession, sf: str) -> DataFrame:
    u = unit_points(spark, sf)
    return rounded(stats.local_moran(u, "id", "v", spatial.knn(u, "id", "x", "y", 6)), "z", "lag_z", "moran")


@query(f"WITH {_MORAN} SELECT round(avg(z * lag_z) / (SELECT avg(z * z) FROM m), 5) AS moran FROM i")
def t8_global_moran(spark: SparkSession, sf: str) -> DataFrame:
    u = unit_points(spark, sf)
    return rounded(stats.global_moran(u, "id", "v", spatial.knn(u, "id", "x", "y", 6)), "moran")


@query()
def t7_moran_summary(spark: SparkSession, sf: str) -> DataFrame:
    u = unit_points(spark, sf)
    w = spatial.knn(u, "id", "x", "y", 6)
    of = stats.local_moran(u, "id", "v", w)
    p = stats.moran_p_values(of, "id", "z", w, 199)
    label = S.quadrant_label(F.col("quadrant"), F.col("p") < 0.05)
    return of.join(p, "id").groupBy(label.alias("cluster")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("p") < 0.01).cast("int")) * 100, 2).alias("pct_1"))


@query(f"""WITH {UNITS}, d AS (SELECT a.id AS focal, b.id AS neighbor, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.v - b.v) * (a.v - b.v)) AS dist FROM u a JOIN u b ON a.id <> b.id), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY focal ORDER BY dist, neighbor) AS rank FROM d) WHERE rank <= 20),
k AS (SELECT focal AS neighbor, max(dist) AS kd FROM n GROUP BY 1), l AS (SELECT focal, 1 / (avg(greatest(dist, kd)) + 1e-10) AS lrd FROM n JOIN k USING (neighbor) GROUP BY 1)
SELECT n.focal AS node, round(avg(o.lrd) / any_value(l.lrd), 5) AS lof FROM n JOIN l ON l.focal = n.focal JOIN l o ON o.focal = n.neighbor GROUP BY 1""")
def t2_local_outlier_factor(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(outliers.lof(outliers.knn_features(unit_points(spark, sf), "id", ["x", "y", "v"], 20), 20), "lof")


@query(
    f"""WITH {UNITS}, q AS (
  SELECT median(x) AS mx, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS ix, median(y) AS my, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iy, median(v) AS mv, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iv FROM u
), z AS (SELECT id, (x - mx) / ix AS x, (y - my) / iy AS y, (v - mv) / iv AS v FROM u, q
), d AS (SELECT a.id AS focal, b.id AS neighbor, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.v - b.v) * (a.v - b.v)) AS dist FROM z a JOIN z b ON a.id <> b.id
), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY focal ORDER BY dist, neighbor) AS rank FROM d) WHERE rank <= 70
), c AS (SELECT k, n.* FROM n JOIN (SELECT unnest([20, 30, 40, 50, 60, 70]) AS k) ON rank <= k
), r AS (SELECT k, focal AS neighbor, max(dist) AS kd FROM c GROUP BY 1, 2
), l AS (SELECT k, focal, 1 / (avg(greatest(dist, kd)) + 1e-10) AS lrd FROM c JOIN r USING (k, neighbor) GROUP BY 1, 2
), f AS (SELECT c.k, c.focal AS node, avg(o.lrd) / any_value(l.lrd) AS lof FROM c JOIN l ON l.k = c.k AND l.focal = c.focal JOIN l o ON o.k = c.k AND o.focal = c.neighbor GROUP BY 1, 2
), best AS (SELECT k FROM f GROUP BY k ORDER BY stddev_pop(lof) DESC, k LIMIT 1)
SELECT node, round(lof, 5) AS lof, -lof < -1.5 AS is_spatial_outlier FROM f JOIN best USING (k)"""
)
def t2_best_lof(spark: SparkSession, sf: str) -> DataFrame:
    of, _ = outliers.best_lof(outliers.robust_scale(unit_points(spark, sf), ["x", "y", "v"]), "id", ["x", "y", "v"])
    return rounded(of, "lof")


@query(f"""WITH {LINES} SELECT id, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) + sqrt((x3 - x2) * (x3 - x2) + (y3 - y2) * (y3 - y2)), 5) AS length, round(sqrt((x3 - x1) * (x3 - x1) + (y3 - y1) * (y3 - y1)), 5) AS extension,
 round(sqrt((x3 - x1) * (x3 - x1) + (y3 - y1) * (y3 - y1)) / nullif(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) + sqrt((x3 - x2) * (x3 - x2) + (y3 - y2) * (y3 - y2)), 0), 5) AS linearity,
 round(((degrees(atan2(x2 - x1, y2 - y1)) % 360) + 360) % 360, 5) AS bearing, round(abs((x1 * y2 - x2 * y1) + (x2 * y3 - x3 * y2) + (x3 * y1 - x1 * y3)) / 2, 5) AS area FROM l""")
def g2_g13_g14_g25_measures(spark: SparkSession, sf: str) -> DataFrame:
    ln = F.col("line")
    ring = F.concat(ln, F.array(ln[0]))
    of = lines(spark, sf).select("id", G.length(ln).alias("length"), G.extension(ln).alias("extension"), G.linearity(ln).alias("linearity"), G.bearing(ln[0]["x"], ln[0]["y"], ln[1]["x"], ln[1]["y"]).alias("bearing"), G.area(ring).alias("area"))
    return rounded(of, "length", "extension", "linearity", "bearing", "area")


@query("SELECT p_partkey, round((4 * p_size * 10::DOUBLE + p_size * p_size) / pow(p_size * p_size * 10::DOUBLE, 2::DOUBLE / 3), 5) AS compactness, CASE WHEN p_size > 1 THEN round(2 * ln(p_size::DOUBLE) / ln((p_size * p_size)::DOUBLE), 5) END AS fractal, (p_size * p_size)::DOUBLE AS footprint_area FROM part")
def g8_g9_building_shape(spark: SparkSession, sf: str) -> DataFrame:
    side = F.col("p_size").cast("double")
    of = nodes.buildings_morphology(table(spark, sf, "part").select("p_partkey", (4 * side).alias("p"), (side * side).alias("a"), F.lit(10.0).alias("h")), "p", "a", "h")
    return rounded(of.select("p_partkey", F.col("compactness_3d").alias("compactness"), F.col("fractal_dim").alias("fractal"), "footprint_area"), "compactness", "fractal")


@query(f"WITH {NETWORK}, n AS (SELECT unit, a AS n FROM e UNION SELECT unit, b FROM e), v AS (SELECT unit, count(*) AS v FROM n GROUP BY 1), c AS (SELECT unit, count(*) AS c FROM e GROUP BY 1) SELECT unit, c AS n_edges, v AS n_nodes, round(2 * c / v::DOUBLE, 5) AS connectivity, round((c - v + 1) / (2 * v - 5)::DOUBLE, 5) AS meshedness FROM c JOIN v USING (unit)")
def g15_g17_street_graph(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graphs.street_measures(network(spark, sf), "unit"), "connectivity", "meshedness")


_EDGES = "e AS (SELECT DISTINCT least(o_custkey, o_orderkey % 997 + 2000000) AS a, greatest(o_custkey, o_orderkey % 997 + 2000000) AS b FROM orders)"
_CC = f"""{_EDGES}, s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM s UNION (SELECT s.b, min(c.component) FROM c JOIN s ON s.a = c.node JOIN recurring.c AS r ON r.node = s.b WHERE c.component < r.component GROUP BY s.b))"""


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.simple_edges(table(spark, sf, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 997 + 2000000).alias("b")), "a", "b")


@query(f"WITH RECURSIVE {_CC} SELECT node, component FROM c")
def g5_u5_components(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.connected_components(_edges(spark, sf))


@query(f"WITH RECURSIVE {_CC} SELECT node FROM c WHERE component = (SELECT component FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
def g5_largest_component(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.largest_component(_edges(spark, sf))


@query()
def g26_g28_cut_roads(spark: SparkSession, sf: str) -> DataFrame:
    of = roads.cut_roads(lines(spark, sf), "id", "line")
    return of.select("id", "piece", F.round(G.length(F.col("line")), R).alias("length"))


@query(
    f"""WITH {LINES}, s AS (
  SELECT id, 1 AS part, x1 AS x, y1 AS y, x2 - x1 AS dx, y2 - y1 AS dy FROM l UNION ALL SELECT id, 2, x2, y2, x3 - x2, y3 - y2 FROM l
), b AS (SELECT unnest([0, 1, 2, 3])::BIGINT AS unit
), t AS (
  SELECT unit, id, part, sqrt(dx * dx + dy * dy) AS len,
         greatest(0.0::DOUBLE, CASE WHEN dx > 0 THEN (500 * unit - x) / dx WHEN dx < 0 THEN (500 * unit + 500 - x) / dx WHEN x >= 500 * unit AND x <= 500 * unit + 500 THEN 0 ELSE 2 END, CASE WHEN dy > 0 THEN -y / dy WHEN dy < 0 THEN (1500 - y) / dy WHEN y >= 0 AND y <= 1500 THEN 0 ELSE 2 END) AS low,
         least(1.0::DOUBLE, CASE WHEN dx > 0 THEN (500 * unit + 500 - x) / dx WHEN dx < 0 THEN (500 * unit - x) / dx ELSE 1 END, CASE WHEN dy > 0 THEN (1500 - y) / dy WHEN dy < 0 THEN -y / dy ELSE 1 END) AS high FROM s, b
), p AS (
  SELECT unit, id, max(CASE WHEN part = 1 AND high > low THEN len * (high - low) ELSE 0 END) AS a, max(CASE WHEN part = 2 AND high > low THEN len * (high - low) ELSE 0 END) AS b FROM t GROUP BY unit, id
), o AS (SELECT unit, id, CASE WHEN a + b > 0.1 THEN a + b ELSE 0 END AS length FROM p)
SELECT unit, id, round(length, 5) AS length FROM o WHERE length > 0"""
)
def g19_j21_clipped_lines(spark: SparkSession, sf: str) -> DataFrame:
    box = lambda i: F.array(*[F.struct((F.lit(dx) + i * 500.0).alias("x"), F.lit(dy).alias("y")) for dx, dy in ((0.0, 0.0), (500.0, 0.0), (500.0, 1500.0), (0.0, 1500.0), (0.0, 0.0))])
    u = spark.range(4).select(F.col("id").alias("unit"), box(F.col("id")).alias("ring"))
    of = roads.clip_lines_to_units(lines(spark, sf), u, "id", "line", "unit", "ring", 250.0)
    return of.groupBy("unit", "id").agg(F.round(F.sum("length"), R).alias("length"))


@query()
def g31_g36_merged_roads(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.concat(F.lit("road "), (F.col("s_suppkey") % 11).cast("string"))).alias("names"))
    segs = spatial.segments(lines(spark, sf), "id", "line").join(names, "id").drop("n")
    return roads.merge_roads(segs, "id", "names", 20.0)


def _krueger() -> str:
    """DuckDB: easting and northing of the Irish grid, the series written out with its third flattening."""
    n = "0.0016792203946287445::DOUBLE"
    a1, a2, a3 = f"({n}/2 - 2*pow({n},2)/3 + 5*pow({n},3)/16 + 41*pow({n},4)/180)", f"(13*pow({n},2)/48 - 3*pow({n},3)/5 + 557*pow({n},4)/1440)", f"(61*pow({n},3)/240 - 103*pow({n},4)/140)"
    a4, r = f"(49561*pow({n},4)/161280)", f"(6378137.0::DOUBLE/(1+{n})*(1 + pow({n},2)/4 + pow({n},4)/64))"
    e = f"(2*sqrt({n})/(1+{n}))"
    xi = lambda phi: f"sinh(atanh(sin({phi})) - {e}*atanh({e}*sin({phi})))"
    north = f"(u + {a1}*sin(2*u)*cosh(2*v) + {a2}*sin(4*u)*cosh(4*v) + {a3}*sin(6*u)*cosh(6*v) + {a4}*sin(8*u)*cosh(8*v))"
    east = f"(v + {a1}*cos(2*u)*sinh(2*v) + {a2}*cos(4*u)*sinh(4*v) + {a3}*cos(6*u)*sinh(6*v) + {a4}*cos(8*u)*sinh(8*v))"
    return f"""WITH p AS (SELECT event_id, -10.5::DOUBLE + (event_id * 7919 % 20011) / 20011::DOUBLE * 5 AS lon, 51.4::DOUBLE + (event_id * 104729 % 20021) / 20021::DOUBLE * 4 AS lat FROM events),
t AS (SELECT event_id, {xi("radians(lat)")} AS t, radians(lon + 8) AS d FROM p UNION ALL SELECT NULL, {xi("radians(53.5::DOUBLE)")}, 0::DOUBLE), w AS (SELECT event_id, atan2(t, cos(d)) AS u, asinh(sin(d) / sqrt(t*t + cos(d)*cos(d))) AS v FROM t),
g AS (SELECT event_id, {r} * {east} AS e, {r} * {north} AS n FROM w) SELECT event_id, round(600000 + 0.99982::DOUBLE * e, 3) AS x, round(750000 + 0.99982::DOUBLE * (n - (SELECT n FROM g WHERE event_id IS NULL)), 3) AS y FROM g WHERE event_id IS NOT NULL"""


@query(_krueger())
def g1_projected(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    lon, lat = F.lit(-10.5) + (k * 7919 % 20011).cast("double") / 20011.0 * 5, F.lit(51.4) + (k * 104729 % 20021).cast("double") / 20021.0 * 4
    x, y = projection.to_grid(lon, lat, "EPSG:2157")
    return table(spark, sf, "events").select("event_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"WITH {SQUARES} SELECT id, round((least(x + s, 1500) - greatest(x, 200)) * (least(y + s, 900) - greatest(y, 100)), 3) AS area FROM q WHERE x < 1500 AND x + s > 200 AND y < 900 AND y + s > 100")
def f11_clipped_districts(spark: SparkSession, sf: str) -> DataFrame:
    of = roads.clip_to_box(squares(spark, sf), "ring", (200.0, 100.0, 1500.0, 900.0))
    return of.select("id", F.round(G.area(F.col("ring")), 3).alias("area"))


_PART = "greatest(least(a + {0}, x + s) - greatest(a + {1}, x), 0::DOUBLE) * greatest(least(b + {2}, y + s) - greatest(b + {3}, y), 0::DOUBLE)"


@query(f"WITH {_DISTRICTS}, f AS (SELECT c_custkey AS k, (c_custkey * 7919) % 19000 AS x, (c_custkey * 104729) % 14000 AS y, 200 + c_custkey % 900 AS s FROM customer), o AS (SELECT district, k, {_PART.format(3900, 0, 1000, 0)} + {_PART.format(1500, 0, 3800, 1000)} AS area FROM f JOIN d ON x < a + 3900 AND x + s > a AND y < b + 3800 AND y + s > b) SELECT district, k, round(area, 3) AS area FROM o WHERE area > 0")
def j21_bent_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Units in the shape of an L."""
    k, corner = F.col("c_custkey"), F.col("ring")[0]
    x, y, side = (k * 7919 % 19000).cast("double"), (k * 104729 % 14000).cast("double"), (F.lit(200) + k % 900).cast("double")
    ring = F.array(*[F.struct((x + dx * side).alias("x"), (y + dy * side).alias("y")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    bent = F.array(*[F.struct((corner["x"] + dx).alias("x"), (corner["y"] + dy).alias("y")) for dx, dy in ((0.0, 0.0), (3900.0, 0.0), (3900.0, 1000.0), (1500.0, 1000.0), (1500.0, 3800.0), (0.0, 3800.0), (0.0, 0.0))])
    of = roads.overlay(table(spark, sf, "customer").select(k.alias("k"), ring.alias("ring")), districts(spark).withColumn("ring", bent), "k", "ring", "district", "ring", 2000.0)
    return of.select("district", "k", F.round("area", 3).alias("area"))


@query(f"WITH {LINES}, o AS (SELECT DISTINCT id % 7 AS road, CASE WHEN (x1, y1, x2, y2, x3, y3) < (x3, y3, x2, y2, x1, y1) THEN [x1, y1, x2, y2, x3, y3] ELSE [x3, y3, x2, y2, x1, y1] END AS p FROM l) SELECT road, round(sum(sqrt(pow(p[3] - p[1], 2) + pow(p[4] - p[2], 2)) + sqrt(pow(p[5] - p[3], 2) + pow(p[6] - p[4], 2))), 3) AS length FROM o GROUP BY 1")
def g29_g36_road_lines(spark: SparkSession, sf: str) -> DataFrame:
    l = lines(spark, sf)  # noqa: E741
    return roads.merged_lines(l, l.select("id", (F.col("id") % 7).alias("road")), "id", "line").select("road", F.round("length", 3).alias("length"))


@query()
def g37_g38_road_network(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    many = lambda c, t="string": F.array(c.cast(t))
    tags = table(spark, sf, "supplier").select(
        k.alias("id"), F.when(k % 5 == 0, "roundabout").alias("junction"), (k % 3 == 0).alias("oneway"), many(F.when(k % 13 > 0, F.concat(F.lit("Road "), k % 29))).alias("name"),
        many(F.when(k % 2 == 0, "primary").otherwise("residential")).alias("highway"), many(1 + k % 3).alias("lanes"), many(30 + 20 * (k % 2)).alias("maxspeed"),
        F.lit(None).cast("array<string>").alias("tunnel"), many(F.when(k % 17 == 0, "yes")).alias("bridge"),
    )
    of, _ = roads.road_network(lines(spark, sf).join(tags, "id"), "id", "line", near=20.0)
    return of.select("road", "is_roundabout", "names", "max_lanes", "bridge", F.round("length", 3).alias("length"))


def _pixels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(F.floor(k / 40).cast("int").alias("row"), (k % 40).cast("int").alias("col"), F.when(k % 3 > 0, F.floor(F.col("c_acctbal") / 4000).cast("double")).alias("value"))


_REGIONS = """
WITH RECURSIVE px AS (
  SELECT c_custkey // 40 AS r, c_custkey % 40 AS c, floor(c_acctbal / 4000)::DOUBLE AS value,
         lpad((c_custkey // 40)::VARCHAR, 9, '0') || ':' || lpad((c_custkey % 40)::VARCHAR, 9, '0') AS node
  FROM customer WHERE c_custkey % 3 > 0 AND c_acctbal IS NOT NULL
), right_or_below AS (
  SELECT a.node AS a, b.node AS b FROM px a JOIN px b ON a.value = b.value AND a.r = b.r AND a.c + 1 = b.c
  UNION ALL SELECT a.node, b.node FROM px a JOIN px b ON a.value = b.value AND a.c = b.c AND a.r + 1 = b.r
), near AS (SELECT a, b FROM right_or_below UNION ALL SELECT b, a FROM right_or_below
), reach AS (SELECT node AS a, node AS b FROM px UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a
), named AS (SELECT a AS node, min(b) AS region FROM reach GROUP BY a
)
"""


@query(_REGIONS + "SELECT region, value, count(*) AS n FROM px JOIN named USING (node) GROUP BY region, value")
def g7_raster_regions(spark: SparkSession, sf: str) -> DataFrame:
    return roads.raster_regions(_pixels(spark, sf)).groupBy("region", "value").agg(F.count("*").alias("n"))


@query(
    _REGIONS
    + """
SELECT region, value, count(*)::DOUBLE AS area, (4 * count(*) - 2 * sum(coalesce(s.n, 0)))::BIGINT AS outline
FROM px JOIN named USING (node) LEFT JOIN (SELECT a AS node, count(*) AS n FROM right_or_below GROUP BY a) s USING (node) GROUP BY region, value
"""
)
def g7_raster_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """The area within the rings less that of the holes, and the length of all rings, by region."""
    of = roads.raster_polygons(roads.raster_regions(_pixels(spark, sf)))
    return of.groupBy("region", "value").agg(F.sum(F.when(F.col("hole"), -F.col("area")).otherwise(F.col("area"))).alias("area"), F.sum(F.round(G.length(F.col("ring"))).cast("long")).alias("outline"))


@query(
    f"""WITH {UNITS}, d AS (
  SELECT a.id, a.w AS own, b.w, b.v, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM u a, u b
), r AS (SELECT id, 1.0000001::DOUBLE * max(dist) AS reach FROM (SELECT id, dist, row_number() OVER (PARTITION BY id ORDER BY dist) AS k FROM d) WHERE k <= 60 GROUP BY id
), k AS (SELECT d.*, CASE WHEN dist < reach THEN pow(1 - pow(dist / reach, 2), 2) ELSE 0 END AS g FROM d JOIN r USING (id)
), m AS (SELECT id, sum(g * w) / sum(g) AS mw, sum(g * v) / sum(g) AS mv FROM k GROUP BY id
), s AS (SELECT id, any_value(own) AS own, any_value(mw) AS mw, any_value(mv) AS mv, sum(g * (w - mw) * (v - mv)) AS wv, sum(g * pow(w - mw, 2)) AS ww, sum(g * pow(v - mv, 2)) AS vv FROM k JOIN m USING (id) GROUP BY id)
SELECT id, round(mv + wv / ww * (own - mw), 5) AS predicted, round(wv * wv / (ww * vv), 5) AS local_r2 FROM s"""
)
def t14_t18_gwr(spark: SparkSession, sf: str) -> DataFrame:
    g = stats.GWR(unit_points(spark, sf), "id", "x", "y", "v", ["w"])
    return rounded(g.local(60).select("id", "predicted", "local_r2"), "predicted", "local_r2")


@query("SELECT n_regionkey, count(*) AS n, count(DISTINCT n_name) AS n_kinds FROM nation GROUP BY 1")
def a27_a30_counts(spark: SparkSession, sf: str) -> DataFrame:
    return nodes.value_counts(table(spark, sf, "nation"), "n_regionkey", "n_name")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id)::INTEGER AS place FROM events")
def o1_o4_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return nodes.ranked(table(spark, sf, "events"), "event_type", [F.desc("value"), F.col("event_id")]).select("event_id", "place")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS obs_id FROM events")
def f5_dense_ids(spark: SparkSession, sf: str) -> DataFrame:
    return T.dense_ids(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], "obs_id").select("event_id", "obs_id")


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0")
def u2_union_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id")
    return outliers.combine(e, "event_id", e.where("event_id % 3 = 0"), e.where("event_id % 5 = 0"), "union")[0]


@query(f"WITH {_MORAN} SELECT round(regr_slope(lag_z, z), 5) AS slope, round(regr_intercept(lag_z, z), 5) AS intercept FROM i")
def v6_moran_scatter(spark: SparkSession, sf: str) -> DataFrame:
    u = unit_points(spark, sf)
    return rounded(figures.moran_scatter(stats.local_moran(u, "id", "v", spatial.knn(u, "id", "x", "y", 6))), "slope", "intercept")

from . import model_queries, network_queries  # noqa: E402, F401  (they register their own)
