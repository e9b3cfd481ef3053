"""Steps of the analysis that are made of several operators: aggregation to units, covariates of units, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import covariates, graphs, outliers, roads, spatial, units
from . import shapes as shapes_
from . import timeseries as T
from .quantiles import exact_quantiles


def keep_units(df: DataFrame, of: DataFrame, unit: str) -> DataFrame:
    """All rows of the units, with nulls where df has none."""
    return of.join(df, unit, "left")


def aggregate_to_units(points: DataFrame, kind: str, ts: str, value: str, x: str = "x", y: str = "y", size: float = 1000.0, shapes: DataFrame | None = None, key: str = "unit", shape: str = "ring", point: str = "id", quantile: float | None = None, buffer: float | None = None) -> DataFrame:
    """``key, value``: typical-day means by district, hexagon or nearest road, of units with enough values.

    With ``buffer``, roads come with ``original_road_geom``, the line, and ``parts, area``,
    the polygons of the places within that distance: roads as units of the plane.

    kind: ``district`` (shapes: ``key, ring``; points in none are left out), ``hexagon``
    (of ``size``), or ``road`` (shapes: ``key, line``). ``quantile`` is that of well_sampled.
    """
    if kind == "district":
        of = spatial.within(points, shapes, x, y, shape, size)
    elif kind == "hexagon":
        of = points.withColumn(key, G.hex_cell(F.col(x), F.col(y), size))
    elif kind == "road":
        near = spatial.nearest_segment(points, spatial.segments(shapes, key, shape), point, key, x, y, size)
        of = points.join(near.where(F.col(key).isNotNull()).select(point, key), point)
    else:
        raise ValueError("kind must be district, hexagon or road")
    out = units.typical_day_mean(units.well_sampled(of, key, value, quantile), key, ts, value)
    if kind != "road" or buffer is None:
        return out
    lines = shapes.select(key, F.col(shape).alias("original_road_geom")).join(out.select(key), key, "left_semi")
    return out.join(lines, key).join(shapes_.buffers(lines, key, "original_road_geom", buffer), key)


def connected_units(of: DataFrame, key: str, ring: str, buffer: float = 0.0) -> DataFrame:
    """The units of the largest group whose outlines, widened by the buffer, touch."""
    kept = graphs.largest_component(roads.unit_graph(of, key, ring, buffer), of.select(key))
    return of.join(kept.withColumnRenamed("node", key), key, "left_semi")


def outlier_detection(points: DataFrame, key: str, ts: str, value: str, vehicle: list[str], features: list[str], method: str = "intersection", choices: tuple[int, ...] = (20, 30, 40, 50, 60, 70), **settings) -> tuple[DataFrame, DataFrame]:
    """(cleaned, outliers with three flags) from temporal outliers by vehicle and local outlier factors of scaled features."""
    temporal = T.temporal_outliers(points, ts, value, vehicle, key, **settings).where("is_temporal_outlier")
    scored, _ = outliers.best_lof(outliers.robust_scale(points.select(key, *features).dropna(), features), key, features, choices)
    return outliers.combine(points, key, temporal, scored.where("is_spatial_outlier").withColumnRenamed("node", key), method)


def points_by_unit(points: DataFrame, shapes: DataFrame, unit: str, x: str, y: str, ring: str, size: float, values: list[str]) -> DataFrame:
    """A row for each point in each unit, and one with nulls for each unit without points."""
    found = spatial.within(points, shapes, x, y, ring, size).select(unit, *values)
    return shapes.select(unit).join(found, unit, "left")


def traffic_by_unit(sites: DataFrame, of: DataFrame, unit: str, x: str, y: str, value: str, k: int = 5) -> DataFrame:
    """``unit, value, <value>_idw``: mean of a unit's sites, and for units without sites the mean of the nearest units that have some."""
    mean = keep_units(sites.groupBy(unit).agg(F.avg(value).alias(value)), of.select(unit, x, y), unit)
    filled = spatial.idw(mean.where(F.col(value).isNotNull()), mean.where(F.col(value).isNull()), unit, x, y, value, k).withColumnRenamed(value, "__w")
    return mean.join(filled, unit, "left").select(unit, value, F.coalesce(value, "__w").alias(f"{value}_idw"))


def buildings_morphology(of: DataFrame, perimeter: str, area: str, height: str, key: str | None = None, ring: str | None = None) -> DataFrame:
    """Buildings with ``compactness_3d, fractal_dim, footprint_area``, and given their ``key`` and ``ring``, ``building_adj`` (null for a ring without an area or corners)."""
    p, a = F.col(perimeter).cast("double"), F.col(area).cast("double")
    out = of.withColumns({"compactness_3d": G.compactness(p, a, F.col(height).cast("double")), "fractal_dim": G.fractal_dimension(p, a), "footprint_area": a})
    if key is None:
        return out
    x, y = G.centroid(F.col(ring))
    centres = of.where(F.size(ring) > 1).select(key, x.alias("x"), y.alias("y"))
    adjacency = roads.building_adjacency(spatial.segments(of, key, ring), centres, key).withColumnRenamed("adjacency", "building_adj")
    return out.join(adjacency, key, "left")


def buildings_by_unit(buildings: DataFrame, of: DataFrame, unit: str, means: list[str], footprint: str = "footprint_area", unit_area: str | None = None) -> DataFrame:
    """``unit``, the means, and ``build_cover_area``, given the units' area also ``build_cover_share``; units without buildings have nulls and an area of 0."""
    joined = keep_units(buildings.select(unit, *means, footprint), of.select(unit), unit)
    out = joined.groupBy(unit).agg(*[F.avg(m).alias(m) for m in means], F.coalesce(F.sum(footprint), F.lit(0.0)).alias("build_cover_area"))
    return out.join(of.select(unit, F.col(unit_area).alias("__u")), unit).withColumn("build_cover_share", F.try_divide("build_cover_area", "__u")).drop("__u") if unit_area else out


def trees_by_unit(trees: DataFrame, of: DataFrame, unit: str, area: str, unit_area: str | None = None) -> DataFrame:
    """``unit, total_trees_area, count_trees, canopy_cover``; a unit without trees counts one row, as the outer join gives it."""
    joined = trees.select(unit, F.col(area).alias("__a")).join(of, unit, "right")
    sums = [F.coalesce(F.sum("__a"), F.lit(0.0)).alias("total_trees_area"), F.count(F.lit(1)).alias("count_trees")]
    out = joined.groupBy(unit).agg(*sums, *([F.first(unit_area).alias("__u")] if unit_area else []))
    return out.withColumn("canopy_cover", F.try_divide(100.0 * F.col("total_trees_area"), F.col("__u"))).drop("__u") if unit_area else out


def density(total: Column, area: Column) -> Column:
    """Total over area, 0 where the area is not positive."""
    return F.when(area > 0, total / area).otherwise(F.lit(0.0))


def street_indicators(streets: DataFrame, of: DataFrame, unit: str, line: str, area: str, key: str | None = None) -> DataFrame:
    """``unit, road_length_m, road_density_m_per_km2, extension, linearity, meshedness, connectivity``.

    streets: parts of lines inside one unit each, as rows or, given a ``key``, as all rows
    of a unit and key; of: ``unit, area`` in square metres. Means are over streets, not
    parts. Units without streets have a length and density of 0 and nulls.
    """
    one = roads.street_measures(streets, unit, line, key)
    sums = one.groupBy(unit).agg(F.sum("length").alias("__l"), F.avg("extension").alias("extension"), F.avg(F.try_divide("extension", "length")).alias("linearity"))
    graph = graphs.street_measures(one.select(unit, F.explode("edges").alias("e")).select(unit, "e.a", "e.b"), unit).select(unit, "meshedness", "connectivity")
    joined = of.select(unit, area).join(sums, unit, "left").join(graph, unit, "left").withColumn("road_length_m", F.coalesce("__l", F.lit(0.0)))
    return joined.select(unit, "road_length_m", density(F.col("road_length_m"), F.col(area) / 1e6).alias("road_density_m_per_km2"), "extension", "linearity", "meshedness", "connectivity")


def road_class_lengths(streets: DataFrame, unit: str, length: str, highway: str = "highway") -> DataFrame:
    """``unit, low_access, major_road``: the length of each class; streets without a highway tag are left out."""
    return covariates.pivot_sum(roads.classified(streets, highway), unit, "road_class", length, ["low_access", "major_road"])


def indicators_and_classes(indicators: DataFrame, classes: DataFrame, unit: str) -> DataFrame:
    """Indicators with the lengths of the classes."""
    return indicators.join(classes, unit, "left")


def landuse_by_unit(areas: DataFrame, unit: str, kind: str, area: str, unit_area: DataFrame, kinds: list[str]) -> DataFrame:
    """``unit`` and the percentage of its area for each kind; ``unit_area`` has ``unit, total``."""
    return covariates.share_of_area(covariates.pivot_sum(areas, unit, kind, area, kinds).join(unit_area, unit), kinds, "total").drop("total")


def summary(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """``low, high, mean, mid, sd, cv`` of a column; sd is that of the population, cv that of a sample over the mean's size."""
    q = F.col(column)
    r = lambda c, n: F.round(c, digits).alias(n)
    (mid,) = exact_quantiles(df, column, [0.5])
    return df.agg(r(F.min(q), "low"), r(F.max(q), "high"), r(F.avg(q), "mean"), r(F.lit(mid).cast("double"), "mid"), F.stddev_pop(q).alias("sd"), F.try_divide(F.stddev_samp(q), F.abs(F.avg(q))).alias("cv"))


def value_counts(df: DataFrame, by: str, what: str) -> DataFrame:
    """``by, n, n_kinds``: rows, and different values of a column."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct(what).alias("n_kinds"))


def names_by(df: DataFrame, by: str, names: Column) -> DataFrame:
    """``by, names``: the sorted distinct names of a group, null where it has none."""
    every = df.select(by, F.explode(names).alias("__n")).where("__n IS NOT NULL").groupBy(by).agg(F.array_sort(F.collect_set("__n")).alias("names"))
    return df.select(by).distinct().join(every, by, "left")


def ranked(df: DataFrame, by: str, order: list[Column], out: str = "place") -> DataFrame:
    """A number from 1 in each group's order."""
    return T.placed(df, by, order, out)


def date_parts(df: DataFrame, ts: str) -> DataFrame:
    """``hour, day, weekday`` (Monday 0)``, floor, month`` of a time without a zone."""
    t = F.col(ts).cast("timestamp")
    return df.withColumns({"hour": F.hour(t), "day": F.to_date(t).cast("string"), "weekday": F.weekday(t), "floor": F.date_trunc("hour", t).cast("timestamp_ntz"), "month": F.date_format(t, "yyyy-MM")})


def parsed_time(text: Column, form: str) -> Column:
    """A time without a zone from text of a given form; null where it does not read so."""
    return F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz")
