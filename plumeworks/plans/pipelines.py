"""Named pipelines: steps that read tables of a catalog by name and add others to it."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PRESETS, Settings
from ..functions import geometry as G
from ..functions import projection as P
from ..operators import covariates, figures, matching, nodes, roads, spatial, stats, traffic
from ..operators import timeseries as T
from ..operators.graphs import cut_lineage

Catalog = dict[str, DataFrame]


@dataclass(frozen=True)
class Step:
    """A function of settings and the tables ``inputs``, which gives the tables ``outputs``."""

    name: str
    function: Callable[..., tuple[DataFrame, ...]]
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]


def _air(s: Settings, raw: DataFrame) -> tuple[DataFrame]:
    """Parsed points with ``id, vehicle, x, y`` in metres; values that are not positive are null. Without a vehicle column all points are one vehicle's."""
    raw = raw if "vehicle" in raw.columns else raw.withColumn("vehicle", F.lit(""))
    of = T.mask_nonpositive(T.parse_points(raw, s.timestamp, s.lat, s.lon), s.value).drop("point")
    x, y = P.to_grid(F.col(s.lon), F.col(s.lat), s.crs_metric)
    return (T.dense_ids(of.withColumns({"x": x, "y": y}), [s.timestamp, s.lat, s.lon, s.value], "id"),)


def _match(s: Settings, points: DataFrame, ways: DataFrame) -> tuple[DataFrame]:
    """By the service of ``matcher_url``, else on the ways themselves."""
    of = matching.match_days(points, ["vehicle"], "id", matching.HttpMatcher(s.matcher_url) if s.matcher_url else None, s, ways)
    x, y = P.to_grid(F.col("matched_lon"), F.col("matched_lat"), s.crs_metric)
    return (of.withColumns({"x": x, "y": y}),)


def _outliers(s: Settings, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    return nodes.outlier_detection(
        points, "id", s.timestamp, s.value, ["vehicle"], ["x", "y", s.value], choices=s.lof_neighbours,
        gap_s=s.outlier_gap_s, window=s.hampel_window, sensitivity=s.hampel_sensitivity, quantile=s.roc_quantile, max_gap_s=s.roc_max_gap_s,
    )


def _roads(s: Settings, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    of = ways.withColumn("line", P.projected_line(F.col("line"), s.crs_metric))
    return roads.road_network(of, "id", "line", s)


def _units(s: Settings, points: DataFrame, shapes: DataFrame) -> tuple[DataFrame]:
    kept = nodes.connected_units(shapes, "unit", "ring")
    return (nodes.aggregate_to_units(points, "district", s.timestamp, s.value, shapes=kept),)


def _hotspots(s: Settings, values: DataFrame, shapes: DataFrame) -> tuple[DataFrame]:
    of = values.join(with_centres(shapes).select("unit", "x", "y"), "unit")
    near = spatial.knn(of, "unit", "x", "y", s.moran_neighbours)
    local = stats.local_moran(of, "unit", s.value, near)
    return (figures.local_moran_map(local, stats.moran_p_values(local, "unit", "z", near), "unit"),)


def with_centres(shapes: DataFrame) -> DataFrame:
    """Shapes with ``x, y``: the middle of a ring's area."""
    x, y = G.centroid(F.col("ring"))
    return shapes.where(F.size("ring") > 1).withColumns({"x": x, "y": y})


def _temporal(s: Settings, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    return T.hourly_boxes(points, s.timestamp, s.value), T.daily_medians(points, s.timestamp, s.value)


def _traffic(s: Settings, counts: DataFrame, places: DataFrame, shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    read = counts.withColumn("time", nodes.parsed_time(F.col("End_Time"), s.traffic_time_format).cast("timestamp"))
    sites = traffic.with_places(traffic.site_means(read, "time", "Site", "Sum_Volume"), places, "Site")
    inside = spatial.within(sites, shapes, "x", "y", "ring", s.cell_m)
    return sites, nodes.traffic_by_unit(inside, with_centres(shapes), "unit", "x", "y", "avg_traffic")


def _buildings(s: Settings, buildings: DataFrame, shapes: DataFrame) -> tuple[DataFrame]:
    """Buildings as rings with a height, with their adjacency; or ready measured as ``x, y, perimeter, area, height``, without it."""
    means = ["height", "compactness_3d", "fractal_dim"]
    if "ring" in buildings.columns:
        x, y = G.centroid(F.col("ring"))
        buildings = buildings.withColumns({"x": x, "y": y, "perimeter": G.length(F.col("ring")), "area": G.area(F.col("ring"))})
        shaped, means = nodes.buildings_morphology(buildings, "perimeter", "area", "height", "id", "ring"), [*means, "building_adj"]
    else:
        shaped = nodes.buildings_morphology(buildings, "perimeter", "area", "height")
    inside = spatial.within(shaped.drop("ring"), shapes, "x", "y", "ring", s.cell_m)
    return (nodes.buildings_by_unit(inside, shapes, "unit", means, unit_area="area").withColumnRenamed("height", "build_height"),)


def _streets(s: Settings, ways: DataFrame, shapes: DataFrame) -> tuple[DataFrame]:
    tagged = ways.withColumn("line", P.projected_line(F.col("line"), s.crs_metric))
    cut = roads.clip_lines_to_units(tagged, shapes, "id", "line", "unit", "ring", s.cell_m)
    indicators = nodes.street_indicators(cut, shapes, "unit", "line", "area", "id")
    classes = nodes.road_class_lengths(cut.join(tagged.select("id", "highway"), "id"), "unit", "length")
    return (nodes.indicators_and_classes(indicators, classes, "unit"),)


def _morphology(s: Settings, streets: DataFrame, walls: DataFrame) -> tuple[DataFrame]:
    return (roads.street_profile(streets, walls, "unit"),)


def _trees(s: Settings, trees: DataFrame, shapes: DataFrame) -> tuple[DataFrame]:
    inside = spatial.within(trees, shapes, "x", "y", "ring", s.cell_m).select("unit", "crown_area")
    return (nodes.trees_by_unit(inside, shapes.select("unit", "area"), "unit", "crown_area", "area"),)


def _landuse(s: Settings, landuse: DataFrame, shapes: DataFrame) -> tuple[DataFrame]:
    """Kinds of land use become columns, so their list is read once; it is that of the legend."""
    kinds = [r[0] for r in landuse.select("kind").where("kind IS NOT NULL").distinct().orderBy("kind").collect()]
    parts = roads.overlay(landuse, shapes, "id", "ring", "unit", "ring", s.cell_m, ["kind"])
    return (nodes.landuse_by_unit(parts, "unit", "kind", "area", shapes.select("unit", F.col("area").alias("total")), kinds),)


def _covariates(s: Settings, values: DataFrame, *tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    of = covariates.merge_units([values, *tables], "unit")
    columns = [c for c, kind in of.dtypes if kind == "double" and c not in ("unit", s.value)]
    return of, covariates.correlation_table(of, [s.value, *columns])


def _scaled(of: DataFrame, shapes: DataFrame, value: str, columns: list[str]) -> DataFrame:
    """Units with a value, the columns as z scores and the middles of their shapes."""
    return covariates.z_scores(of.select("unit", value, *columns).dropna(), columns).join(with_centres(shapes).select("unit", "x", "y"), "unit")


def _models(s: Settings, of: DataFrame, shapes: DataFrame) -> tuple[DataFrame]:
    columns = [c for c, kind in of.dtypes if kind == "double" and c not in ("unit", s.value)]
    chosen = covariates.reduce_multicollinearity(of.dropna(), covariates.select_covariates(of, s.value, columns))
    found = stats.random_search(_scaled(of, shapes, s.value, chosen), "unit", "x", "y", s.value, chosen, s.n_search)
    rows = [(n, list(f["predictors"]), float(f["bandwidth"]), f["aicc"], f["r2"]) for n, f in enumerate(found)]
    return (of.sparkSession.createDataFrame(rows, "place int, predictors array<string>, bandwidth double, aicc double, r2 double"),)


def _fit(s: Settings, of: DataFrame, shapes: DataFrame, models: DataFrame) -> tuple[DataFrame, ...]:
    """The first model's local coefficients, how many of them are significant, Moran's I of its residuals by distance band, and the bandwidths of the multiscale fit. Raises where no model was found."""
    spark, best = of.sparkSession, models.orderBy("place").first()
    if best is None:
        raise ValueError("no model was found")
    names = list(best.predictors)
    units = cut_lineage(_scaled(of, shapes, s.value, names))
    gwr = stats.GWR(units, "unit", "x", "y", s.value, names)
    fit = gwr.fit(int(best.bandwidth))
    local = cut_lineage(gwr.local(int(best.bandwidth)))
    significant = [(n, *counts) for n, counts in gwr.significance(fit).items()]
    left = figures.residuals(local, units, "unit", s.value).join(units.select("unit", "x", "y"), "unit")
    moran = stats.global_moran(left, "unit", "residual", spatial.distance_band(units, "unit", "x", "y", s.residual_band_m))
    multi = stats.mgwr(units, "unit", "x", "y", s.value, names, start=s.mgwr_start)
    rows = [(*r, multi["effective"][r[0]]) for r in figures.bandwidths(multi, names)]
    return (
        local.join(left.select("unit", "residual"), "unit"), spark.createDataFrame(significant, "coefficient string, n_5 int, n_corrected int"), moran,
        spark.createDataFrame(rows, "coefficient string, global_bandwidth int, gwr_bandwidth int, bandwidth int, effective double"),
    )


PIPELINES: dict[str, list[Step]] = {
    "data_preparation": [
        Step("air", _air, ("air_raw",), ("air",)),
        Step("match", _match, ("air", "ways"), ("air_matched",)),
        Step("outliers", _outliers, ("air_matched",), ("air_clean", "air_outliers")),
        Step("roads", _roads, ("ways",), ("roads", "road_pieces")),
        Step("units", _units, ("air_clean", "shapes"), ("values",)),
    ],
    "hotspot_analysis": [Step("hotspots", _hotspots, ("values", "shapes"), ("hotspots",))],
    "temporal_pattern": [Step("temporal", _temporal, ("air_clean",), ("hours", "days"))],
    "traffic": [Step("traffic", _traffic, ("traffic_raw", "traffic_places", "shapes"), ("traffic_sites", "unit_traffic"))],
    "buildings": [Step("buildings", _buildings, ("buildings", "shapes"), ("unit_buildings",))],
    "streets": [Step("streets", _streets, ("ways", "shapes"), ("unit_streets",))],
    "morphology_profile": [Step("morphology", _morphology, ("unit_lines", "walls"), ("unit_profiles",))],
    "urban_trees": [Step("trees", _trees, ("trees", "shapes"), ("unit_trees",))],
    "urban_landuse": [Step("landuse", _landuse, ("landuse", "shapes"), ("unit_landuse",))],
    "covariates": [Step("covariates", _covariates, ("values", "unit_traffic", "unit_buildings", "unit_streets", "unit_profiles", "unit_trees", "unit_landuse"), ("covariates", "correlations"))],
    "modelling": [Step("models", _models, ("covariates", "shapes"), ("models",)), Step("fit", _fit, ("covariates", "shapes", "models"), ("fit_units", "fit_significance", "residual_moran", "bandwidths"))],
}
_UNIT_TABLES = ("traffic", "buildings", "streets", "morphology_profile", "urban_trees", "urban_landuse")
PIPELINES["all_covariates"] = [s for name in (*_UNIT_TABLES, "covariates") for s in PIPELINES[name]]
PIPELINES["default"] = [s for name in ("data_preparation", "hotspot_analysis", "temporal_pattern") for s in PIPELINES[name]] + PIPELINES["all_covariates"] + PIPELINES["modelling"]


def run(spark: SparkSession, name: str, read: Callable[[str], DataFrame], write: Callable[[str, DataFrame], DataFrame], settings: Settings) -> list[str]:
    """The tables that a pipeline made, in order. Inputs that no step makes come from ``read``; ``write`` lands a table and gives it back as read."""
    known: Catalog = {}
    made = []
    for step in PIPELINES[name]:
        tables = [known[i] if i in known else known.setdefault(i, read(i)) for i in step.inputs]
        for out, df in zip(step.outputs, step.function(settings, *tables), strict=True):
            known[out] = write(out, df)
            made.append(out)
    return made


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Runs a pipeline over ``<folder>/<table>.parquet``; tables that it makes are put there too, and replace earlier ones."""
    parser = argparse.ArgumentParser(prog="plumeworks", description="Runs a pipeline over a folder of Parquet tables.")
    parser.add_argument("folder")
    parser.add_argument("--pipeline", choices=list(PIPELINES), default="default")
    parser.add_argument("--preset", choices=list(PRESETS), default="base")
    of = parser.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    at = lambda n: f"{of.folder.rstrip('/')}/{n}.parquet"

    def write(n: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(at(n))
        return spark.read.parquet(at(n))

    return run(spark, of.pipeline, lambda n: spark.read.parquet(at(n)), write, PRESETS[of.preset])
