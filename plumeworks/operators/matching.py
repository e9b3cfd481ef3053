"""Map matching of trajectories: on a road network of our own, or by a service that can be plugged in."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DUBLIN, Settings
from ..functions import projection as P
from . import network
from . import timeseries as T
from .graphs import cut_lineage

Matcher = Callable[[list[tuple[float, float]]], list[tuple[float, float] | None] | None]


def match(df: DataFrame, chunk: str, order: str, lon: str, lat: str, matcher: Matcher) -> DataFrame:
    """The rows with ``matched_lon, matched_lat``: the matched point, else the original.

    A chunk has at most as many points as chunk_ids allows, so that a group fits a task.
    A chunk that the service refuses keeps its points.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", matched_lon double, matched_lat double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        trace = list(zip(pdf[lon], pdf[lat]))
        got = matcher(trace) or [None] * len(trace)
        both = [g or t for g, t in zip([*got, *[None] * len(trace)], trace)]
        return pdf.assign(matched_lon=[float(p[0]) for p in both], matched_lat=[float(p[1]) for p in both])

    return df.groupBy(chunk).applyInPandas(run, schema)


@dataclass(frozen=True)
class HttpMatcher:
    """A matcher that posts a trace as JSON and reads ``tracepoints[].location``; None where the service answers with an error or no points.

    A service that cannot be reached raises, so that the task is tried again.
    """

    url: str
    headers: dict[str, str] = field(default_factory=lambda: {"Content-Type": "application/json"})
    radius_m: int = 100
    timeout_s: float = 300.0

    def body(self, trace: list[tuple[float, float]]) -> dict:
        return {"shape": [{"lon": x, "lat": y} for x, y in trace], "search_radius": self.radius_m, "shape_match": "map_snap", "costing": "auto", "format": "osrm"}

    def __call__(self, trace: list[tuple[float, float]]) -> list[tuple[float, float] | None] | None:
        request = urllib.request.Request(self.url, json.dumps(self.body(trace)).encode(), self.headers)  # noqa: S310
        try:
            with urllib.request.urlopen(request, timeout=self.timeout_s) as answer:  # noqa: S310
                found = json.load(answer).get("tracepoints") if answer.status == 200 else None
        except urllib.error.HTTPError:
            return None
        return found and [tuple(p["location"]) if p and "location" in p else None for p in found]


def match_days(df: DataFrame, vehicle: list[str], key: str, matcher: Matcher | None, settings: Settings = DUBLIN, ways: DataFrame | None = None) -> DataFrame:
    """``matched_lon, matched_lat`` of every point, from trajectories by vehicle and day, cut at gaps and into chunks.

    ways: ``id, line`` in degrees. Without a matcher, points are matched on them as
    ``settings.match_by`` says: ``network`` by the likeliest sequence of roads, ``snap``
    to the nearest road within the radius. A point that has no road within the radius, and
    every point where there are no ways either, is given as it is. Every day is done in one run.
    """
    ts, lon, lat = settings.timestamp, settings.lon, settings.lat
    own = {"matched_lon": F.col(lon).cast("double"), "matched_lat": F.col(lat).cast("double")}

    def moved(near: DataFrame) -> DataFrame:
        near = cut_lineage(near)  # a projection of a projection is more code than Spark compiles
        return df.join(near, df[key] == near["__id"], "left").withColumns({n: F.coalesce(f"__{n[-3:]}", c) for n, c in own.items()}).drop("__id", "__lon", "__lat")

    if matcher is None and (ways is None or settings.match_by == "none"):
        return df.withColumns(own)
    if matcher is None and settings.match_by == "snap":
        x, y = P.to_grid(F.col(lon), F.col(lat), settings.crs_metric)
        lines = ways.select("id", P.projected_line(F.col("line"), settings.crs_metric).alias("line"))
        at = network.snap_to_roads(cut_lineage(df.select(F.col(key).alias("__id"), x.alias("x"), y.alias("y"))), cut_lineage(lines), "__id", "id", "line", size=settings.cell_m)
        back = P.from_grid(F.col("px"), F.col("py"), settings.crs_metric)
        near = at.where(F.col("dist") <= settings.match_radius_m).select("__id", back[0].alias("__lon"), back[1].alias("__lat"))
        return moved(near)
    by = [*vehicle, "__day"]
    split = T.split_by_gaps(df.withColumn("__day", F.to_date(ts)), ts, settings.match_gap_s, by, key, "__traj")
    chunks = T.chunk_ids(split, [*by, "__traj"], [ts, key], settings.chunk_max, settings.chunk_min, "__part")
    named = chunks.withColumn("__chunk", F.to_json(F.struct(*by, "__part")))
    if matcher is None:
        x, y = P.to_grid(F.col(lon), F.col(lat), settings.crs_metric)
        lines = ways.select("id", P.projected_line(F.col("line"), settings.crs_metric).alias("line"))
        of = cut_lineage(named.select("__chunk", ts, F.col(key).alias("__id"), x.alias("x"), y.alias("y")))
        at = network.match_to_roads(of, cut_lineage(lines), "__chunk", [ts, "__id"], "id", "line", model=network.Model(settings.match_radius_m, settings.match_sigma_m, settings.match_beta_m))
        back = P.from_grid(F.col("matched_x"), F.col("matched_y"), settings.crs_metric)
        near = at.where("road IS NOT NULL").select("__id", back[0].alias("__lon"), back[1].alias("__lat"))
        return moved(near)
    return match(named.drop("__day", "__traj", "__part"), "__chunk", ts, lon, lat, matcher).drop("__chunk")
