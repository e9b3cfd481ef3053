"""Settings of a run: defaults, and one preset for each study area."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Settings:
    crs_metric: str = "EPSG:2157"
    crs_latlon: str = "EPSG:4326"
    timestamp: str = "gps_timestamp"
    lat: str = "latitude"
    lon: str = "longitude"
    value: str = "NO2_ugm3"
    match_gap_s: int = 300
    outlier_gap_s: int = 120
    hampel_window: int = 31
    hampel_sensitivity: float = 3.0
    roc_quantile: float = 0.99
    roc_max_gap_s: int = 60
    lof_neighbours: tuple[int, ...] = (20, 30, 40, 50, 60, 70)
    chunk_max: int = 16_000
    chunk_min: int = 10
    bearing_split: float = 35.0
    min_segment_m: float = 20.0
    max_segment_m: float = 150.0
    road_buffer_m: float = 100.0
    directions: tuple[str, ...] = ("upper", "lower")
    abbreviations: tuple[tuple[str, str], ...] = (("st", "street"), ("rd", "road"), ("ave", "avenue"), ("blvd", "boulevard"))
    road_words: tuple[str, ...] = ("street", "st", "road", "rd", "square", "ave", "avenue", "drive")
    traffic_time_format: str = "yyyyMMddHHmmss"
    n_search: int | str = 100
    matcher_url: str = ""
    match_by: str = "network"
    match_radius_m: float = 50.0
    match_sigma_m: float = 5.0
    match_beta_m: float = 5.0
    moran_neighbours: int = 8
    residual_band_m: float = 500.0
    mgwr_start: int = 10
    cell_m: float = 1000.0


DUBLIN = Settings()
HAMBURG = replace(
    DUBLIN, directions=("obere", "untere"), abbreviations=(("st", "straße"), ("rd", "straße"), ("al", "allee"), ("blv", "boulevard")),
    road_words=("straße", "strasse", "st", "rd", "al", "allee", "platz", "blv", "boulevard", "weg"),
    crs_metric="EPSG:10285", traffic_time_format="yyyy-MM-dd HH:mm:ssXXX", n_search=200,
)
PRESETS = {"base": DUBLIN, "hamburg": HAMBURG}
