"""Names, lists and types of road tags as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that the results must drop or spell out, tag values, and short names.
DIRECTIONS = ["upper", "lower"]
ABBREVIATIONS = {"st": "street", "rd": "road", "ave": "avenue", "blvd": "boulevard"}
ROAD_WORDS = ["street", "st", "road", "rd", "square", "ave", "avenue", "drive"]
TUNNEL = ["yes", "building_passage"]
BRIDGE = ["yes", "movable", "viaduct", "aqueduct"]
SHORT_NAMES = {
    "Avg_hourly_traffic_idw": "traffic", "3D_compactness": "compactness_3d", "building_adj": "bldg_adj", "fractal_dim": "fractal", "build_cover_area": "bldg_area", "road_length_m": "road_len", "road_density_m_per_km2": "road_dens",
    "extension": "ext", "linearity": "lin", "meshedness": "mesh", "connectivity": "connectivity", "low_access": "low_acc", "major_road": "major_rd", "width": "width", "openness": "open", "width_deviation": "width_dev",
    "height": "height", "height_deviation": "height_dev", "hw_ratio": "hw_ratio", "count_trees": "tree_count", "canopy_cover": "canopy", "discontinuous_dense_urban_fabric_sl_50_80": "dense_urban", "green_urban_areas": "green_urban",
    "industrial_commercial_public_military_and_private_units": "industrial_area", "other_roads_and_associated_land": "other_roads", "continuous_urban_fabric_sl_80": "continuous_urban",
}
MAJOR = ["motorway", "trunk", "primary", "secondary"]
NULL_LIKE = ["nan", "none", "null", "<na>", ""]
QUADRANTS = {0: "Non-Significant", 1: "HH", 2: "LH", 3: "LL", 4: "HL"}


def _words(name: Column, drop: list[str]) -> Column:
    return F.filter(F.split(name, r"\s+"), lambda w: (w != "") & ~w.isin(drop))


def remove_words(name: Column, drop: list[str] = ROAD_WORDS) -> Column:
    """The name without the given words, which tell the type of a road; single spaces between the rest."""
    return F.array_join(_words(name, drop), " ")


def standardize_name(name: Column, directions: list[str] = DIRECTIONS, abbreviations: dict[str, str] = ABBREVIATIONS) -> Column:
    """Lower case, without punctuation and direction words, abbreviations spelt out; null stays null."""
    plain = F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", "")
    words = _words(plain, directions)
    table = F.create_map(*[F.lit(x) for pair in abbreviations.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w)), " ")


def road_names(names: Column, directions: list[str] = DIRECTIONS, abbreviations: dict[str, str] = ABBREVIATIONS, drop: list[str] = ROAD_WORDS) -> Column:
    """A list of names: each standardised and without the words of road types, distinct and sorted; null stays null."""
    return F.array_sort(F.array_distinct(F.transform(names, lambda n: remove_words(standardize_name(n, directions, abbreviations), drop))))


def short_names(df: DataFrame) -> DataFrame:
    """The columns under the names that figures use."""
    return df.withColumnsRenamed({k: v for k, v in SHORT_NAMES.items() if k in df.columns})


def correct_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """String columns that hold numbers in all their rows as long or double, strings that spell a missing value as null; found in one pass."""
    kinds = df.agg(*[F.collect_set(typed(F.col(c))).alias(c) for c in columns]).first()
    out = df
    for c in columns:
        seen = set(kinds[c]) - {"null"}
        value = null_like(F.col(c))
        out = out.withColumn(c, value.cast("long") if seen == {"integer"} else value.cast("double") if seen and seen <= {"integer", "float"} else value)
    return out


def kinds_of(df: DataFrame, column: str) -> DataFrame:
    """``kind, n``: what a string column holds, by kind; more than one row means mixed types."""
    return df.groupBy(typed(F.col(column)).alias("kind")).agg(F.count("*").alias("n"))


def integers(value: Column) -> Column:
    """The whole tokens of a string that are integers ('30 mph' -> [30])."""
    return F.transform(F.filter(F.split(value, r"\s+"), lambda t: t.rlike(r"^\d+$")), lambda t: t.cast("long"))


def largest(values: Column) -> Column:
    return F.array_max(values)


def smallest(values: Column) -> Column:
    return F.array_min(values)


def without_unclassified(highway: Column) -> Column:
    return F.filter(highway, lambda x: x != "unclassified")


def any_in(values: Column, of: list[str]) -> Column:
    """Whether a tag list has one of these values; null counts as no."""
    return F.coalesce(F.exists(values, lambda x: x.isin(of)), F.lit(False))


def null_like(value: Column) -> Column:
    """Null for strings that spell a missing value."""
    return F.when(~F.lower(F.trim(value)).isin(NULL_LIKE), value)


def typed(value: Column) -> Column:
    """What a string holds: ``integer``, ``float``, ``null`` or ``string``."""
    return F.when(null_like(value).isNull(), "null").when(value.rlike(r"^\d+$"), "integer").when(value.try_cast("double").isNotNull(), "float").otherwise("string")


def road_class(highway: Column) -> Column:
    """major_road if any tag is a major class, links included; else low_access; null for null."""
    plain = F.transform(highway, lambda x: F.regexp_replace(x, "_link$", ""))
    return F.when(highway.isNull(), None).when(F.exists(plain, lambda x: x.isin(MAJOR)), "major_road").otherwise("low_access")


def column_name(name: str) -> str:
    """Lower case, no punctuation, spaces as single underscores."""
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", name.lower())).strip().replace(" ", "_")


def class_name(value: Column) -> Column:
    """column_name for a column's values."""
    return F.replace(F.trim(F.regexp_replace(F.regexp_replace(F.lower(value), r"(?U)[^\w\s]", ""), r"\s+", " ")), F.lit(" "), F.lit("_"))


def quadrant_label(quadrant: Column, significant: Column) -> Column:
    q, out = F.when(significant, quadrant).otherwise(0), F.lit(None).cast("string")
    for k, label in QUADRANTS.items():
        out = F.when(q == k, label).otherwise(out)
    return out


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def model_name(title: Column) -> Column:
    """The text inside parentheses."""
    return F.regexp_extract(title, r"\((.*?)\)", 1)


def round_half_even(value: Column, digits: int = 3) -> Column:
    return F.bround(value, digits)
