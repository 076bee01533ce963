"""The monitored regions and tagging of points by the boxes they fall into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeo.workspace import broadcast_if_small

# Key, name, box "west,south,east,north", centroid latitude and longitude.
REGIONS = [
    ("india_north", "India — North", "68,24,80,36", 30.0, 74.0),
    ("india_south", "India — South", "74,8,81,18", 13.0, 77.5),
    ("india_east", "India — East", "80,20,92,28", 24.0, 86.0),
    ("india_west", "India — West", "68,15,76,25", 20.0, 72.0),
    ("east_africa", "East Africa — Kenya/Tanzania", "28,-5,42,5", 0.0, 35.0),
    ("west_africa", "West Africa — Nigeria/Ghana", "-5,4,10,15", 9.0, 2.5),
    ("southern_africa", "Southern Africa", "22,-30,35,-20", -25.0, 28.5),
    ("brazil_central", "Brazil — Central", "-55,-25,-40,-10", -17.5, -47.5),
    ("brazil_amazon", "Brazil — Amazon", "-70,-10,-50,2", -4.0, -60.0),
    ("indonesia", "Indonesia", "95,-10,141,6", -2.0, 118.0),
    ("thailand", "Thailand", "97,5,106,21", 13.0, 101.5),
    ("vietnam", "Vietnam", "102,8,110,24", 16.0, 106.0),
    ("california", "California, USA", "-124,32,-114,42", 37.0, -119.0),
    ("southeast_us", "Southeast USA", "-92,25,-75,37", 31.0, -83.5),
    ("australia_nt", "Northern Territory, Australia", "125,-20,140,-10", -15.0, 132.5),
    ("australia_se", "Southeast Australia", "140,-40,155,-28", -34.0, 147.5),
    ("mediterranean", "Mediterranean Europe", "0,35,25,45", 40.0, 12.5),
    ("central_america", "Central America", "-92,8,-80,18", 13.0, -86.0),
    ("middle_east", "Middle East", "40,25,60,40", 32.5, 50.0),
    ("china_south", "Southern China", "100,20,120,30", 25.0, 110.0),
]


def region_table(spark: SparkSession) -> DataFrame:
    """Region dimension with the box parsed into four numbers."""
    raw = spark.createDataFrame(
        REGIONS,
        "region_key string, name string, bbox string, centroid_lat double, centroid_lon double",
    )
    return parse_boxes(raw)


def parse_boxes(regions: DataFrame, bbox: str = "bbox") -> DataFrame:
    part = F.split(bbox, ",")
    edges = ["west", "south", "east", "north"]
    return regions.withColumns(
        {edge: F.get(part, F.lit(i)).cast("double") for i, edge in enumerate(edges)}
    )


def _cells(low: str, high: str, size: float):
    return F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))


def tag_regions(
    points: DataFrame,
    regions: DataFrame,
    latitude: str = "latitude",
    longitude: str = "longitude",
    cell: float = 1.0,
) -> DataFrame:
    """Region rows for every box that holds the point; overlaps give several rows.

    Boxes are spread over grid cells first, so the match is an equi-join on the cell
    with the exact bounds as a residual filter. It never compares all pairs.
    """
    boxes = regions.select(
        "region_key",
        F.col("name").alias("region"),
        "west", "south", "east", "north",
        F.explode(_cells("south", "north", cell)).alias("_lat_cell"),
    )
    boxes = boxes.withColumn("_lon_cell", F.explode(_cells("west", "east", cell)))
    keyed = points.withColumns(
        {
            "_lat_cell": F.floor(F.col(latitude) / cell),
            "_lon_cell": F.floor(F.col(longitude) / cell),
        }
    )
    inside = F.col(latitude).between(F.col("south"), F.col("north")) & F.col(longitude).between(
        F.col("west"), F.col("east")
    )
    joined = keyed.join(broadcast_if_small(boxes), ["_lat_cell", "_lon_cell"])
    return joined.where(inside).select(*[points[c] for c in points.columns], "region", "region_key")


def tag_ranges(
    df: DataFrame, value: str, ranges: DataFrame, low: str, high: str, cell: float
) -> DataFrame:
    """One-dimensional form: a row per range with ``low <= value <= high``."""
    keyed = df.withColumn("_cell", F.floor(F.col(value) / cell))
    spread = ranges.withColumn("_cell", F.explode(_cells(low, high, cell)))
    joined = keyed.join(broadcast_if_small(spread), "_cell")
    return joined.where(F.col(value).between(F.col(low), F.col(high))).drop("_cell")
