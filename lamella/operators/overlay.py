"""What to draw over a slice, as rows: air, bounds, curves, depths and regions with their colours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lamella.operators.geometry import turned_centres

#: Colours and line widths of the layers.
COLOURS = {
    "air": "#37bfe9", "specimen_boundary": "#4CAF50", "lesion_boundary": "#FFD700", "interpolated_surface": "#e600e6", "actual_surface": "#00b0e6",
    "lesion_depth": "#f71134", "sound": "#00FF88", "lesion": "#f71134",
}
WIDTHS = {"interpolated_surface": 1}


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _layer(df: DataFrame, keys: list[str], layer: Column, colour: Column, points: Column, label: Column | None = None) -> DataFrame:
    width = reduce(lambda c, k: F.when(layer == k, F.lit(WIDTHS[k])).otherwise(c), WIDTHS, F.lit(2))
    return df.select(*keys, layer.alias("layer"), colour.alias("color"), width.alias("width"), points.alias("points"), (F.lit(None).cast("string") if label is None else label).alias("label"))


def _lines(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    return df.groupBy(*keys, *by).agg(F.array_sort(F.collect_list(_point(F.col("x"), F.col("y")))).alias("p"))


def region_corners(centres: DataFrame, curve: DataFrame, keys: list[str], size: int = 24, offset: int = 10) -> DataFrame:
    """Regions (keys, kind, index, centre) with the four corners of their squares below the curve, turned with it."""
    rows, angle, half = turned_centres(centres, curve, keys), F.col("angle"), size / 2
    middle = F.col("y") + offset + half
    corner = lambda dx, dy: _point(F.col("centre") + dx * F.cos(angle) - dy * F.sin(angle), middle + dx * F.sin(angle) + dy * F.cos(angle))
    return rows.withColumn("corners", F.array(*[corner(dx, dy) for dx, dy in ((-half, -half), (half, -half), (half, half), (-half, half))])).select(*keys, "kind", "index", "centre", middle.alias("middle"), "corners")


def overlay(configs: DataFrame, curves: DataFrame, depths: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, layer, color, width, points, label``: one row for each line or polygon over a slice.

    ``configs`` has the bounds, the picture's height and the air rectangle, each left out where null; ``curves``
    (curve, x, y); ``depths`` (x, y, and smoothed_y, which is drawn where it is known); ``regions`` as from
    ``region_corners``, labelled with their number in the middle.
    """
    c = F.col
    box = F.array(*[_point(c(f"air_{x}"), c(f"air_{y}")) for x, y in (("left", "top"), ("right", "top"), ("right", "bottom"), ("left", "bottom"), ("left", "top"))])
    parts = [_layer(configs.where("air_left is not null"), keys, F.lit("air"), F.lit(COLOURS["air"]), box)]
    for name in ("start_x", "lesion_start_x", "lesion_end_x", "end_x"):
        kind = "lesion_boundary" if name.startswith("lesion") else "specimen_boundary"
        parts.append(_layer(configs.where(c(name).isNotNull()), keys, F.lit(kind), F.lit(COLOURS[kind]), F.array(_point(c(name), F.lit(0)), _point(c(name), c("height")))))
    lines = _lines(curves, keys, ["curve"])
    colour = reduce(lambda x, k: F.when(c("curve") == k, F.lit(COLOURS[k])).otherwise(x), ("interpolated_surface", "actual_surface"), F.lit(None).cast("string"))
    parts.append(_layer(lines.where("size(p) > 1").where(colour.isNotNull()), keys, c("curve"), colour, c("p")))
    deep = _lines(depths.withColumn("y", F.coalesce("smoothed_y", "y")), keys, [])
    parts.append(_layer(deep.where("size(p) > 1"), keys, F.lit("lesion_depth"), F.lit(COLOURS["lesion_depth"]), c("p")))
    closed = F.concat("corners", F.slice("corners", 1, 1))
    parts.append(_layer(regions, keys, F.concat(c("kind"), F.lit("_region")), F.when(c("kind") == "sound", COLOURS["sound"]).otherwise(COLOURS["lesion"]), closed, (c("index") + 1).cast("string")))
    return reduce(DataFrame.unionByName, parts)
