"""From stacks of slices to surfaces, regions and depths: one plan over all specimens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lamella.functions.profiles import first_crossing, refracted_depth, surface_peak
from lamella.operators.ascan import air_threshold, value_counts
from lamella.operators.depth import combined_depth, lesion_statistics, long_form, method_stability, primary_depth, shoulder, with_fit, with_knee
from lamella.operators.geometry import region_centres, region_pixels, region_statistics
from lamella.operators.surface import cavitation, cut, density_clusters, depth_curve, fitted_curve, large_clusters, reference_curve

KEYS = ["specimen_id", "slice"]


def scans_of(slices: DataFrame) -> DataFrame:
    """``specimen_id, slice, x, profile`` of grey slices (height, width, pixels row by row, a byte each); a slice of the wrong size has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                h, w = r["height"], r["width"]
                if r["pixels"] is None or not h or not w or len(r["pixels"]) != h * w:
                    continue
                columns = np.frombuffer(r["pixels"], dtype=np.uint8).reshape(h, w).T.astype(np.int16).ravel()
                profile = pa.ListArray.from_arrays(pa.array(np.arange(0, h * w + 1, h, dtype=np.int32)), pa.array(columns))
                yield pa.RecordBatch.from_arrays([pa.array([r["specimen_id"]] * w, pa.string()), pa.array([r["slice"]] * w, pa.int32()), pa.array(np.arange(w, dtype=np.int32)), profile], ["specimen_id", "slice", "x", "profile"])

    return slices.select(*KEYS, "height", "width", "pixels").mapInArrow(run, "specimen_id string, slice int, x int, profile array<smallint>")


def detected_surface(scans: DataFrame, configs: DataFrame, start_row: int = 25, least: int = 10, above: int = 180) -> dict[str, DataFrame]:
    """Raw and clustered surface points and both curves of each slice of ``configs``.

    ``configs(specimen_id, slice, start_x, lesion_start_x, lesion_end_x, end_x, buffer, air_left, air_top, air_right,
    air_bottom)``; without an air rectangle the slice's median is the threshold, without bounds the whole width counts.
    """
    counted = value_counts(scans.join(configs.select(*KEYS, "air_left", "air_top", "air_right", "air_bottom"), KEYS), KEYS)
    thresholds = air_threshold(counted, KEYS, "v", "air", "n")
    crossing = scans.join(thresholds, KEYS).withColumn("crossing", first_crossing(F.col("profile"), F.col("threshold"), start_row))
    raw = cut(crossing.select(*KEYS, "x", surface_peak(F.col("profile"), F.col("crossing")).alias("y")).where("y is not null"))
    clustered = density_clusters(raw.withColumn("pid", F.col("x")), KEYS, least=least)
    points = cut(large_clusters(clustered, KEYS, above))
    width = scans.groupBy(*KEYS).agg((F.max("x") + 1).alias("_w"))
    spans = configs.join(width, KEYS).select(*KEYS, F.coalesce("start_x", F.lit(0)).alias("start"), F.coalesce("end_x", "_w").alias("end"))
    actual = cut(fitted_curve(points, spans, KEYS, "actual_surface"))
    reference = cut(reference_curve(points, configs.where("lesion_start_x is not null"), KEYS))
    return {"raw": raw, "points": points, "actual": actual, "reference": reference}


def lesion_profiles(scans: DataFrame, actual: DataFrame, configs: DataFrame, depth: int = 200, least: int = 10) -> DataFrame:
    """Profiles from the surface down for each column of the lesion, a buffer from its bounds (the end exclusive); short ones are left out."""
    bounds = configs.select(*KEYS, (F.col("lesion_start_x") + F.col("buffer")).alias("_l"), (F.col("lesion_end_x") - F.col("buffer")).alias("_r"))
    rows = scans.join(actual.select(*KEYS, "x", F.col("y").alias("surface_y")), [*KEYS, "x"]).join(bounds, KEYS).where("x >= _l and x < _r and surface_y >= 0")
    below = F.slice("profile", F.col("surface_y").cast("int") + 1, depth)
    return rows.select(*KEYS, "x", "surface_y", F.transform(below, lambda v: v.cast("double")).alias("profile")).where(F.size("profile") >= least)


def lesion_depths(profiles: DataFrame, surface: dict[str, DataFrame], cavities: DataFrame, method: str = "combined") -> DataFrame:
    """A row for each column with a depth by the chosen method: all methods' depths and the corrected one."""
    smooth = with_fit(profiles, "exp2")
    curve = F.transform(F.col("profile"), lambda _, z: F.col("a") * F.exp(F.col("b") * z) + F.col("c") * F.exp(F.col("d") * z))
    rows = smooth.withColumn("profile_2", F.when(F.col("sse").isNotNull(), curve).otherwise(F.col("profile"))).drop("a", "b", "c", "d", "sse")
    rows = with_fit(with_knee(rows, "profile_2"), "sigmoid").withColumns({"inflection": F.col("z0"), "shoulder": shoulder(F.col("z0"), F.col("k"))})
    rows = cut(primary_depth(rows.select(*KEYS, "x", "surface_y", "knee", "inflection", "shoulder"), method))
    if method == "combined":
        stability = method_stability(long_form(rows, [*KEYS, "x"]), KEYS)
        rows = combined_depth(rows, stability, KEYS).withColumn("depth", F.col("combined")).where("depth is not null")
    reference = surface["reference"].select(*KEYS, "x", F.col("y").alias("reference_y"))
    rows = rows.join(reference, [*KEYS, "x"], "left").join(cavities.select(*KEYS, "cavitated"), KEYS, "left")
    corrected: Column = refracted_depth(F.col("depth"), F.coalesce("cavitated", F.lit(False)), F.col("surface_y"), F.col("reference_y"))
    return rows.withColumn("corrected", corrected)


def analysed(slices: DataFrame, configs: DataFrame, n_sound: int = 6, n_lesion: int = 6, method: str = "combined", least: int = 10, above: int = 180) -> dict[str, DataFrame]:
    """All tables of an analysis: surface points and curves, cavities, regions and their statistics, depths and theirs.

    Slices without a config are left out; those without a surface have no regions and no depths.
    """
    scans = scans_of(slices)
    surface = detected_surface(scans, configs, least=least, above=above)
    cavities = cavitation(surface["actual"], surface["reference"], configs, KEYS)
    centres = region_centres(configs.where("lesion_start_x is not null"), KEYS, n_sound, n_lesion)
    regions = region_pixels(centres, surface["actual"], scans, KEYS)
    depths = cut(lesion_depths(lesion_profiles(scans, surface["actual"], configs), surface, cavities, method))
    spans = depths.groupBy(*KEYS).agg(F.min("x").alias("start"), (F.max("x") + 1).alias("end"))
    smoothed = depth_curve(depths.select(*KEYS, "x", (F.col("surface_y") + F.col("depth")).alias("y")), spans, KEYS)
    return surface | {
        "cavities": cavities, "region_pixels": regions, "region_statistics": region_statistics(regions, KEYS), "depths": depths,
        "depth_statistics": lesion_statistics(depths, KEYS, "corrected"), "depth_curve": smoothed,
    }
