"""Operators on pixels and depth profiles before any surface is known."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lamella.operators.series import sliding


def value_counts(scans: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, air, v, n``: how often each whole value occurs in the profiles of each key, inside and outside its air rectangle.

    ``scans`` has x, profile and the rectangle's air_left, air_top, air_right, air_bottom (ends exclusive), all null without one. A batch of
    scans gives a row for each value that it holds, 256 a key and side for bytes, so pixels are never rows. Nulls aren't counted.
    """
    box = ["air_left", "air_top", "air_right", "air_bottom"]
    kind = dict(scans.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            profiles = batch.column("profile")
            sizes = np.array([len(p) if p.is_valid else 0 for p in profiles])
            flat = profiles.flatten()
            seen = flat.is_valid().to_numpy(zero_copy_only=False)
            value = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            scan = np.repeat(np.arange(len(batch)), sizes)
            row = np.arange(len(value)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            x, left, top, right, bottom = (np.nan_to_num(batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False), nan=-1.0) for c in ["x", *box])
            air = ((x >= left) & (x < right))[scan] & (row >= top[scan]) & (row < bottom[scan])
            code: dict[tuple, int] = {}
            group = np.array([code.setdefault(k, len(code)) for k in zip(*(batch.column(c).to_pylist() for c in keys), strict=True)])
            found, n = np.unique(np.stack((group[scan], air, value))[:, seen], axis=1, return_counts=True)
            first = np.unique(group, return_index=True)[1]
            same = pa.array(first[found[0]])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(same) for c in keys), pa.array(found[1].astype(bool)), pa.array(found[2]), pa.array(n.astype(np.int64))], [*keys, "air", "v", "n"])

    return scans.select(*keys, "x", "profile", *box).mapInArrow(run, ", ".join(f"`{k}` {kind[k]}" for k in keys) + ", air boolean, v long, n long")


def air_threshold(pixels: DataFrame, keys: list[str], value: str = "v", in_air: str | None = None, count: str | None = None) -> DataFrame:
    """Brightness that leaves air: 1.6 times the 95th percentile inside the air rectangle, or the median of the slice without one.

    ``in_air`` names a boolean column; slices without a true row take the median. Nulls are ignored. ``count`` names how often a row's
    value occurs (see ``value_counts``); the percentiles are those of all occurrences.
    """
    v, n = F.col(value), F.col(count) if count else F.lit(1)
    inside = F.percentile(F.when(F.col(in_air), v), F.lit(0.95), n) * 1.6 if in_air else F.lit(None).cast("double")
    return pixels.groupBy(*keys).agg(F.coalesce(inside, F.percentile(v, F.lit(0.5), n)).alias("threshold"))


def _series(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, span: int, out: str = "smooth") -> DataFrame:
    """Centred mean over ``span`` rows (odd; an even one is one less) whose window shrinks evenly at both ends."""
    half = (span - 1) // 2
    w = _series(keys, order)
    numbered = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    reach = F.least(F.lit(half), F.col("_i"), F.col("_n") - 1 - F.col("_i"))
    mean: Column = F.col(value).cast("double")
    for h in range(1, half + 1):
        mean = F.when(reach >= h, F.avg(value).over(w.rowsBetween(-h, h))).otherwise(mean)
    return numbered.withColumn(out, mean).drop("_i", "_n")


def speckle_median(df: DataFrame, keys: list[str], order: list[str], value: str, below: float = 100.0, out: str = "filtered") -> DataFrame:
    """Values under ``below`` become the median of five rows; beyond an edge the rows are mirrored, the edge row included."""
    w = _series(keys, order)
    v = F.col(value)
    back, ahead = {k: F.lag(value, k).over(w) for k in (1, 2, 3)}, {k: F.lead(value, k).over(w) for k in (1, 2, 3)}
    # one row beyond the edge is the edge itself, two rows beyond the one next to it; a single row stands for all
    up1, down1 = F.coalesce(back[1], v), F.coalesce(ahead[1], v)
    up2 = F.coalesce(back[2], F.when(back[1].isNull(), F.coalesce(ahead[1], v)).otherwise(back[1]))
    down2 = F.coalesce(ahead[2], F.when(ahead[1].isNull(), F.coalesce(back[1], v)).otherwise(ahead[1]))
    staged = df.withColumn("_five", F.array(up2, up1, v, down1, down2))
    return staged.withColumn(out, F.when(v < below, F.get(F.array_sort("_five"), F.lit(2))).otherwise(v)).drop("_five")


def speckle_median_square(pixels: DataFrame, keys: list[str], below: float = 50.0, out: str = "filtered") -> DataFrame:
    """The older filter: pixels (x, y, v) under ``below`` become the median of their 3 by 3 neighbours inside the picture."""
    offsets = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    dark = pixels.where(F.col("v") < below).withColumn("_o", offsets)
    around = dark.select(*keys, F.col("x").alias("_x"), F.col("y").alias("_y"), (F.col("x") + F.col("_o.dx")).alias("x"), (F.col("y") + F.col("_o.dy")).alias("y"))
    medians = around.join(pixels, [*keys, "x", "y"]).groupBy(*keys, F.col("_x").alias("x"), F.col("_y").alias("y")).agg(F.median("v").alias("_m"))
    return pixels.join(medians, [*keys, "x", "y"], "left").withColumn(out, F.coalesce("_m", F.col("v").cast("double"))).drop("_m")


def noise_floor(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "noise", block: int = 8192) -> DataFrame:
    """Running mean of a noise estimate over 256 scans, those beyond the ends counted as 0; series are cut into blocks with borders."""
    return sliding(df, keys, order, 128, 127, lambda w: F.sum(value).over(w) / 256, out, block)


def averaged_scans(points: DataFrame, keys: list[str], scan: str, n: int) -> DataFrame:
    """Groups of ``n`` scans in one: ``incoherent`` mean of amplitudes, ``coherent`` amplitude of the mean, ``first`` scan's amplitude.

    ``points`` has a row for each scan and depth with ``re`` and ``im``.
    """
    group = F.floor(F.col(scan) / n).cast("long").alias("group")
    size = F.hypot("re", "im")
    return points.groupBy(*keys, group).agg(
        F.avg(size).alias("incoherent"), F.hypot(F.avg("re"), F.avg("im")).alias("coherent"), F.min_by(size, scan).alias("first"),
    )


def without_outliers(df: DataFrame, keys: list[str], order: list[str], value: str, kernel: int = 7, deviations: float = 2.0) -> DataFrame:
    """Adds ``filtered``, the median over ``kernel`` rows with zeros beyond the ends, and ``kept``: the residual is within ``deviations`` of its mean.

    Where fewer than four rows of a series would be kept, all are.
    """
    half = kernel // 2
    w = _series(keys, order)
    near = F.collect_list(F.col(value).cast("double")).over(w.rowsBetween(-half, half))
    padded = F.array_sort(F.concat(near, F.array_repeat(F.lit(0.0), F.lit(kernel) - F.size(near))))
    staged = df.withColumn("filtered", F.get(padded, F.lit(half)))
    rest = F.col(value) - F.col("filtered")
    whole = Window.partitionBy(*keys)
    staged = staged.withColumns({"_m": F.avg(rest).over(whole), "_s": F.stddev_pop(rest).over(whole)})
    good = F.abs(rest - F.col("_m")) <= deviations * F.col("_s")
    staged = staged.withColumn("_good", good).withColumn("_n", F.sum(F.col("_good").cast("int")).over(whole))
    return staged.withColumn("kept", F.when(F.col("_n") < 4, F.lit(True)).otherwise(F.col("_good"))).drop("_m", "_s", "_n", "_good")


def inspected(profile: Column, surface_y: Column, depth: int = 200) -> Column:
    """Rows of a profile as (y, v, segment): above the surface, in the fitted range, below it."""
    part = lambda i: F.when(i < surface_y, "above").when(i < surface_y + depth, "fitting").otherwise("below")
    return F.transform(profile, lambda v, i: F.struct(i.alias("y"), v.alias("v"), part(i).alias("segment")))
