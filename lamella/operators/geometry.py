"""Selection of slices, keyframes, regions, lengths, and new views of volumes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructType


def equidistant_truncated(first: Column, last: Column, n: Column) -> Column:
    """Zero-based slices for an export: ``n`` even steps from first to last (one-based), cut down to whole ones; the last is exact."""
    step = (last - first) / (n - 1)
    return F.when(n <= 0, F.array().cast("array<int>")).when(n == 1, F.array((first - 1).cast("int"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.when(i == n - 1, last - 1).otherwise(first - 1 + i * step).cast("int"))
    )


def equidistant_rounded(first: Column, last: Column, n: Column) -> Column:
    """One-based slices for the settings: none for n of 0, the middle for 1, all if n exceeds them, else even steps rounded half to even."""
    count = last - first + 1
    step = (last - first) / (n - 1)
    return (
        F.when(n <= 0, F.array().cast("array<int>")).when(n == 1, F.array(F.floor((first + last) / 2).cast("int")))
        .when(n >= count, F.sequence(first.cast("int"), last.cast("int")))
        .otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.bround(first + i * step).cast("int")))
    )


def slices_to_load(direction: Column, selected: Column, dim_y: Column) -> Column:
    """Slices that must be read: the selected ones if they are stored slices, else all of them."""
    return F.when(direction == "XZ", selected).otherwise(F.sequence(F.lit(0), dim_y - 1))


def resliced(pixels: DataFrame, direction: str) -> DataFrame:
    """Pixels (slice, y, x, v) of a volume as (k, row, col, v) of its slices along ``direction``."""
    k, row, col = {"XZ": ("slice", "y", "x"), "YZ": ("x", "y", "slice"), "XY": ("y", "slice", "x")}[direction]
    rest = [c for c in pixels.columns if c not in ("slice", "y", "x", "v")]
    return pixels.select(*rest, F.col(k).alias("k"), F.col(row).alias("row"), F.col(col).alias("col"), "v")


def zoomed(pixels: DataFrame, keys: list[str], rows: float = 1.0, cols: float = 1.0) -> DataFrame:
    """Nearest-neighbour zoom of (row, col, v) pictures by a factor each way; every source pixel makes its copies."""
    size = pixels.groupBy(*keys).agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))
    out = pixels.join(size, keys)
    for axis, n, factor in (("row", "_h", rows), ("col", "_w", cols)):
        new = F.greatest(F.bround(F.col(n) * factor).cast("int"), F.lit(1))
        ratio = F.when(new > 1, (F.col(n) - 1) / (new - 1)).otherwise(F.lit(0.0))
        # targets near the source; those that round to it are its copies
        low = F.when(ratio > 0, F.floor((F.col(axis) - 1) / ratio)).otherwise(F.lit(0))
        high = F.when(ratio > 0, F.ceil((F.col(axis) + 1) / ratio)).otherwise(F.when(F.col(axis) == 0, new - 1).otherwise(F.lit(-1)))
        places = F.sequence(F.greatest(low.cast("int"), F.lit(0)), F.greatest(F.least(high.cast("int"), new - 1), F.lit(0)))
        out = out.withColumn(axis, F.explode(F.filter(places, _nearest(axis, ratio))))
    return out.drop("_h", "_w")


def _nearest(axis: str, ratio: Column):
    return lambda t: F.floor(t * ratio + 0.5) == F.col(axis)


def straight(before: Column, after: Column, t: Column) -> Column:
    """The point at share ``t`` of the way between two, cut towards zero."""
    return F.struct(*[(before[c] + t * (after[c] - before[c])).cast("int").alias(c) for c in ("x", "y")])


def interpolated_keyframes(frames: DataFrame, spine: DataFrame, keys: list[str], points: list[str], slice_col: str = "slice", between: Callable[[Column, Column, Column], Column] = straight) -> DataFrame:
    """A row for every slice of ``spine`` with the points of its keyframes.

    Between two keyframes every point goes as ``between`` says, by default in a straight line; before the first
    and after the last they are copied. Optional points go the same way where both keyframes have them, stay
    as they are where only the earlier has, and are null where it has none. Other columns come from the
    keyframe before. A series without a keyframe stays as it is.
    """
    rest = [c for c in frames.columns if c not in (*keys, slice_col, *points, "is_keyframe")]
    marked = frames.where("is_keyframe").withColumn("_f", F.struct(F.col(slice_col).alias("at"), *points, *rest)).select(*keys, slice_col, "_f")
    own = frames.withColumn("_own", F.struct(*points, *rest)).select(*keys, slice_col, "_own")
    rows = spine.select(*keys, slice_col).join(marked, [*keys, slice_col], "left").join(own, [*keys, slice_col], "left")
    w = Window.partitionBy(*keys).orderBy(slice_col)
    before = F.last("_f", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_f", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"_b": F.coalesce(before, after), "_a": F.coalesce(after, before)})
    t = F.when(F.col("_a.at") > F.col("_b.at"), (F.col(slice_col) - F.col("_b.at")) / (F.col("_a.at") - F.col("_b.at"))).otherwise(F.lit(0.0))

    def moved(p: str) -> Column:
        b, a = F.col("_b")[p], F.col("_a")[p]
        point = F.when(b.isNull(), F.lit(None)).when(a.isNull(), b).otherwise(between(b, a, t))
        return F.when(F.col("_b").isNull(), F.col("_own")[p]).otherwise(point).alias(p)

    other = [F.when(F.col("_b").isNull(), F.col("_own")[c]).otherwise(F.col("_b")[c]).alias(c) for c in rest]
    return rows.select(*keys, slice_col, *[moved(p) for p in points], *other, F.coalesce(F.col("_f.at").isNotNull(), F.lit(False)).alias("is_keyframe"))


def region_centres(df: DataFrame, keys: list[str], n_sound: int, n_lesion: int) -> DataFrame:
    """``kind, index, centre`` of the regions of each row (start_x, lesion_start_x, lesion_end_x, end_x, buffer).

    Half of the sound regions lie left of the lesion, half right of it, and the lesion's inside it, a buffer
    from its bounds, evenly: the centre is cut to a whole column.
    """
    half = n_sound // 2

    def spread(kind: str, low: Column, high: Column, n: int, first: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(max(n - 1, 0))), lambda i: F.struct(F.lit(kind).alias("kind"), (i + first).alias("index"), (low + (high - low) / (n + 1) * (i + 1)).cast("int").alias("centre")))

    b = F.col("buffer")
    parts = []
    if half:
        parts += [spread("sound", F.col("start_x"), F.col("lesion_start_x") - b, half, 0), spread("sound", F.col("lesion_end_x") + b, F.col("end_x"), half, half)]
    if n_lesion:
        parts.append(spread("lesion", F.col("lesion_start_x") + b, F.col("lesion_end_x") - b, n_lesion, 0))
    return df.select(*keys, F.explode(F.concat(*parts)).alias("r")).select(*keys, "r.*")


def turned_centres(centres: DataFrame, curve: DataFrame, keys: list[str], reach: int = 10) -> DataFrame:
    """Regions (keys, kind, index, centre) with the curve's ``y`` there and the ``angle`` of its slope.

    The slope is between the columns ``reach`` to either side, or the curve's ends where these are nearer; a missing
    point stands at the centre's height. Regions off the curve are left out.
    """
    ends = curve.groupBy(*keys).agg(F.min("x").alias("_low"), F.max("x").alias("_high"))
    at = lambda name, x: curve.select(*keys, F.col("x").alias(x), F.col("y").alias(name))
    rows = centres.join(at("y", "centre"), [*keys, "centre"]).join(ends, keys)
    rows = rows.withColumns({"_left": F.greatest("_low", F.col("centre") - reach), "_right": F.least("_high", F.col("centre") + reach)})
    rows = rows.join(at("_yl", "_left"), [*keys, "_left"], "left").join(at("_yr", "_right"), [*keys, "_right"], "left")
    slope = (F.coalesce("_yr", "y") - F.coalesce("_yl", "y")) / F.nullif(F.col("_right") - F.col("_left"), F.lit(0))
    return rows.select(*keys, "kind", "index", "centre", "y", F.coalesce(F.atan(slope), F.lit(0.0)).alias("angle"))


def region_pixels(centres: DataFrame, curve: DataFrame, scans: DataFrame, keys: list[str], size: int = 24, offset: int = 10) -> DataFrame:
    """Pixels of square regions below the fitted surface, turned with it: ``keys, kind, index, pixel, v``.

    Each of ``size`` by ``size`` places is turned about the centre and read at the nearest pixel, halves going to the even
    one; places outside the picture are left out. ``scans`` has x and profile, a column of the picture: a region
    meets each column that it touches once, with the list of its places there, and their values are taken from the array.
    """
    placed = turned_centres(centres, curve, keys)
    half = size / 2
    middle = F.col("y") + offset + half

    def place(pixel: Column) -> Column:
        dx, dy = pixel % size - half, F.floor(pixel / size) - half
        x = F.bround(F.col("centre") + dx * F.cos("angle") - dy * F.sin("angle")).cast("int")
        return F.struct(pixel.alias("pixel"), x.alias("x"), F.bround(middle + dx * F.sin("angle") + dy * F.cos("angle")).cast("int").alias("y"))

    rows = placed.select(*keys, "kind", "index", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), place).alias("_places"))
    rows = rows.withColumn("x", F.explode(F.array_distinct(F.col("_places.x"))))
    here = F.filter("_places", lambda p: (p["x"] == F.col("x")) & (p["y"] >= 0))
    met = rows.select(*keys, "kind", "index", "x", here.alias("_places")).join(scans.select(*keys, "x", "profile"), [*keys, "x"])
    read = F.transform(F.filter("_places", lambda p: p["y"] < F.size("profile")), lambda p: F.struct(p["pixel"].alias("pixel"), F.get("profile", p["y"]).alias("v")))
    return met.select(*keys, "kind", "index", F.inline(read)).where("v is not null")


def region_statistics(sampled: DataFrame, keys: list[str]) -> DataFrame:
    """``n, mean, median, sd, se`` of each region's pixels; regions without pixels are absent."""
    v = F.col("v")
    return sampled.groupBy(*keys, "kind", "index").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("sd"), (F.stddev_pop(v) / F.sqrt(F.count(v))).alias("se"))


def polyline_length(points: Column) -> Column:
    """Length of the line through an array of points; fewer than two have 0."""
    ahead = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    legs = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), ahead, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.coalesce(F.aggregate(legs, F.lit(0.0), lambda s, d: s + d), F.lit(0.0))


def _second_derivatives(h: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Second derivatives at all points: continuity of the first derivative inside, of the third next to the ends.

    The end conditions are put into the rows beside them; the rest has three diagonals and is solved in one sweep.
    """
    left, middle, ahead = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    middle[0] += h[0] * (1 + h[0] / h[1])
    ahead[0] -= h[0] * h[0] / h[1]
    middle[-1] += h[-1] * (1 + h[-1] / h[-2])
    left[-1] -= h[-1] * h[-1] / h[-2]
    low, mid, up = left.tolist(), middle.tolist(), ahead.tolist()
    one, two = right[:, 0].tolist(), right[:, 1].tolist()
    for i in range(1, len(mid)):
        w = low[i] / mid[i - 1]
        mid[i] -= w * up[i - 1]
        one[i] -= w * one[i - 1]
        two[i] -= w * two[i - 1]
    one[-1], two[-1] = one[-1] / mid[-1], two[-1] / mid[-1]
    for i in range(len(mid) - 2, -1, -1):
        one[i] = (one[i] - up[i] * one[i + 1]) / mid[i]
        two[i] = (two[i] - up[i] * two[i + 1]) / mid[i]
    inner = np.array([one, two]).T
    first = (1 + h[0] / h[1]) * inner[0] - h[0] / h[1] * inner[1]
    last = (1 + h[-1] / h[-2]) * inner[-1] - h[-1] / h[-2] * inner[-2]
    return np.vstack((first, inner, last))


def spline(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` points of the cubic curve through ``points``, by chord length, with not-a-knot ends; the points themselves under four."""
    t = np.concatenate(([0.0], np.cumsum(np.hypot(*np.diff(points, axis=0).T))))
    keep = np.concatenate(([True], np.diff(t) > 0))
    points, t = points[keep], t[keep]
    m = len(t)
    if m < 4:
        return points
    t = t / t[-1]
    h = np.diff(t)
    bend = _second_derivatives(h, 6 * np.diff(np.diff(points, axis=0) / h[:, None], axis=0))
    u = np.linspace(0, 1, n)
    k = np.clip(np.searchsorted(t, u, "right") - 1, 0, m - 2)
    a, b, hk = (t[k + 1] - u)[:, None], (u - t[k])[:, None], h[k][:, None]
    return (bend[k] * a**3 + bend[k + 1] * b**3) / (6 * hk) + (points[k] / hk - bend[k] * hk / 6) * a + (points[k + 1] / hk - bend[k + 1] * hk / 6) * b


def with_length(df: DataFrame, points: str = "points", mode: str = "mode", out: str = "length", samples: int = 1000) -> DataFrame:
    """Adds an annotation's length: of the polyline, or for mode ``spline`` with four points or more, of the curve through them."""
    curved = (F.col(mode) == "spline") & (F.size(points) >= 4)
    kept = df.drop(out).withColumn("_xy", F.when(curved, F.struct(F.transform(points, lambda p: p["x"].cast("double")).alias("x"), F.transform(points, lambda p: p["y"].cast("double")).alias("y"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for xy in batch.column(batch.num_columns - 1).to_pylist():
                curve = None if xy is None else spline(np.array([xy["x"], xy["y"]], dtype=np.float64).T, samples)
                found.append(None if curve is None else float(np.hypot(*np.diff(curve, axis=0).T).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "_curve"])

    staged = kept.mapInArrow(run, StructType([*kept.schema.fields]).add("_curve", DoubleType()))
    return staged.withColumn(out, F.coalesce("_curve", polyline_length(F.col(points)))).drop("_xy", "_curve")
