"""Result tables of analyses and of hand measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def summary(statistics: DataFrame, depth: DataFrame, cavitation: DataFrame, keys: list[str], n_sound: int, n_lesion: int) -> DataFrame:
    """A row for each slice (one-based): the regions' medians, the mean depth (0 without one), TRUE, FALSE or blank for a cavity."""
    medians = [F.max(F.when((F.col("kind") == kind) & (F.col("index") == i), F.col("median"))).alias(f"{kind.upper()}_{i + 1}_MEDIAN") for kind, n in (("sound", n_sound), ("lesion", n_lesion)) for i in range(n)]
    rows = statistics.groupBy(*keys, "slice").agg(*medians)
    rows = rows.join(depth.select(*keys, "slice", F.col("mean").alias("_d")), [*keys, "slice"], "left").join(cavitation.select(*keys, "slice", "cavitated"), [*keys, "slice"], "left")
    flag = F.when(F.col("cavitated"), "TRUE").when(~F.col("cavitated"), "FALSE").otherwise("")
    return rows.withColumns({"SLICE": F.col("slice") + 1, "LESION_DEPTH_MEAN": F.coalesce("_d", F.lit(0.0)), "IS_CAVITATED": flag}).drop("_d", "cavitated")


def wide_pixels(pixels: DataFrame, keys: list[str], n_sound: int, n_lesion: int) -> DataFrame:
    """A row for each pixel place, a column for each region; regions with fewer pixels are null there."""
    columns = [F.max(F.when((F.col("kind") == kind) & (F.col("index") == i), F.col("v"))).alias(f"{kind}_{i + 1}") for kind, n in (("sound", n_sound), ("lesion", n_lesion)) for i in range(n)]
    return pixels.groupBy(*keys, "pixel").agg(*columns)


def surface_and_depth(raw: DataFrame, curves: DataFrame, depths: DataFrame, keys: list[str]) -> DataFrame:
    """One long table ``keys, type, x, y`` of the raw surface, all named curves and the lesion depths."""
    part = lambda df, kind: df.select(*keys, kind.alias("type"), F.col("x").cast("int").alias("x"), F.col("y").cast("double").alias("y"))
    return part(raw, F.lit("raw_surface")).unionByName(part(curves, F.concat(F.lit("curve_"), F.col("curve")))).unionByName(part(depths, F.lit("lesion_depth")))


def specimen_status(done: Column, total: Column, cancelled: Column) -> Column:
    """Completed unless stopped before the last slice: then Partial, or Cancelled before the first."""
    return F.when(~cancelled | ((done >= total) & (done > 0)), "Completed").when(done == 0, "Cancelled").otherwise("Partial")


def export_status(error: Column, failed: Column) -> Column:
    return F.when(error.isNotNull(), F.lit("Error")).when(failed > 0, F.format_string("Done (%d failed)", failed)).otherwise(F.lit("Done"))


def failed_slices(planned: Column, exported: Column) -> Column:
    return F.greatest(planned - exported, F.lit(0))


def load_summary(specimens: DataFrame) -> DataFrame:
    """``total, analysed, missing``: specimens, those with results, those without coordinates."""
    return specimens.agg(F.count("*").alias("total"), F.count_if("has_results").alias("analysed"), F.count_if(~F.col("has_coordinates")).alias("missing"))


def region_counts(statistics: DataFrame, keys: list[str]) -> DataFrame:
    return statistics.groupBy(*keys, "kind").agg(F.count("*").alias("n"))


def column_order(columns: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``order`` from 0 and ``position_after``, the column before or SLICE; repeated names or keys are marked."""
    w = Window.partitionBy(*keys).orderBy(by)
    repeated = lambda c: F.col(c).isNotNull() & (F.count("*").over(Window.partitionBy(*keys, c)) > 1)
    return columns.withColumns({"order": (F.row_number().over(w) - 1).cast("int"), "position_after": F.lag("name", 1, "SLICE").over(w), "duplicate": repeated("name") | repeated("keybinding")})


def key_map(columns: DataFrame, keys: list[str]) -> DataFrame:
    """Map from key to column of those that have a key."""
    bound = columns.where(F.length(F.coalesce("keybinding", F.lit(""))) > 0)
    return bound.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("keybinding", "name")))).alias("key_map"))


#: The columns that every row of a measurement table has, in their order.
STATIC_COLUMNS = ("SPECIMEN_NAME", "SLICE", "OPERATOR", "MEASUREMENT", "SYSTEM", "DATE_TIME")


def wide_measurements(cells: DataFrame, keys: list[str], columns: list[str], static: dict[str, Column] | None = None) -> DataFrame:
    """A row for each specimen and slice, a column for each measured column.

    ``static`` gives STATIC_COLUMNS as aggregates over a row's cells (those left out are empty); the measured
    columns then stand behind SLICE, and keys of the same name as a static column, in any case, give way to it.
    """
    measured = [F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns]
    if static is None:
        return cells.groupBy(*keys).agg(*measured)
    known = [static.get(c, F.lit("")).cast("string").alias(c) for c in STATIC_COLUMNS]
    rows = cells.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(*known[:2], *measured, *known[2:])
    own = [F.col(f"_key_{k}").alias(k) for k in keys if k.upper() not in STATIC_COLUMNS]
    return rows.select(*own, *rows.columns[len(keys) :])


def written_at(time: Column) -> Column:
    """DATE_TIME of a row: when its last cell was entered."""
    return F.date_format(F.max(time), "yyyy-MM-dd HH:mm:ss")


def labelled(cells: DataFrame, columns: DataFrame, keys: list[str], kinds: tuple[str, ...] = ("Boolean", "Categorical", "Ordinal", "Text")) -> DataFrame:
    """Cells of the kinds that are shown as labels, with their column's type and colour."""
    spec = columns.select(*keys, F.col("name").alias("column"), "data_type", "color")
    return cells.join(spec, [*keys, "column"], "left").where(F.col("data_type").isin(*kinds))


def completeness(specimens: DataFrame, regions: DataFrame, air: DataFrame) -> DataFrame:
    """What coordinates each specimen lacks: region or air missing, or some without a point."""
    points = ("specimen_start", "lesion_start", "lesion_end", "specimen_end")
    r = regions.groupBy("specimen_id").agg(F.bool_or(F.greatest(*[F.col(p).isNull().cast("int") for p in points]) == 1).alias("_r"))
    a = air.groupBy("specimen_id").agg(F.bool_or(F.col("point1").isNull()).alias("_a"))
    rows = specimens.join(r, "specimen_id", "left").join(a, "specimen_id", "left")
    missing = [F.when(F.col("_r").isNull(), F.lit("region missing")), F.when(F.col("_r"), F.lit("region incomplete")), F.when(F.col("_a").isNull(), F.lit("air missing")), F.when(F.col("_a"), F.lit("air incomplete"))]
    return rows.withColumn("missing", F.array_compact(F.array(*missing))).drop("_r", "_a")


def chosen_run(specimens: DataFrame, runs: DataFrame, operator: str, measurement: str) -> DataFrame:
    """Each specimen with the run of this operator and measurement, or else the first earlier run that has a config."""
    exact = (F.col("operator") == operator) & (F.col("measurement") == measurement)
    usable = runs.where(exact | F.col("has_config"))
    best = Window.partitionBy("specimen_id").orderBy(exact.desc(), "run_order")
    first = usable.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
    return specimens.join(first, "specimen_id", "left")
