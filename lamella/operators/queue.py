"""An export queue as a table: a position for each row, edits as new positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lamella.functions.rules import DIRECTIONS, db_window, dimension, dispersion_of_serial


def renumbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Positions 0, 1, ... in the present order of each queue."""
    return df.withColumn("position", (F.row_number().over(Window.partitionBy(*keys).orderBy("position")) - 1).cast("int"))


def reordered(df: DataFrame, keys: list[str], source: int | Column, target: int | Column) -> DataFrame:
    """Move the row at ``source`` to ``target``; those between close up. Places outside the queue change nothing."""
    source, target, p = F.lit(source), F.lit(target), F.col("position")
    n = F.count("*").over(Window.partitionBy(*keys))
    moved = F.when(p == source, target).when((p > source) & (p <= target), p - 1).when((p < source) & (p >= target), p + 1).otherwise(p)
    fine = source.between(0, n - 1) & target.between(0, n - 1)
    return df.withColumn("position", F.when(fine, moved).otherwise(p).cast("int"))


def added(df: DataFrame, items: DataFrame, keys: list[str], position: int | None = None, check: Column | None = None) -> DataFrame:
    """``items`` (one a queue) put in at a place, or behind the last; those that ``check`` finds not valid stay out (see ``rejected``)."""
    kept = items if check is None else items.where(check["is_valid"])
    size = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    place = F.least(F.lit(position), F.coalesce("_n", F.lit(0))) if position is not None else F.coalesce("_n", F.lit(0))
    new = kept.join(size, keys, "left").withColumn("position", place.cast("int")).drop("_n")
    shifted = df.join(new.select(*keys, F.col("position").alias("_at")), keys, "left").withColumn("position", F.when(F.col("position") >= F.col("_at"), F.col("position") + 1).otherwise(F.col("position")).cast("int")).drop("_at")
    return shifted.unionByName(new.select(shifted.columns))


def rejected(items: DataFrame, check: Column) -> DataFrame:
    """Items that ``added`` leaves out, with the messages of the rule: ``errors`` and ``warnings``."""
    return items.withColumn("_v", check).where(~F.col("_v.is_valid")).withColumns({"errors": F.col("_v.errors"), "warnings": F.col("_v.warnings")}).drop("_v")


def removed_at(df: DataFrame, keys: list[str], position: int) -> DataFrame:
    """Without the row at one ``position``; a queue that has no such place stays whole and says so in ``error``."""
    fine = F.lit(position).between(0, F.count("*").over(Window.partitionBy(*keys)) - 1)
    marked = df.withColumn("error", F.when(~fine, F.lit(f"index {position} out of bounds")))
    return renumbered(marked.where(F.col("error").isNotNull() | (F.col("position") != position)), keys)


def removed(df: DataFrame, keys: list[str], positions: list[int]) -> DataFrame:
    """Without the rows at ``positions``, those that don't exist ignored, and numbered anew."""
    return renumbered(df.where(~F.col("position").isin(positions)) if positions else df, keys)


def with_status(df: DataFrame, status: str, where: Column | None = None) -> DataFrame:
    return df.withColumn("status", F.when(F.lit(True) if where is None else where, F.lit(status)).otherwise(F.col("status")))


def of_status(df: DataFrame, status: str) -> DataFrame:
    return df.where(F.col("status") == status)


def updated(df: DataFrame, values: dict[str, Column], where: Column | None = None) -> DataFrame:
    """New values of fields for the rows ``where`` holds, or for all; all are worked out from the old row. Unknown fields are an error."""
    unknown = sorted(set(values) - set(df.columns))
    if unknown:
        raise ValueError(f"unknown fields {unknown}")
    return df.withColumns({c: v if where is None else F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def with_direction(df: DataFrame, headers: DataFrame, direction: str) -> DataFrame:
    """A direction for all rows with a path; the last slice and the count follow the header's size along it."""
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}")
    rows = df.join(headers.select("file_path", "dim_x", "dim_y", "dim_z"), "file_path", "left")
    size = dimension(F.lit(direction), F.col("dim_x"), F.col("dim_y"), F.col("dim_z"))
    some = F.length(F.coalesce("file_path", F.lit(""))) > 0
    changed = {
        "slice_direction": F.when(some, F.lit(direction)).otherwise(F.col("slice_direction")),
        "last_slice": F.when(some & size.isNotNull(), size).otherwise(F.col("last_slice")),
        "num_slices": F.when(some & size.isNotNull(), size - F.col("first_slice") + 1).otherwise(F.col("num_slices")),
    }
    return rows.withColumns(changed).select(df.columns)


def queue_items(headers: DataFrame, sidecars: DataFrame) -> DataFrame:
    """An item for each archive and view of its sidecar; without one, all XZ slices.

    ``headers(file_path, data_type, serial, dim_x, dim_y, dim_z)`` meet ``sidecars(file_path, view, start, end, n,
    index)``; windows and dispersion come from the data type and the serial number.
    """
    named = sidecars.select("file_path", *[F.col(c).alias(f"_{c}") for c in ("view", "start", "end", "n", "index")])
    rows = headers.join(named, "file_path", "left")
    window = db_window(F.col("data_type"))
    return rows.select(
        "file_path", F.coalesce("_view", F.lit("XZ")).alias("slice_direction"), F.coalesce("_start", F.lit(1)).alias("first_slice"), F.coalesce("_end", F.col("dim_y")).alias("last_slice"),
        F.coalesce("_n", F.col("dim_y")).alias("num_slices"), F.coalesce("_index", F.lit(1.0)).alias("refractive_index"),
        window["db_min"].alias("db_min"), window["db_max"].alias("db_max"), dispersion_of_serial(F.col("serial")).alias("dispersion_coefficient"), "data_type", F.lit("Pending").alias("status"),
    )


def matched_first_come(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """One to one: the first row of ``left`` with a key gets the first of ``right``, and so on; rows without a partner stay on the left."""
    number = lambda df, order: df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return number(left, left_order).join(number(right, right_order), [*keys, "_rank"], "left").drop("_rank")
