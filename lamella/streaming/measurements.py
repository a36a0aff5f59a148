"""The log of hand measurements: undo, current cells, saves and progress, as tables and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lamella.functions.cells import PERCENTAGE_STEP
from lamella.operators.queue import queue_items
from lamella.sources.archives import HEADER, discover_headers, with_members

KINDS_THAT_COUNT = ("Categorical", "Ordinal")


def surviving(log: DataFrame, keys: list[str], order: list[str], undo: Column) -> DataFrame:
    """The actions of a log that no later undo takes back; an undo with nothing left to take back does nothing.

    The number of actions in force moves up by one with each action and down with each undo, but not below
    zero. An action stands if the number never falls below its own afterwards. Both are running sums and
    minima over the log of one key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    steps = log.withColumn("_undo", undo).withColumn("_s", F.sum(F.when(F.col("_undo"), -1).otherwise(1)).over(w))
    # how far the sum has been below zero is what the floor has added
    steps = steps.withColumn("_level", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w)))
    later = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return steps.withColumn("_least", F.min("_level").over(later)).where(~F.col("_undo") & (F.col("_least") >= F.col("_level"))).drop("_undo", "_s", "_level", "_least")


def folded(actions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The cell that a series of actions leaves: ``keys, data_type, value, n``.

    ``actions`` has data_type, measured (number, of continuous ones) and entered (text). Lengths add up to two
    decimals each; every second toggle is NO; percentages go up to 100; counts start at 0 or 1; of entered
    values the last stands.
    """
    amount = F.bround("measured", 2).cast("decimal(18,2)")
    found = actions.groupBy(*keys, "data_type").agg(
        F.count("*").alias("n"), F.sum(amount).alias("_sum"), F.max_by("entered", F.struct(*order)).alias("_last"),
    )
    value = (
        F.when(F.col("data_type") == "Continuous", F.coalesce("_sum", F.lit(0)).cast("decimal(18,2)").cast("string"))
        .when(F.col("data_type") == "Boolean", F.when(F.col("n") % 2 == 1, "YES").otherwise("NO"))
        .when(F.col("data_type") == "Percentage", F.concat(F.least(F.col("n") * PERCENTAGE_STEP, F.lit(100)).cast("string"), F.lit("%")))
        .when(F.col("data_type") == "Categorical", (F.col("n") - 1).cast("string"))
        .when(F.col("data_type") == "Ordinal", F.col("n").cast("string"))
        .otherwise(F.col("_last"))
    )
    return found.select(*keys, "data_type", value.alias("value"), "n")


def undone_from(actions: DataFrame, keys: list[str], order: list[str], index: int) -> DataFrame:
    """Of a log's ``surviving`` actions, those that an undo to ``index`` takes back: all but the first ``index`` of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return actions.withColumn("_p", place).where(F.col("_p") > index).drop("_p")


def restored(undone: DataFrame, cell: list[str], order: list[str]) -> DataFrame:
    """What taking actions back leaves: each cell's value before the first of them, and the annotations to drop."""
    first = F.min_by("old_value", F.struct(*order))
    return undone.groupBy(*cell).agg(first.alias("value"), F.count("*").alias("undone"), F.array_sort(F.collect_list("annotation_id")).alias("dropped"))


def undo_history(log: DataFrame) -> DataFrame:
    """What an undo list shows: the slice from 1, old and new value, newest first."""
    return log.select("timestamp", (F.col("slice") + 1).alias("slice"), "column", "old_value", "new_value", "feature", "annotation_id").orderBy(F.desc("timestamp"))


def save_points(log: DataFrame, keys: list[str], time: str = "ts", gap: str = "1500 milliseconds") -> DataFrame:
    """``keys, first, last, n`` of each burst of actions: one save, ``gap`` after its last. Works on tables and streams (with a watermark)."""
    return log.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("first"), F.col("w.end").alias("saved_at"), "n")


def progress(slices: DataFrame, totals: DataFrame) -> DataFrame:
    """``specimen_id, done, total, percent``; slices with an error don't count. Works on a stream with a static ``totals``."""
    done = slices.where("error is null").groupBy("specimen_id").agg(F.count("*").alias("done"))
    rows = done.join(totals, "specimen_id")
    return rows.select("specimen_id", "done", "total", F.when(F.col("total") > 0, F.col("done") / F.col("total") * 100).otherwise(F.lit(0.0)).alias("percent"))


CELL_SCHEMA = "specimen string, slice int, column string, data_type string, value string, n long"


class CellState(StatefulProcessor):
    """Keeps the stack of actions of a cell: actions go on it, an undo takes the last off, the rest is the cell's value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stack = handle.getListState("stack", "data_type string, measured double, entered string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        stack = list(self.stack.get()) if self.stack.exists() else []
        actions = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for a in actions.itertuples():
            if a.undo:
                stack = stack[:-1]
            else:
                stack.append((a.data_type, None if pd.isna(a.measured) else float(a.measured), None if pd.isna(a.entered) else a.entered))
        if stack:
            self.stack.put(stack)
        else:
            self.stack.clear()
        kind, n = (stack[-1][0], len(stack)) if stack else (None, 0)
        value = {
            None: None, "Continuous": f"{sum(round(s[1] or 0, 2) for s in stack):.2f}", "Boolean": "YES" if n % 2 else "NO",
            "Percentage": f"{min(n * PERCENTAGE_STEP, 100)}%", "Categorical": str(n - 1), "Ordinal": str(n),
        }.get(kind, stack[-1][2] if stack else None)
        yield pd.DataFrame([(key[0], int(key[1]), key[2], kind, value, n)], columns=[c.split()[0] for c in CELL_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def streamed_cells(actions: DataFrame) -> DataFrame:
    """The current value of every cell that a micro-batch of actions touches, undo included.

    ``actions``: specimen, slice, column, ts, event_id, data_type, measured, entered, undo. Actions of one cell
    are taken in order of time inside a batch. Needs the RocksDB state store.
    """
    return actions.groupBy("specimen", "slice", "column").transformWithStateInPandas(CellState(), CELL_SCHEMA, "Update", "None")


def streamed_saves(actions: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Save points of a stream, each once its burst is over and the watermark has passed it."""
    return save_points(actions.withWatermark("ts", delay), ["specimen"])


def arriving_items(spark: SparkSession, root: str, sidecars: DataFrame, pattern: str = "*.oct") -> DataFrame:
    """A stream of queue items: one for each archive that appears and each view of its sidecar (``sidecars`` as for ``queue_items``).

    Headers are read by path, each archive once; one that can't be read gives no item.
    """
    headers = with_members(arriving_archives(spark, root, pattern), [HEADER])
    return queue_items(discover_headers(headers.where("bytes is not null")).withColumnRenamed("path", "file_path"), sidecars)


def arriving_archives(spark: SparkSession, root: str, pattern: str = "*.oct") -> DataFrame:
    """A stream of the archives that appear in a folder, each once, without their bytes."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))
