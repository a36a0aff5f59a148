"""The log of hand measurements as a stream in event time: what arrives in any order is applied in the order in which it was done."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from lamella.functions.cells import PERCENTAGE_STEP

ACTION = "slice int, column string, at long, event_id long, data_type string, measured double, entered string, undo boolean"
FIELDS = [f.split()[0] for f in ACTION.split(", ")]
OUTPUT = f"output string, specimen string, {ACTION}, old_value string, new_value string, n long, first long, saved_at long"
#: Whole numbers; pandas would make them inexact beside a null, so the large ones come as text.
WHOLE = {"slice", "at", "event_id"}
#: What the parts of the output hold.
PARTS = {
    "cells": ["specimen", "slice", "column", "data_type", "value", "n"],
    "log": ["specimen", "at", "event_id", "undo", "slice", "column", "data_type", "old_value", "value"],
    "saves": ["specimen", "first", "saved_at", "n"],
    "late": ["specimen", *FIELDS],
}


def cell_value(actions: list[tuple]) -> tuple[str | None, str | None, int]:
    """``data_type, value, n`` that the actions in force leave in a cell; the rules are those of ``measurements.folded``."""
    if not actions:
        return None, None, 0
    kind, n, last = actions[-1][4], len(actions), actions[-1][6]
    if kind == "Continuous":
        cents = sum((Decimal(repr(a[5])).quantize(Decimal("0.01"), ROUND_HALF_EVEN) for a in actions if a[5] is not None), Decimal("0.00"))
        return kind, str(cents), n
    return kind, {"Boolean": "YES" if n % 2 else "NO", "Percentage": f"{min(n * PERCENTAGE_STEP, 100)}%", "Categorical": str(n - 1), "Ordinal": str(n)}.get(kind, last), n


def _plain(value: object) -> object:
    return None if pd.isna(value) else value.item() if hasattr(value, "item") else value


class Session(StatefulProcessor):
    """Of a specimen: actions that wait for their time, those in force, and the burst of actions that isn't saved yet."""

    def __init__(self, gap_ms: int) -> None:
        self.gap = gap_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ACTION)
        self.stack = handle.getListState("stack", ACTION)
        self.burst = handle.getValueState("burst", "first long, last long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed, late, new = timerValues.getCurrentWatermarkInMs(), [], []
        for some in rows:
            for row in some[FIELDS].itertuples(index=False):
                action = tuple(int(v) if n in WHOLE and v is not None else v for n, v in zip(FIELDS, map(_plain, row), strict=True))
                if action[2] is None or action[2] // 1000 < passed:
                    late.append(("late", key[0], *action, None, None, None, None, None))
                else:
                    new.append(action)
        if new:
            self.waiting.appendList(new)
            for moment in {a[2] // 1000 + 1 for a in new}:
                self.handle.registerTimer(moment)
        yield self._frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((tuple(a) for a in waiting if a[2] // 1000 < passed), key=lambda a: (a[2], a[3] is not None, a[3] or 0))
        out = list(self._applied(key[0], due)) if due else []
        if due:
            self._keep(self.waiting, [tuple(a) for a in waiting if a[2] // 1000 >= passed])
        if self.burst.exists():
            first, last, n = self.burst.get()
            if (last + self.gap) // 1000 < passed:
                out.append(self._saved(key[0], first, last, n))
                self.burst.clear()
        yield self._frame(out)

    def _applied(self, specimen: str, due: list[tuple]) -> Iterator[tuple]:
        """Rows for actions taken in their order: the log of what they changed, bursts that they end, the cells that they leave."""
        stack = [tuple(a) for a in self.stack.get()] if self.stack.exists() else []
        burst = self.burst.get() if self.burst.exists() else None
        cells: dict[tuple, list[tuple]] = {}
        for a in stack:
            cells.setdefault(a[:2], []).append(a)
        touched: dict[tuple, None] = {}
        for action in due:
            if burst and action[2] > burst[1] + self.gap:
                yield self._saved(specimen, *burst)
                burst = None
            burst = (burst[0] if burst else action[2], action[2], burst[2] + 1 if burst else 1)
            if action[7] and not stack:
                continue
            place = stack[-1][:2] if action[7] else action[:2]
            cell = cells.setdefault(place, [])
            kind, old, _ = cell_value(cell)
            if action[7]:
                stack.pop()
                cell.pop()
            else:
                stack.append(action)
                cell.append(action)
                kind = action[4]
            touched[place] = None
            yield ("log", specimen, *place, *action[2:4], kind, None, None, action[7], old, cell_value(cell)[1], None, None, None)
        self._keep(self.stack, stack)
        self.burst.update(burst)
        self.handle.registerTimer((burst[1] + self.gap) // 1000 + 1)
        for place in touched:
            kind, value, n = cell_value(cells[place])
            yield ("cells", specimen, *place, None, None, kind, None, None, None, None, value, n, None, None)

    def _saved(self, specimen: str, first: int, last: int, n: int) -> tuple:
        return ("saves", specimen, *[None] * 10, n, first, last + self.gap)

    @staticmethod
    def _keep(state, rows: list[tuple]) -> None:  # noqa: ANN001
        if rows:
            state.put(rows)
        else:
            state.clear()

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        names = [f.split()[0] for f in OUTPUT.split(", ")]
        return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})

    def close(self) -> None:
        pass


def streamed_measurements(actions: DataFrame, delay: str = "10 seconds", gap_ms: int = 1500) -> DataFrame:
    """What a stream of actions does, in event time, in one stream of four parts (``output``; see ``part``).

    ``actions``: specimen, slice, column, ts, event_id, data_type, measured, entered, undo. An undo takes back the specimen's last action in
    force, whatever its cell. An action waits in state until the watermark, ``delay`` behind the newest ``ts``, has passed its time; then those of a
    specimen are applied by time and event id, so every order of arrival within ``delay`` gives what ``folded`` of the ``surviving``
    actions of the whole log gives. ``cells`` has the cells touched, ``log`` each action and undo with the value before and after,
    ``saves`` each burst of actions that ``gap_ms`` without another has ended. What comes after its time has passed, or has no time,
    is not applied: it goes to ``late``. An undo with nothing to take back counts towards a burst and changes nothing. Needs the RocksDB state store.
    """
    # times go in as numbers: rows behind the watermark would else be dropped before they could be told of
    timed = actions.withWatermark("ts", delay).select("specimen", "slice", "column", F.unix_micros("ts").cast("string").alias("at"), F.col("event_id").cast("string").alias("event_id"), "data_type", "measured", "entered", F.coalesce("undo", F.lit(False)).alias("undo"))
    return timed.groupBy("specimen").transformWithStateInPandas(Session(gap_ms), OUTPUT, "Append", "EventTime")


def part(output: DataFrame, name: str) -> DataFrame:
    """A part of ``streamed_measurements``, by name, with times as timestamps."""
    rows = output.where(F.col("output") == name).withColumnRenamed("new_value", "value")
    times = [c for c in ("at", "first", "saved_at") if c in PARTS[name]]
    return rows.select(*PARTS[name]).withColumns({c: F.timestamp_micros(c) for c in times})


def write_measurements(output: DataFrame, root: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Start writing all parts under ``root``, a table each with a folder for every batch; a batch delivered again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name in PARTS:
            rows = part(batch, name).withColumn("batch", F.lit(number))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{root}/{name}")
        batch.unpersist()

    return output.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def written_part(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A part that ``write_measurements`` wrote, with its ``batch``; one without rows too."""
    empty = part(spark.createDataFrame([], OUTPUT), name).withColumn("batch", F.lit(0))
    return spark.read.schema(empty.schema).parquet(f"{root}/{name}")


def current_cells(spark: SparkSession, root: str) -> DataFrame:
    """The cells as the last batches left them; a cell whose actions were all undone has no row."""
    written = written_part(spark, root, "cells").groupBy("specimen", "slice", "column").agg(F.max_by(F.struct("data_type", "value", "n"), "batch").alias("c"))
    return written.select("specimen", "slice", "column", "c.*").where("n > 0")
