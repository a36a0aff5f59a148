"""Measurements as a stream in event time, against the tables of the whole log."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.streaming.event_time import cell_value, current_cells, part, streamed_measurements, write_measurements, written_part
from lamella.streaming.measurements import folded, save_points, surviving

ACTIONS = "specimen string, slice int, column string, ts timestamp, event_id long, data_type string, measured double, entered string, undo boolean"
START = datetime(2024, 5, 1, tzinfo=timezone.utc)
KINDS = {"len": "Continuous", "ok": "Boolean", "area": "Percentage", "kind": "Categorical", "grade": "Ordinal", "note": "Text"}


def log(draw, n):
    rows, ms = [], 0
    for i in range(n):
        ms += int(draw.choice([0, 7, 400, 1499, 1500, 3000]))
        column = str(draw.choice(list(KINDS)))
        rows.append((str(draw.choice(["a", "b", "c"])), int(draw.integers(0, 2)), column, START + timedelta(milliseconds=ms), i, KINDS[column], float(draw.choice([1.005, 2.675, 0.125, 7.0])) if column == "len" else None, f"t{i}" if column == "note" else None, bool(draw.random() < 0.35)))
    return rows


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def stream(spark, tmp_path, batches, delay):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, ACTIONS).coalesce(1).write.mode("append").parquet(source)
        output = streamed_measurements(spark.readStream.schema(ACTIONS).parquet(source), delay)
        write_measurements(output, root, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
    return root


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_gives_the_table(rocks, tmp_path, seed):
    draw = np.random.default_rng(seed)
    rows = log(draw, 60)
    shuffled = [rows[i] for i in draw.permutation(len(rows))]
    end = [("z", 0, "ok", START + timedelta(days=1), 1000, "Boolean", None, None, False)]
    root = stream(rocks, tmp_path, [shuffled[:25], shuffled[25:], end], "1 hour")
    table = rocks.createDataFrame(rows, ACTIONS)
    kept = surviving(table, ["specimen"], ["ts", "event_id"], F.col("undo"))
    want = folded(kept, ["specimen", "slice", "column"], ["ts", "event_id"])
    assert rows_of(current_cells(rocks, root)) == rows_of(want)
    saves = written_part(rocks, root, "saves").drop("batch")
    assert rows_of(saves) == rows_of(save_points(table, ["specimen"]).select("specimen", "first", "saved_at", "n"))
    assert written_part(rocks, root, "late").count() == 0
    written = written_part(rocks, root, "log")
    # each logged value is what the row before left in that cell
    by_cell = {}
    for r in sorted(written.collect(), key=lambda r: (r.specimen, r.at, r.event_id)):
        assert by_cell.get((r.specimen, r.slice, r.column)) == r.old_value
        by_cell[r.specimen, r.slice, r.column] = r.value
    assert {(k, v) for k, v in by_cell.items() if v is not None} == {((r.specimen, r.slice, r.column), r.value) for r in want.collect()}
    assert written.where("not undo").count() == table.where("not undo").count()


def test_rows_behind_the_watermark_go_aside(rocks, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    one = lambda s, i, undo=False, specimen="a": (specimen, 0, "len", at(s), i, "Continuous", 1.0, None, undo)
    batches = [[one(0, 1), one(100, 2)], [one(95, 3), one(50, 4), one(0, 5, True), ("a", 0, "len", None, 6, "Continuous", 1.0, None, False)], [one(500, 7)]]
    root = stream(rocks, tmp_path, batches, "10 seconds")
    assert sorted(r.event_id for r in written_part(rocks, root, "late").collect()) == [4, 5, 6]
    cells = current_cells(rocks, root).collect()
    assert [(r.value, r.n) for r in cells] == [("3.00", 3)]
    logged = written_part(rocks, root, "log").orderBy("at").collect()
    assert [(r.event_id, r.old_value, r.value) for r in logged] == [(1, None, "1.00"), (3, "1.00", "2.00"), (2, "2.00", "3.00")]


def test_a_batch_delivered_again_replaces_itself(rocks, tmp_path):
    rows = rocks.createDataFrame([("cells", "a", 0, "x", "Text", "1", 1, 5)], "output string, specimen string, slice int, column string, data_type string, value string, n long, batch int")
    for value in ("1", "2"):
        changed = rows.withColumn("value", F.lit(value)).select("specimen", "slice", "column", "data_type", "value", "n", "batch")
        changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(str(tmp_path / "cells"))
    assert [r.value for r in current_cells(rocks, str(tmp_path)).collect()] == ["2"]
    empty = rocks.createDataFrame([], "output string, specimen string, first long, saved_at long, n long, new_value string")
    assert part(empty, "saves").count() == 0


def test_values_of_cells():
    action = lambda kind, measured=None, entered=None: (0, "c", 0, 0, kind, measured, entered, False)
    assert cell_value([]) == (None, None, 0)
    assert cell_value([action("Continuous", 2.675), action("Continuous"), action("Continuous", 0.125)]) == ("Continuous", "2.80", 3)
    assert cell_value([action("Percentage")] * 30) == ("Percentage", "100%", 30)
    assert cell_value([action("Text", None, "x"), action("Text", None, None)]) == ("Text", None, 2)
