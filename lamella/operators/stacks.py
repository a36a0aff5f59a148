"""Pictures of a volume along its other axes, and zoomed ones, as bytes: what is shuffled is a tile, not a pixel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

STACK = "volume_id string, slice int, height int, width int, pixels binary"
FIELDS = [f.split()[0] for f in STACK.split(", ")]


def _row(*values: object) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], FIELDS)


def resliced_stack(slices: DataFrame, direction: str, task_bytes: int = 32 << 20) -> DataFrame:
    """The pictures of ``slices`` (volume_id, slice, height, width, pixels row by row) along ``direction``, in the same columns.

    XZ are the slices themselves; YZ has a picture for each of their columns, with their rows as rows and the slices as columns; XY one for each
    of their rows, with the slices as rows. Each slice is cut into tiles of neighbouring columns (rows), so many that
    the tiles of all slices of a volume come to ``task_bytes`` at most (or are one picture's); those are shuffled and put together.
    Slices stand in the order of their numbers. Volumes whose slices differ in size, repeat a number or have too few or many bytes give none.
    """
    rows = slices.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in STACK.split(", ")])
    if direction == "XZ":
        return rows
    fine = F.coalesce((F.length("pixels") == F.col("height").cast("long") * F.col("width")) & (F.col("height") > 0) & (F.col("width") > 0), F.lit(False))
    shapes = rows.groupBy("volume_id").agg(F.count("*").alias("_n"), F.count_distinct("slice").alias("_m"), F.min("height").alias("_h"), F.max("height").alias("_h2"), F.min("width").alias("_w"), F.max("width").alias("_w2"), F.bool_and(fine).alias("_fine"))
    shapes = shapes.where("_n = _m and _h = _h2 and _w = _w2 and _fine").select("volume_id", "_n")
    across = direction == "YZ"

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                h, w, n = r["height"], r["width"], r["_n"]
                picture = np.frombuffer(r["pixels"], dtype=np.uint8).reshape(h, w)
                lines, other = (w, h) if across else (h, w)
                step = max(1, task_bytes // (n * other))
                for at in range(0, lines, step):
                    # lines of the pictures to come, one behind the other
                    part = picture[:, at : at + step].T if across else picture[at : at + step]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((r["volume_id"], pa.string()), (at, pa.int32()), (r["slice"], pa.int32()), (n, pa.int32()), (other, pa.int32()), (part.tobytes(), pa.binary()))], ["volume_id", "first", "slice", "n", "length", "tile"])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        place: tuple | None = None
        for batch in batches:
            for r in batch.to_pylist():
                if (r["volume_id"], r["first"]) != place:
                    place, held = (r["volume_id"], r["first"]), []
                held.append(np.frombuffer(r["tile"], dtype=np.uint8).reshape(-1, r["length"]))
                if len(held) == r["n"]:
                    for i in range(len(held[0])):
                        picture = np.stack([tile[i] for tile in held], axis=1 if across else 0)
                        yield _row(r["volume_id"], r["first"] + i, *picture.shape, picture.tobytes())
                    held = []

    count = int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.join(shapes, "volume_id").mapInArrow(tiles, "volume_id string, first int, slice int, n int, length int, tile binary")
    return cut.repartition(count, "volume_id", "first").sortWithinPartitions("volume_id", "first", "slice").mapInArrow(put_together, STACK)


def zoomed_stack(slices: DataFrame, rows: float = 1.0, cols: float = 1.0) -> DataFrame:
    """Pictures zoomed by a factor each way to the nearest pixel, each where it lies; one of the wrong size gives none.

    A side of n becomes ``round(n * factor)``, halves to the even number, at least 1; place i of it shows place ``round(i * (n - 1) / (new - 1))``, halves up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                h, w = r["height"], r["width"]
                if r["pixels"] is None or not h or not w or len(r["pixels"]) != h * w:
                    continue
                picture = np.frombuffer(r["pixels"], dtype=np.uint8).reshape(h, w)
                for axis, n, factor in ((0, h, rows), (1, w, cols)):
                    new = max(1, int(np.round(n * factor)))
                    picture = picture.take(np.floor(np.arange(new) * ((n - 1) / (new - 1) if new > 1 else 0.0) + 0.5).astype(int), axis=axis)
                yield _row(r["volume_id"], r["slice"], *picture.shape, np.ascontiguousarray(picture).tobytes())

    typed = slices.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in STACK.split(", ")])
    return typed.mapInArrow(run, STACK)
