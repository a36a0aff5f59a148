"""Surfaces: clusters of detected points, smooth curves through them, cavities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, StructType

from lamella.operators.ascan import without_outliers
from lamella.operators.curves import fitted_curve
from lamella.operators.lineage import cut


#: Side of a tile, in eps. A task's memory grows with the points of a tile.
TILE = 32
#: Rows of tiles that are dealt with at once, or those of one tile if these are more, and pairs of points that are measured at a time.
ROWS, PAIRS = 1 << 15, 1 << 18


def _near(x: np.ndarray, y: np.ndarray, code: np.ndarray, wide: int, of: np.ndarray, among: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (of, among) at most ``eps`` apart, ``PAIRS`` looked at or so at a time. ``among`` is in order of cells (``code``, columns ``wide`` apart)."""
    codes = code[among]
    for column in range(-2, 3):
        middle = code[of] + column * wide
        low, high = np.searchsorted(codes, middle - 2), np.searchsorted(codes, middle + 2, side="right")
        total = np.cumsum(high - low)
        begin = 0
        while begin < len(of):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, side="right")))
            n = (high - low)[begin:end]
            for at in range(0, int(n[0]) if len(n) == 1 else 1, PAIRS):  # one point with very many is dealt with in parts
                k = np.minimum(n - at, PAIRS) if len(n) == 1 else n
                a = np.repeat(of[begin:end], k)
                b = among[np.arange(k.sum()) + np.repeat(low[begin:end] + at - np.cumsum(k) + k, k)]
                close = (x[a] - x[b]) * (x[a] - x[b]) + (y[a] - y[b]) * (y[a] - y[b]) <= eps * eps
                yield a[close], b[close]
            begin = end


def _outermost(cell: np.ndarray, line: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Of each line (a row or column) of a cell the first and the last."""
    order = np.lexsort((by, line, cell))
    new = np.concatenate(([True], (cell[order][1:] != cell[order][:-1]) | (line[order][1:] != line[order][:-1])))
    return order[new | np.concatenate((new[1:], [True]))]


def tile_clusters(tile: np.ndarray, x: np.ndarray, y: np.ndarray, inner: np.ndarray, own: np.ndarray, eps: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Core points among ``inner``, each point's cluster inside its tile (the least core in it, -1 for none), and pairs (point, cluster) of ``own`` points near cores.

    Rows are in order of ``tile``. ``own`` points are some of ``inner``; of these, all points within ``eps`` are there. Points of one cell, of side under
    eps / sqrt 2, are all neighbours, so those of a cell with ``least`` points are cores uncounted, and cells are linked,
    not points: by the outermost cores of each row and column of a cell.
    """
    side = eps / 1.4143
    first = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
    place = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(tile)]))))
    cx, cy = (np.clip(c - np.minimum.reduceat(c, first)[place], 0, (1 << 20) - 1).astype(np.int64) for c in (np.floor(x / side), np.floor(y / side)))
    wide = int(cy.max()) + 5
    code = (place * (int(cx.max()) + 5) + cx + 2) * wide + cy + 2
    ranked = np.argsort(code, kind="stable")
    _, cell, size = np.unique(code, return_inverse=True, return_counts=True)
    core = inner & (size[cell] >= least)
    count = np.zeros(len(x), dtype=np.int64)
    for a, _ in _near(x, y, code, wide, np.flatnonzero(inner & ~core), ranked, eps):
        count += np.bincount(a, minlength=len(x))
    core |= inner & (count >= least)
    label, cores = np.full(len(size), len(x)), np.flatnonzero(core)
    np.minimum.at(label, cell[cores], cores)
    if len(cores):
        edge = np.unique(np.concatenate((cores[_outermost(cell[cores], y[cores], x[cores])], cores[_outermost(cell[cores], x[cores], y[cores])])))
        links = [np.unique(cell[a] * len(size) + cell[b]) for a, b in _near(x, y, code, wide, edge, edge[np.argsort(code[edge], kind="stable")], eps)]
        links = np.unique(np.concatenate(links))
        p, q = links // len(size), links % len(size)
        while True:
            before = label.copy()
            np.minimum.at(label, p, label[q])
            named = label < len(x)
            label[named] = np.minimum(label[named], label[cell[label[named]]])
            if np.array_equal(before, label):
                break
    name = np.where(core, label[cell], -1)
    near = [np.unique(a * len(x) + name[b]) for a, b in _near(x, y, code, wide, np.flatnonzero(own & ~core), ranked[core[ranked]], eps)]
    near = np.unique(np.concatenate(near)) if near else np.zeros(0, dtype=np.int64)
    return core, name, np.stack((near // len(x), near % len(x)))


def density_clusters(points: DataFrame, keys: list[str], eps: float = 17.0, least: int = 10) -> DataFrame:
    """``points`` (keys, pid, x, y) with ``cluster``, the least pid of the core points chained to it; null for noise.

    A core point has ``least`` points, itself included, within ``eps``. A point near cores of several clusters
    joins the one with the least name. Points without a finite place are noise.

    Tiles of ``TILE`` eps a side are dealt to tasks, each with the points around it up to 2 eps away, so that it knows
    which points up to eps away are cores. A tile names its clusters by ``tile_clusters``; a core that several
    tiles see links the names that it has in them. Names spread along these links and along the chain of names
    found so far, so the rounds grow with the logarithm of a cluster's length in tiles; with no such link there is none.
    """
    reach, side = eps * (1 + 1e-6), TILE * eps
    placed = points.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))).dropna(subset=keys)
    placed = placed.select(*keys, "pid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    touched = {f"_t{c}": F.explode(F.array_distinct(F.array(F.floor((F.col(c) - 2 * reach) / side), F.floor((F.col(c) + 2 * reach) / side)))) for c in ("x", "y")}
    tiled = placed.withColumn("_tx", touched["_tx"]).withColumn("_ty", touched["_ty"])
    tiled = tiled.withColumn("_own", (F.floor(F.col("x") / side) == F.col("_tx")) & (F.floor(F.col("y") / side) == F.col("_ty")))
    far = F.greatest(*[F.greatest(F.col(f"_t{c}") * side - F.col(c), F.col(c) - (F.col(f"_t{c}") + 1) * side) for c in ("x", "y")])
    tiled = tiled.withColumn("_far", far)
    kinds = {f.name: f.dataType for f in placed.schema.fields}
    schema = StructType([placed.schema[k] for k in keys]).add("pid", kinds["pid"]).add("_name", kinds["pid"]).add("_core", BooleanType()).add("_own", BooleanType()).add("_edge", BooleanType())

    by = [*keys, "_tx", "_ty"]

    def named(rows: pa.Table) -> pa.RecordBatch:
        """Of whole tiles. Their points are in order of pid, so the first has the least."""
        tile = np.cumsum(np.logical_or.reduce([changed(rows.column(k)) for k in by]))
        x, y, own, far = (rows.column(c).to_numpy() for c in ("x", "y", "_own", "_far"))
        core, name, near = tile_clusters(tile, x, y, own | (far <= reach), own, eps, least)
        at, names = np.concatenate((np.flatnonzero(core), near[0])), np.concatenate((name[core], near[1]))
        taken = [rows.column(k).combine_chunks().take(pa.array(i)) for k, i in [*((k, at) for k in (*keys, "pid")), ("pid", names)]]
        return pa.RecordBatch.from_arrays([*taken, pa.array(core[at]), pa.array(own[at]), pa.array(far[at] >= -2 * reach)], schema.names)

    def changed(column: pa.ChunkedArray) -> np.ndarray:
        code = column.combine_chunks().dictionary_encode().indices.to_numpy()
        return np.concatenate(([True], code[1:] != code[:-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        enough = ROWS
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= enough:
                rows = pa.Table.from_batches(held)
                begun = int(np.flatnonzero(np.logical_or.reduce([changed(rows.column(k)) for k in by]))[-1])
                if begun:
                    yield named(rows.slice(0, begun))
                held = rows.slice(begun).to_batches()
                enough = max(ROWS, 2 * (len(rows) - begun))
        if sum(map(len, held)):
            yield named(pa.Table.from_batches(held))

    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(tiled.repartition(parts, *by).sortWithinPartitions(*by, "pid").mapInArrow(run, schema))
    seen = found.where("_core and _edge").groupBy(*keys, "pid").agg(F.collect_set("_name").alias("_names")).where(F.size("_names") > 1)
    pairs = seen.select(*keys, F.array_min("_names").alias("a"), F.explode("_names").alias("b")).where("a <> b").distinct()
    pairs = cut(pairs)
    clusters = found.where("_own").select(*keys, "pid", F.col("_name").alias("cluster"))
    if pairs.limit(1).count():
        both = pairs.unionByName(pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        nodes = both.select(*keys, "a").distinct()
        links = cut(both.unionByName(nodes.withColumn("b", F.col("a"))).distinct())
        names = cut(nodes.select(*keys, F.col("a").alias("pid"), F.col("a").alias("name")))
        while True:
            spread = links.join(names.withColumnRenamed("pid", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("pid")).agg(F.min("name").alias("name"))
            jump = spread.join(names.select(*keys, F.col("pid").alias("name"), F.col("name").alias("up")), [*keys, "name"]).select(*keys, "pid", F.least("name", "up").alias("new"))
            after = cut(names.join(jump, [*keys, "pid"]).select(*keys, "pid", F.least("name", "new").alias("name"), (F.col("new") < F.col("name")).alias("moved")))
            moved = after.where("moved").limit(1).count()
            names = after.drop("moved")
            if not moved:
                break
        clusters = clusters.withColumnRenamed("cluster", "_name").join(names.select(*keys, F.col("pid").alias("_name"), "name"), [*keys, "_name"], "left")
        clusters = clusters.select(*keys, "pid", F.coalesce("name", "_name").alias("cluster"))
    clusters = clusters.groupBy(*keys, "pid").agg(F.min("cluster").alias("cluster"))
    return points.join(clusters, [*keys, "pid"], "left")


def large_clusters(clustered: DataFrame, keys: list[str], above: int = 180) -> DataFrame:
    """Points of clusters with more than ``above``; if a slice has none, of its largest (of equals the first); all if there is only noise."""
    size = F.count("cluster").over(Window.partitionBy(*keys, "cluster"))
    sized = clustered.withColumn("_n", F.when(F.col("cluster").isNotNull(), size))
    top = F.max(F.struct(F.col("_n"), (-F.col("cluster")).alias("c"))).over(Window.partitionBy(*keys))
    sized = sized.withColumn("_top", top)
    kept = F.when(F.col("_top._n").isNull(), F.lit(True)).when(F.col("_top._n") > above, F.col("_n") > above).otherwise(F.col("cluster") == -F.col("_top.c"))
    return sized.where(kept).drop("_n", "_top")


def reference_curve(points: DataFrame, configs: DataFrame, keys: list[str]) -> DataFrame:
    """The curve the surface would have without the lesion: of the points outside it, a buffer apart."""
    bounds = configs.select(*keys, (F.col("lesion_start_x") - F.col("buffer")).alias("_l"), (F.col("lesion_end_x") + F.col("buffer")).alias("_r"))
    outside = points.join(bounds, keys).where("x < _l or x > _r").drop("_l", "_r")
    return fitted_curve(outside, configs.select(*keys, F.col("start_x").alias("start"), F.col("end_x").alias("end")), keys, "interpolated_surface", degree=3, smoothing=2.0, multiplier=5.0)


def depth_curve(depths: DataFrame, spans: DataFrame, keys: list[str], kernel: int = 7) -> DataFrame:
    """A curve through detected depths (x, y): medians of ``kernel``, outliers of them left out."""
    kept = without_outliers(depths, keys, ["x"], "y", kernel).where("kept").select(*keys, "x", F.col("filtered").alias("y"))
    return fitted_curve(kept, spans, keys, "lesion_depth", degree=3, smoothing=5.0, multiplier=5.0)


def cavitation(actual: DataFrame, reference: DataFrame, configs: DataFrame, keys: list[str], threshold: float = 5.0, share: float = 0.7) -> DataFrame:
    """``cavitated, depth`` of each slice where both curves are known inside the lesion, a buffer from its bounds (inclusive).

    A cavity is where the actual surface lies lower in at least ``share`` of the columns and there by more than
    ``threshold`` on average.
    """
    bounds = configs.select(*keys, (F.col("lesion_start_x") + F.col("buffer")).alias("_l"), (F.col("lesion_end_x") - F.col("buffer")).alias("_r"))
    both = actual.select(*keys, "x", F.col("y").alias("_a")).join(reference.select(*keys, "x", F.col("y").alias("_b")), [*keys, "x"]).join(bounds, keys).where("x between _l and _r")
    lower = F.col("_a") - F.col("_b")
    found = both.groupBy(*keys).agg(F.avg(F.when(lower > 0, lower)).alias("depth"), (F.count_if(lower > 0) / F.count("*")).alias("_share"))
    return found.select(*keys, F.coalesce((F.col("depth") > threshold) & (F.col("_share") >= share), F.lit(False)).alias("cavitated"), F.coalesce("depth", F.lit(0.0)).alias("depth"))
