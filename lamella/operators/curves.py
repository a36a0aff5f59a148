"""Smoothing splines that keep to a residual budget, from sums of powers over cells: a key's points never meet in one task."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Cells into which a key's range is cut at most; knots lie between cells.
CELLS = 1 << 14
#: Binomial coefficients.
CHOOSE = np.array([[comb(n, k) for k in range(32)] for n in range(32)], dtype=np.float64)
#: Unknowns up to which a system is solved as a full matrix.
FULL = 300


@dataclass
class Fit:
    """A piecewise polynomial: ``pieces[j]`` are coefficients in (x - knots[j]) / (knots[j + 1] - knots[j])."""

    knots: np.ndarray
    pieces: np.ndarray
    residual: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.clip(np.searchsorted(self.knots, x, "right") - 1, 0, len(self.pieces) - 1)
        u = (x - self.knots[at]) / np.diff(self.knots)[at]
        return (self.pieces[at] * u[:, None] ** np.arange(self.pieces.shape[1])).sum(axis=1)


@lru_cache(maxsize=64)
def _even_pieces(segments: int, degree: int) -> np.ndarray:
    return _pieces(np.arange(segments + 1.0), degree)


def basis_pieces(knots: np.ndarray, degree: int) -> np.ndarray:
    """For each interval the polynomials of the ``degree + 1`` B-splines on it; those of equal intervals are kept, as they depend on their number only."""
    width = np.diff(knots)
    return _even_pieces(len(width), degree) if np.ptp(width) == 0 and len(width) <= 64 else _pieces(knots, degree)


def _pieces(knots: np.ndarray, degree: int) -> np.ndarray:
    """For each interval the polynomials of the ``degree + 1`` B-splines on it, by the recursion of Cox and de Boor."""
    full = np.concatenate(([knots[0]] * degree, knots, [knots[-1]] * degree))
    own = np.arange(len(knots) - 1)
    width = np.diff(knots)
    out = np.ones((len(own), 1, 1))
    for p in range(1, degree + 1):
        grown = np.zeros((len(own), p + 1, p + 1))
        i = own[:, None] + degree - p + 1 + np.arange(p)
        span = full[i + p] - full[i]
        a, b = ((knots[:-1, None] - full[i]) / span)[:, :, None], (width[:, None] / span)[:, :, None] * out
        grown[:, 1:, :p] += a * out
        grown[:, 1:, 1:] += b
        grown[:, :p, :p] += (1 - a) * out
        grown[:, :p, 1:] -= b
        out = grown
    return out


@lru_cache(maxsize=FULL)
def _places(n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each entry of a band of n rows and k columns lies in a full matrix laid flat, above and below, and which entries do."""
    row, column = np.divmod(np.arange(n * k), k)
    inside = np.flatnonzero(row + column < n)
    row, column = row[inside], column[inside]
    return row * n + row + column, (row + column) * n + row, inside


def banded_solve(band: np.ndarray, load: np.ndarray) -> np.ndarray:
    """Solves a symmetric positive system whose row i has ``band[i, k]`` in column i + k, by a banded Cholesky decomposition."""
    n, k = band.shape
    if n <= FULL:
        above, below, inside = _places(n, k)
        full = np.zeros(n * n)
        full[above] = full[below] = band.ravel()[inside]
        return np.linalg.solve(full.reshape(n, n), load)
    a = np.vstack((band, np.zeros((k, k))))
    flat = a.ravel()
    below = [(r, c) for r in range(1, k) for c in range(k - r)]
    place = np.array([r * k + c for r, c in below])
    one, two = np.array([r for r, _ in below]), np.array([r + c for r, c in below])
    right = np.concatenate((load, np.zeros(k)))
    for i in range(n):
        row = a[i] / a[i, 0]
        flat[i * k + place] -= row[one] * a[i, two]
        right[i + 1 : i + k] -= row[1:] * right[i]
    out = np.zeros(n + k)
    for i in range(n - 1, -1, -1):
        out[i] = (right[i] - a[i, 1:] @ out[i + 1 : i + k]) / a[i, 0]
    return out[:n]


class Cells:
    """Sums of powers over equal cells of [low, high]: of v to ``2 * degree``, of y times v to ``degree``, of y * y, v being the place in the cell."""

    def __init__(self, low: float, width: float, cell: np.ndarray, powers: np.ndarray, loads: np.ndarray, squares: np.ndarray, count: int) -> None:
        self.low, self.width, self.cell, self.powers, self.loads, self.squares, self.count = low, width, cell, powers, loads, squares, count
        self.degree = min(loads.shape[1] - 1, max(0, len(cell) - 1))

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, low: float, high: float, degree: int, cells: int = CELLS) -> Cells:
        """The same as ``cell_sums`` for points in memory."""
        count = max(1, min(len(x), cells))
        width = (high - low) / count
        at = np.minimum(((x - low) / width).astype(int), count - 1)
        v = (x - low) / width - at
        cell, place = np.unique(at, return_inverse=True)
        summed = lambda w: np.bincount(place, weights=w, minlength=len(cell))
        return cls(low, width, cell, np.stack([summed(v**k) for k in range(2 * degree + 1)], 1), np.stack([summed(y * v**k) for k in range(degree + 1)], 1), summed(y * y), count)

    def sums(self, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sums over the intervals between ``cuts``, in the place in the interval."""
        own = np.searchsorted(cuts, self.cell, "right") - 1
        size = np.diff(cuts)[own]
        offset, scale = (self.cell - cuts[own]) / size, 1 / size

        # (offset + scale * v) ** k, term by term
        k, i = np.tril_indices(2 * self.degree + 1)
        exponents = np.arange(2 * self.degree + 1)
        up, down = offset[:, None] ** exponents, scale[:, None] ** exponents
        shift = np.zeros((len(self.cell), len(exponents), len(exponents)))
        shift[:, k, i] = CHOOSE[k, i] * up[:, k - i] * down[:, i]
        d = self.degree + 1
        powers, loads = (shift @ self.powers[:, : 2 * d - 1, None])[:, :, 0], (shift[:, :d, :d] @ self.loads[:, :d, None])[:, :, 0]
        first = np.searchsorted(own, np.arange(len(cuts) - 1))
        return tuple(np.add.reduceat(v, first, axis=0) for v in (powers, loads, self.squares))

    def system(self, cuts: np.ndarray) -> tuple:
        """What ``fit`` needs of the knots at ``cuts`` whatever the strength."""
        d, m = self.degree, len(cuts) - 1
        powers, loads, squares = self.sums(cuts)
        basis = basis_pieces(cuts.astype(float), d)
        gram = powers[:, np.add.outer(np.arange(d + 1), np.arange(d + 1))]
        local = basis @ gram @ basis.transpose(0, 2, 1)
        right = (basis @ loads[:, :, None])[:, :, 0]
        band, load = np.zeros((m + d, d + 2)), np.zeros(m + d)
        for r in range(d + 1):
            load[r : r + m] += right[:, r]
            band[r : r + m, : d + 1 - r] += local[:, r, r:]
        bend = np.zeros_like(band)
        if m > 1:
            slope = basis[:, :, d] * ((cuts[-1] / m) / np.diff(cuts)[:, None]) ** d
            jump = np.zeros((m - 1, d + 2))
            jump[:, :-1] -= slope[:-1]
            jump[:, 1:] += slope[1:]
            for r in range(d + 2):
                bend[r : r + m - 1, : d + 2 - r] += jump[:, r : r + 1] * jump[:, r:]
            bend *= band[:, 0].sum() / max(float(bend[:, 0].sum()), 1e-300)
        return basis, gram, loads, squares, band, bend, load, powers[:, 0]

    def fit(self, system: tuple, strength: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of the spline with knots at the ``system``'s cuts, each interval's residual, and its number of points.

        What is small is the residuals' sum and ``strength`` times the squared jumps of the highest derivative, so that at
        any strength polynomials of the degree stay as they are.
        """
        basis, gram, loads, squares, band, bend, load, points = system
        d, m = self.degree, len(basis)
        band = band + strength * bend
        band[:, 0] += 1e-13 * max(float(band[:, 0].max()), 1e-300)
        solved = banded_solve(band, load)
        pieces = solved[:m, None] * basis[:, 0]
        for r in range(1, d + 1):
            pieces += solved[r : r + m, None] * basis[:, r]
        residual = squares - 2 * (pieces * loads).sum(axis=1) + np.einsum("ja,jab,jb->j", pieces, gram, pieces)
        return pieces, np.maximum(residual, 0.0), points

    def split(self, cuts: np.ndarray, residual: np.ndarray, points: np.ndarray, budget: float) -> np.ndarray:
        """More cuts, each in the middle of the filled cells of an interval with more than its share of the residuals."""
        first, last = np.searchsorted(self.cell, cuts[:-1]), np.searchsorted(self.cell, cuts[1:])
        can = np.flatnonzero(last - first >= 2)
        over = can[residual[can] > budget * points[can] / points.sum()]
        chosen = over if len(over) else can[np.argsort(-residual[can])[:1]]
        return np.union1d(cuts, self.cell[(first[chosen] + last[chosen]) // 2])

    def smooth(self, budget: float) -> Fit:
        """The smoothest spline found whose residuals sum to ``budget`` or less; the closest, if no cell border helps any more.

        Knots are added where residuals are large until the sum is within the budget; then the jumps are held down as far as it allows.
        """
        cuts = np.array([0, self.count])
        weak = 1e-12
        while True:
            system = self.system(cuts)
            pieces, residual, points = self.fit(system, weak)
            if residual.sum() <= budget or len(more := self.split(cuts, residual, points, budget)) == len(cuts):
                break
            cuts = more
        total = float(residual.sum())
        if total <= budget and len(cuts) > 2:
            low, high = -12.0, 6.0
            for _ in range(24):
                middle = (low + high) / 2
                tried, rest, _ = self.fit(system, 10**middle)
                if rest.sum() <= budget:
                    low, pieces, total = middle, tried, float(rest.sum())
                    if total > 0.995 * budget:
                        break
                else:
                    high = middle
        return Fit(self.low + self.width * cuts, pieces, total)


def smooth_curve(x: np.ndarray, y: np.ndarray, at: np.ndarray, degree: int, budget: float) -> np.ndarray:
    """A smoothing spline through points in memory, at ``at``."""
    x, y, at = (np.asarray(v, dtype=np.float64) for v in (x, y, at))
    low, high = min(x.min(), at.min()), max(x.max(), at.max(), x.min() + 1)
    middle = y.mean()
    return Cells.of(x, y - middle, low, high, degree).smooth(budget)(at) + middle


def cell_sums(points: DataFrame, spans: DataFrame, keys: list[str], degree: int, cells: int = CELLS, least: int = 4) -> DataFrame:
    """``keys, start, end, n, low, width, count, middle`` of each key with ``least`` points and a span, and ``cells``: its sums by cell.

    Points with a null are left out. Sums are built where the points lie and only sums are shuffled, at most ``cells`` rows a key.
    """
    clean = points.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    reach = clean.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("_a"), F.max("x").alias("_b"), F.avg("y").alias("middle")).where(F.col("n") >= least)
    span = spans.select(*keys, F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")).where("start < end")
    frame = reach.join(span, keys)
    low, high = F.least("_a", "start"), F.greatest("_b", F.col("end") - 1, F.col("_a") + 1)
    count = F.least("n", F.lit(cells)).cast("int")
    frame = frame.select(*keys, "start", "end", "n", low.alias("low"), ((high - low) / count).alias("width"), count.alias("count"), "middle")
    # what is known of a key goes along as part of it, so that it needn't be worked out and joined again
    known = [*keys, *(c for c in frame.columns if c not in keys)]
    placed = clean.join(frame, keys).withColumn("_at", (F.col("x") - F.col("low")) / F.col("width"))
    placed = placed.withColumn("cell", F.least(F.floor("_at"), F.col("count") - 1).cast("int")).select(*known, "cell", (F.col("_at") - F.col("cell")).alias("v"), (F.col("y") - F.col("middle")).alias("y"))
    power = lambda k: reduce(lambda a, b: a * b, [F.col("v")] * k, F.lit(1.0))
    sums = [F.sum(power(k)).alias(f"s{k}") for k in range(2 * degree + 1)] + [F.sum(F.col("y") * power(k)).alias(f"l{k}") for k in range(degree + 1)] + [F.sum(F.col("y") * F.col("y")).alias("q")]
    # small rows make much work, so they are dealt by number and not by size
    count = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_cell = placed.groupBy(*known, "cell").agg(*sums).repartition(count, *known)
    return by_cell.groupBy(*known).agg(F.array_sort(F.collect_list(F.struct("cell", *[c for c in by_cell.columns if c not in (*known, "cell")]))).alias("cells"))


def curve_fits(points: DataFrame, spans: DataFrame, keys: list[str], degree: int = 5, smoothing: float = 0.5, multiplier: float = 3.0, cells: int = CELLS) -> DataFrame:
    """A smoothing spline for each key: ``keys, start, end, n, budget, residual, within, knots, pieces, middle``.

    The residual budget is ``smoothing * multiplier`` for each point; ``within`` says whether ``residual`` keeps to it, which fails only where
    more knots than cells would be wanted. Keys with fewer than four points, or without a span, give nothing.
    """
    rows = cell_sums(points, spans, keys, degree, cells)
    kind = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kind[k]}" for k in keys) + ", start int, end int, n long, budget double, residual double, within boolean, knots array<double>, pieces array<array<double>>, middle double"
    names = [*keys, "start", "end", "n", "budget", "residual", "within", "knots", "pieces", "middle"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(len(batch)):
                one = {n: batch.column(n)[i] for n in ("n", "low", "width", "count", "cells")}
                held = one["cells"].values
                many = lambda prefix, k: np.stack([held.field(f"{prefix}{j}").to_numpy(zero_copy_only=False) for j in range(k)], 1)  # noqa: B023, E731
                sums = Cells(one["low"].as_py(), one["width"].as_py(), held.field("cell").to_numpy(), many("s", 2 * degree + 1), many("l", degree + 1), held.field("q").to_numpy(), one["count"].as_py())
                budget = smoothing * multiplier * one["n"].as_py()
                fit = sums.smooth(budget)
                out.append((budget, fit.residual, fit.residual <= budget, fit.knots.tolist(), fit.pieces.tolist()))
            found = [pa.array([o[j] for o in out], t) for j, t in enumerate((pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64()))))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "start", "end", "n")), *found, batch.column("middle")], names)

    return rows.mapInArrow(run, schema)


def curve_values(fits: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, x, y, within`` of fitted curves at every whole x of their span (end exclusive), y cut to a whole number."""
    kind = dict(fits.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                start, end = batch.column("start")[i].as_py(), batch.column("end")[i].as_py()
                knots = batch.column("knots")[i].values.to_numpy()
                pieces = batch.column("pieces")[i].values.flatten().to_numpy().reshape(len(knots) - 1, -1)
                fit = Fit(knots, pieces, 0.0)
                for at in range(start, end, 1 << 16):
                    x = np.arange(at, min(end, at + (1 << 16)))
                    y = np.trunc(fit(x.astype(float)) + batch.column("middle")[i].as_py())
                    same = pa.array(np.full(len(x), i))
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(same) for k in keys), pa.array(x, pa.int32()), pa.array(y.astype(np.int32)), batch.column("within").take(same)], [*keys, "x", "y", "within"])

    return fits.select(*keys, "start", "end", "knots", "pieces", "middle", "within").mapInArrow(run, ", ".join(f"`{k}` {kind[k]}" for k in keys) + ", x int, y int, within boolean")


def fitted_curve(points: DataFrame, spans: DataFrame, keys: list[str], name: str, degree: int = 5, smoothing: float = 0.5, multiplier: float = 3.0) -> DataFrame:
    """``keys, curve, x, y, within`` at every whole x of each key's span: ``curve_values`` of ``curve_fits``."""
    return curve_values(curve_fits(points, spans, keys, degree, smoothing, multiplier), keys).select(*keys, F.lit(name).alias("curve"), "x", "y", "within")
