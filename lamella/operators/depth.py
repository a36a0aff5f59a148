"""Lesion depth from profiles: knee, exponential and sigmoid fits, stability, and their combination."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructType

TIE = 1e-9


def knees(rows: np.ndarray) -> np.ndarray:
    """Index of the knee of each row: two least-squares lines that meet there leave the least absolute residuals.

    Both axes are scaled to 0..1. Errors within ``TIE`` count as equal and the smallest index wins;
    -1 for fewer than three values.
    """
    n = rows.shape[1]
    if n < 3:
        return np.full(len(rows), -1)
    x = np.arange(n) / (n - 1 + 1e-10)
    low = rows.min(axis=1, keepdims=True)
    y = (rows - low) / (rows.max(axis=1, keepdims=True) - low + 1e-10)
    count = np.arange(1, n + 1)
    sums = [np.cumsum(x), np.cumsum(x * x), np.cumsum(y, axis=1), np.cumsum(x * y, axis=1)]
    errors = np.empty((len(rows), n - 2))
    for i in range(1, n - 1):
        error = 0.0
        for part, m in ((slice(0, i + 1), count[i]), (slice(i, n), n - i)):
            sx, sxx, sy, sxy = (s[..., i] if part.start == 0 else s[..., -1] - s[..., i - 1] for s in sums)
            slope = (m * sxy - sx * sy) / (m * sxx - sx * sx)
            level = (sy - slope * sx) / m
            error = error + np.abs(y[:, part] - (level[:, None] + slope[:, None] * x[part])).sum(axis=1)
        errors[:, i - 1] = error
    return (errors <= errors.min(axis=1, keepdims=True) + TIE).argmax(axis=1) + 1


def _products(y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The sums over depths of products of every row of ``y`` and of ``p``, added from the top down as a running sum does.

    A matrix product adds in an order that depends on the number of rows and the machine, and with it the last bits of an error.
    """
    total = y[:, :1] * p[:, 0]
    for z in range(1, y.shape[1]):
        total += y[:, z : z + 1] * p[:, z]
    return total


def _exp(x: np.ndarray) -> np.ndarray:
    """Exponentials by the machine's mathematical library, to the last bit, for the few points of a grid."""
    return np.array([exp(v) for v in x.ravel().tolist()]).reshape(x.shape)


def _solved(y: np.ndarray, p: np.ndarray, q: np.ndarray, low: float | None, high: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least-squares (a, c, sse) of ``y ~ a p + c q`` for every row of y and pair of shapes, within a box if one is given."""
    pp, pq, qq, yy = (np.cumsum(v, axis=1)[:, -1] for v in (p * p, p * q, q * q, y * y))
    yp, yq, yy = _products(y, p), _products(y, q), yy[:, None]
    sse = lambda a, c: yy - 2 * a * yp - 2 * c * yq + a * a * pp + 2 * a * c * pq + c * c * qq
    det = pp * qq - pq * pq
    with np.errstate(divide="ignore", invalid="ignore"):
        a, c = (yp * qq - yq * pq) / det, (yq * pp - yp * pq) / det
    if low is None:
        return a, c, np.where(np.isfinite(a + c), sse(a, c), np.inf)
    best_a, best_c = a, c
    fits = np.isfinite(a + c) & (a >= low) & (a <= high) & (c >= low) & (c <= high)
    best = np.where(fits, sse(a, c), np.inf)
    # on an edge of the box one factor is fixed and the other follows
    for fixed in (low, high):
        for which in (0, 1):
            other = np.clip(((yq - fixed * pq) / qq) if which == 0 else ((yp - fixed * pq) / pp), low, high)
            ea, ec = (np.full_like(other, fixed), other) if which == 0 else (other, np.full_like(other, fixed))
            value = sse(ea, ec)
            better = ~fits & (value < best)
            best, best_a, best_c = np.where(better, value, best), np.where(better, ea, best_a), np.where(better, ec, best_c)
    return best_a, best_c, best


def _levelled(y: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least-squares (a, c, sse) of ``y ~ a s + c (1 - s)`` for every row of y and shape, by level and slope."""
    n, (ss, sss, sy, syy) = y.shape[1], (np.cumsum(v, axis=1)[:, -1] for v in (s, s * s, y, y * y))
    sy, syy, ssy = sy[:, None], syy[:, None], _products(y, s)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (n * ssy - ss * sy) / (n * sss - ss * ss)
    level = (sy - slope * ss) / n
    sse = syy - 2 * level * sy - 2 * slope * ssy + n * level * level + 2 * level * slope * ss + slope * slope * sss
    return level + slope, level, np.where(np.isfinite(slope), sse, np.inf)


def _best(y: np.ndarray, grid: np.ndarray, kind: str, low, high) -> tuple[np.ndarray, ...]:
    p, q = (sigmoid_shapes if kind == "sigmoid" else exp2_shapes)(y.shape[1])(grid)
    a, c, sse = _levelled(y, p) if kind == "sigmoid" and low is None else _solved(y, p, q, low, high)
    at = sse.argmin(axis=1)
    i = np.arange(len(y))
    return grid[at, 0], grid[at, 1], a[i, at], c[i, at], sse[i, at]


def sigmoid_shapes(n: int):
    z = np.arange(n)

    def shapes(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        upper = 1 / (1 + _exp(np.clip(grid[:, :1] * (z - grid[:, 1:]), -700, 700)))
        return upper, 1 - upper

    return shapes


def exp2_shapes(n: int):
    z = np.arange(n)
    return lambda grid: (_exp(grid[:, :1] * z), _exp(grid[:, 1:] * z))


def _slopes(kind: str, z: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The curves of rows of (two shape parameters, two factors) at ``z``, and their slopes by each parameter."""
    u, v, a, c = (t[:, i : i + 1] for i in range(4))
    if kind == "sigmoid":
        p = 1 / (1 + np.exp(np.clip(u * (z - v), -700, 700)))
        steep = (a - c) * p * (1 - p)
        return a * p + c * (1 - p), np.stack((-steep * (z - v), steep * u, p, 1 - p), axis=2)
    p, q = np.exp(u * z), np.exp(v * z)
    return a * p + c * q, np.stack((a * z * p, c * z * q, p, q), axis=2)


def refined(y: np.ndarray, start: np.ndarray, kind: str, low: np.ndarray, high: np.ndarray, steps: int) -> np.ndarray:
    """Damped Gauss-Newton steps from ``start`` (parameters and squared error by row) inside [low, high], all rows at once.

    A parameter at its bound that would leave is held there for the step. A row takes a step only if its error falls, so no fit gets
    worse; it is done when the error falls by less than a millionth of a millionth, or can't.
    """
    z, out, damp = np.arange(y.shape[1], dtype=np.float64), start.copy(), np.full(len(y), 1e-3)
    going = np.flatnonzero(np.isfinite(out[:, 4]))
    for _ in range(steps):
        if not len(going):
            break
        t = out[going, :4]
        curve, slopes = _slopes(kind, z, t)
        pull = np.einsum("rn,rnk->rk", y[going] - curve, slopes)
        free = ~(((t <= low) & (pull < 0)) | ((t >= high) & (pull > 0)))
        square = (slopes.transpose(0, 2, 1) @ slopes) * (free[:, :, None] & free[:, None, :])
        size = np.einsum("rkk->rk", square)
        square[:, np.arange(4), np.arange(4)] = size * (1 + damp[going, None]) + np.where(size > 0, 1e-12 * size.max(axis=1, keepdims=True), 1.0)
        moved = np.clip(t + np.linalg.solve(square, (pull * free)[:, :, None])[:, :, 0], low, high)
        error = ((y[going] - _slopes(kind, z, moved)[0]) ** 2).sum(axis=1)
        fell = out[going, 4] - error
        better = fell > 0
        out[going[better], :4], out[going[better], 4] = moved[better], error[better]
        damp[going] = np.where(better, damp[going] / 5, damp[going] * 6)
        going = going[np.where(better, fell > 1e-12 * (error + 1e-12), damp[going] < 1e9)]
    return out


def fitted(y: np.ndarray, kind: str, grid: np.ndarray | None = None, steps: int = 30, box: tuple[float, float] | None = (0.0, 255.0)) -> np.ndarray:
    """For each row the best fit: two shape parameters, two factors, the squared error, and 1 where a parameter lies on its bound.

    ``sigmoid``: k, z0 with factors (value above, value below); ``exp2``: b, d with factors (a, c). The best point of a grid, with the
    factors that fit best there inside ``box``, is refined by up to ``steps`` bounded steps; none leave the grid's.
    """
    n = y.shape[1]
    low, high = box or (None, None)
    if grid is None:
        if kind == "sigmoid":
            first, second = np.geomspace(0.001, 2, 9), np.linspace(0, n - 1, min(n, 24))
        else:
            first = second = -np.concatenate(([0], np.geomspace(0.001, 1, 20)))
        grid = np.array([(u, v) for u in first for v in second if kind == "sigmoid" or u < v])
    out = np.stack(_best(y, grid, kind, low, high), axis=1)
    limits = [(0.001, 2), (0, n - 1)] if kind == "sigmoid" else [(-1, 0), (-1, 0)]
    least, most = (np.array([*(x[i] for x in limits), *[(-np.inf, np.inf)[i] if box is None else box[i]] * 2], dtype=np.float64) for i in (0, 1))
    for at in range(0, len(y) if steps else 0, 1024):
        out[at : at + 1024] = refined(y[at : at + 1024], out[at : at + 1024], kind, least, most, steps)
    return np.column_stack((out, ((out[:, :4] <= least) | (out[:, :4] >= most)).any(axis=1)))


def _by_length(values: list[list[float] | None], work, width: int) -> np.ndarray:
    """``work`` on each group of profiles of one length; rows of NaN for the others."""
    out = np.full((len(values), width), np.nan)
    groups: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        if v is not None and None not in v:
            groups.setdefault(len(v), []).append(i)
    for n, rows in groups.items():
        if n:
            result = work(np.array([values[i] for i in rows], dtype=np.float64))
            if result is not None:
                out[rows] = result
    return out


def with_knee(df: DataFrame, profile: str = "profile", out: str = "knee") -> DataFrame:
    """Adds the knee's index of each profile; null under three values, or with a null in it."""
    kept = df.drop(out)
    place = kept.columns.index(profile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _by_length(batch.column(place).to_pylist(), lambda y: knees(y)[:, None], 1)[:, 0]
            found = pa.array([None if not v >= 0 else int(v) for v in found], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, out])

    return kept.mapInArrow(run, StructType([*kept.schema.fields]).add(out, IntegerType()))


def with_fit(df: DataFrame, kind: str, profile: str = "profile", grid: list[tuple[float, float]] | None = None, steps: int = 30, box: tuple[float, float] | None = (0.0, 255.0), least: int = 5) -> DataFrame:
    """Adds the best fit of each profile: k, z0, upper, lower, sse for ``sigmoid``; b, d, a, c, sse for ``exp2``; and ``hit_bound``.

    ``hit_bound`` says that a parameter lies on its bound, so that the curve may not be the profile's. Profiles with fewer than ``least`` values or a null get nulls. Existing columns of these names are replaced.
    """
    names = {"sigmoid": ("k", "z0", "upper", "lower", "sse"), "exp2": ("b", "d", "a", "c", "sse")}[kind]
    kept = df.drop(*names, "hit_bound")
    place = kept.columns.index(profile)
    points = None if grid is None else np.array(grid, dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _by_length(batch.column(place).to_pylist(), lambda y: fitted(y, kind, points, steps, box) if y.shape[1] >= least else None, 6)
            columns = [pa.array([None if np.isnan(v) else v for v in found[:, i]], pa.float64()) for i in range(5)]
            columns.append(pa.array([None if np.isnan(v) else bool(v) for v in found[:, 5]], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names, "hit_bound"])

    schema = StructType([*kept.schema.fields])
    for name in names:
        schema = schema.add(name, DoubleType())
    schema = schema.add("hit_bound", BooleanType())
    return kept.mapInArrow(run, schema)


def shoulder(z0: Column, k: Column, mode: str = "reference") -> Column:
    """Depth at which the sigmoid has lost 15 % of its height.

    The customary value lies below the inflection; ``analytic`` gives the curve's own crossing above it.
    """
    distance = F.lit(-float(np.log(1 / 0.85 - 1))) / k
    return z0 + distance if mode == "reference" else z0 - distance


METHODS = ("knee", "inflection", "shoulder")


def long_form(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each method with a depth: ``keys, method, depth``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("depth")) for m in METHODS]))
    return df.select(*keys, pairs.alias("_m")).select(*keys, "_m.*").where("depth is not null")


#: What the labels of combined depths call the methods.
NAMES = {"knee": "knee_point", "inflection": "sigmoid_fit", "shoulder": "sigmoid_shoulder"}


def method_stability(depths: DataFrame, keys: list[str], limit: float = 20.0) -> DataFrame:
    """``n, mean, sd, stable`` of each method's depths in a slice; fewer than three are unstable and have no deviation."""
    found = depths.groupBy(*keys, "method").agg(F.count("*").alias("n"), F.avg("depth").alias("mean"), F.stddev_pop("depth").alias("sd"))
    found = found.withColumn("sd", F.when(F.col("n") >= 3, F.col("sd")))
    return found.withColumn("stable", F.coalesce(F.col("sd") <= limit, F.lit(False)))


def combined_depth(df: DataFrame, stability: DataFrame, keys: list[str], weight: float = 0.4, anchor: float = 0.5) -> DataFrame:
    """Adds ``combined`` and ``method``: what the stable methods of a slice make of each column's depths.

    Stable shapes (knee, shoulder) are averaged by their deviations, at least 0.1 each. With a stable
    inflection the average moves towards it, by less the smaller their difference is beside that of the
    slice's means. Alone, either stands. Without a stable method the least scattered one that is there
    counts, of equals the first of knee, inflection, shoulder.
    """
    wide = stability.groupBy(*keys).agg(*[F.max(F.when(F.col("method") == m, F.col(c))).alias(f"{m}_{c}") for m in METHODS for c in ("mean", "sd", "stable")])
    rows = df.join(wide, keys, "left")
    ok = {m: F.coalesce(F.col(f"{m}_stable"), F.lit(False)) & F.col(m).isNotNull() for m in METHODS}
    w = {m: F.greatest(F.col(f"{m}_sd"), F.lit(0.1)) for m in METHODS}
    pick = lambda value: F.when(ok["knee"] & ok["shoulder"], value("both")).when(ok["knee"], value("knee")).when(ok["shoulder"], value("shoulder"))
    shape = pick(lambda m: (F.col("knee") * w["knee"] + F.col("shoulder") * w["shoulder"]) / (w["knee"] + w["shoulder"]) if m == "both" else F.col(m).cast("double"))
    centre = pick(lambda m: (F.col("knee_mean") + F.col("shoulder_mean")) / 2 if m == "both" else F.col(f"{m}_mean"))
    label = pick(lambda m: F.lit(f"{NAMES['knee']}+{NAMES['shoulder']}") if m == "both" else F.lit(NAMES[m]))
    gap = F.abs(F.col("inflection_mean") - centre)
    offset = F.col("inflection") - shape
    share = F.when(gap > 0, weight * (1 - F.exp(-F.abs(offset) / gap)) * anchor).otherwise(F.lit(0.0))
    fallback = F.array_min(F.filter(F.array(*[F.when(F.col(m).isNotNull() & F.col(f"{m}_sd").isNotNull(), F.struct(F.col(f"{m}_sd").alias("sd"), F.lit(i).alias("i"), F.col(m).cast("double").alias("d"), F.lit(NAMES[m]).alias("m"))) for i, m in enumerate(METHODS)]), lambda s: s.isNotNull()))
    first = F.coalesce(*[F.when(F.col(m).isNotNull(), F.struct(F.lit(None).cast("double").alias("sd"), F.lit(i).alias("i"), F.col(m).cast("double").alias("d"), F.lit(NAMES[m]).alias("m"))) for i, m in enumerate(METHODS)])
    last = F.coalesce(fallback, first)
    combined = F.when(ok["inflection"] & shape.isNotNull(), shape + offset * share).when(ok["inflection"], F.col("inflection").cast("double")).when(shape.isNotNull(), shape).otherwise(last["d"])
    name = F.when(ok["inflection"] & shape.isNotNull(), F.concat_ws("+", F.lit("inflection_offset"), label)).when(ok["inflection"], "inflection_only").when(ok["knee"] & ok["shoulder"], F.concat(label, F.lit("_weighted"))).when(shape.isNotNull(), label).when(last.isNotNull(), F.concat(F.lit("fallback_"), last["m"])).otherwise("none")
    return rows.select(*df.columns, combined.alias("combined"), name.alias("method"))


#: Depth methods by name, as columns over knee, inflection and shoulder; users may add their own.
DEPTH_METHODS: dict[str, Callable[[], Column]] = {"knee": lambda: F.col("knee"), "inflection": lambda: F.col("inflection"), "shoulder": lambda: F.col("shoulder"), "combined": lambda: F.col("knee")}


def primary_depth(df: DataFrame, method: str) -> DataFrame:
    """Rows with ``depth`` by a method of ``DEPTH_METHODS``; those where it found none go, with all their methods."""
    if method not in DEPTH_METHODS:
        raise ValueError(f"unknown depth method {method!r}")
    return df.withColumn("depth", DEPTH_METHODS[method]().cast("double")).where("depth is not null")


def lesion_statistics(df: DataFrame, keys: list[str], depth: str = "depth") -> DataFrame:
    """``n, mean, median, sd, se`` of the depths of a slice; a slice without depths has nulls."""
    d = F.col(depth)
    return df.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.median(d).alias("median"), F.stddev_pop(d).alias("sd"), (F.stddev_pop(d) / F.sqrt(F.count(d))).alias("se"))
