"""Operators against values worked out by hand and against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.functions import cells, profiles, rules
from lamella.operators import ascan, curves, depth, geometry, queue, results, series, spectral, surface
from lamella.functions.register import register
from lamella.operators.overlay import overlay, region_corners
from lamella.operators.specimen import analysed


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first()[0]


# --- depths


def plain_knee(v):
    n = len(v)
    x = np.arange(n) / (n - 1 + 1e-10)
    y = (v - v.min()) / (v.max() - v.min() + 1e-10)
    errors = []
    for i in range(1, n - 1):
        error = 0
        for part in (slice(0, i + 1), slice(i, n)):
            slope, level = np.polyfit(x[part], y[part], 1)
            error += np.abs(y[part] - level - slope * x[part]).sum()
        errors.append(error)
    return int(np.argmin(np.array(errors) > min(errors) + 1e-9)) + 1


def test_knees():
    draw = np.random.default_rng(1)
    rows = draw.normal(size=(20, 30)).cumsum(axis=1)
    assert depth.knees(rows).tolist() == [plain_knee(r) for r in rows]
    bend = np.concatenate((np.linspace(200, 50, 21), np.linspace(50, 40, 20)[1:]))
    assert depth.knees(bend[None])[0] == 20
    assert depth.knees(np.ones((1, 2)))[0] == -1


def test_sigmoid_fit_recovers_inflection():
    z = np.arange(60)
    y = 20 + 180 / (1 + np.exp(0.3 * (z - 30)))
    k, z0, upper, lower, _, hit = depth.fitted(y[None], "sigmoid")[0]
    assert abs(z0 - 30) < 0.1 and abs(upper - 200) < 2 and abs(lower - 20) < 2
    draw = np.random.default_rng(2)
    noisy = y + draw.normal(0, 4, (20, 60))
    assert np.median(np.abs(depth.fitted(noisy, "sigmoid")[:, 1] - 30)) < 0.5


@pytest.mark.parametrize("kind", ["sigmoid", "exp2"])
def test_refined_fits_are_no_worse_than_finer_grids(kind):
    draw = np.random.default_rng(7)
    z = np.arange(120)
    if kind == "sigmoid":
        y = np.array([20 + 180 / (1 + np.exp(k * (z - m))) for k, m in zip(draw.uniform(0.03, 0.6, 25), draw.uniform(15, 100, 25))])
        fine = [(k, m) for k in np.geomspace(0.02, 0.8, 60) for m in np.arange(10, 105, 1.0)]
    else:
        y = np.array([a * np.exp(b * z) + c * np.exp(d * z) for a, b, c, d in zip(draw.uniform(20, 200, 25), draw.uniform(-0.4, -0.05, 25), draw.uniform(10, 90, 25), draw.uniform(-0.02, 0, 25))])
        fine = [(b, d) for b in -np.geomspace(0.03, 0.6, 60) for d in -np.geomspace(0.0001, 0.029, 50)]
    y = y + draw.normal(0, 4, y.shape)
    best, plain = depth.fitted(y, kind), depth.fitted(y, kind, np.array(fine), steps=0)
    assert (best[:, 4] <= plain[:, 4] * (1 + 1e-9)).all() and not best[:, 5].any()
    curve = depth._slopes(kind, z, best[:, :4])[0]
    assert np.allclose(((y - curve) ** 2).sum(axis=1), best[:, 4])


@pytest.mark.parametrize("box", [None, (0.0, 255.0)])
@pytest.mark.parametrize("kind", ["sigmoid", "exp2"])
def test_grid_errors_are_running_sums(kind, box):
    y = np.random.default_rng(3).normal(128, 25, (300, 64))
    grid = np.array([(0.2, 20.0), (0.8, 40.0)] if kind == "sigmoid" else [(-0.4, -0.05), (-0.8, -0.02), (-0.2, -0.02)])
    got = depth.fitted(y, kind, grid, steps=0, box=box)
    for i in range(0, 300, 37):  # to the last bit, whatever rows are beside
        assert (depth.fitted(y[i : i + 1], kind, grid, steps=0, box=box) == got[i]).all()
    if kind == "exp2" and box:  # with the first factor at its bound its shape doesn't count: the first of the grid
        for row, (b, d, a, c, sse, _) in zip(y.tolist(), got.tolist(), strict=True):
            yq = qq = yy = 0.0
            for z, v in enumerate(row):
                q = math.exp(d * z)
                yq, qq, yy = yq + v * q, qq + q * q, yy + v * v
            if a == 0:
                assert (b, c) == (-0.8 if d == -0.02 else -0.4, yq / qq) and sse == yy - 2 * c * yq + c * c * qq
        assert (got[:, 2] == 0).sum() > 10


def test_fits_at_their_bounds_say_so(spark):
    z = np.arange(60)
    rows = [("low", (400 / (1 + np.exp(0.3 * (z - 30)))).tolist()), ("fine", (20 + 180 / (1 + np.exp(0.3 * (z - 30)))).tolist()), ("steep", np.where(z < 30, 200.0, 20.0).tolist()), ("short", [1.0])]
    got = {r.id: r for r in depth.with_fit(spark.createDataFrame(rows, "id string, profile array<double>"), "sigmoid").collect()}
    assert got["low"].hit_bound and got["low"].upper == 255 and not got["fine"].hit_bound and got["steep"].hit_bound and got["steep"].k == 2 and got["short"].hit_bound is None
    slope = depth._slopes("exp2", z, np.array([[-0.2, -0.01, 100.0, 50.0]]))[1][0]
    for i in range(4):
        t = np.array([[-0.2, -0.01, 100.0, 50.0]] * 2)
        t[:, i] += (-1e-6, 1e-6)
        a, b = depth._slopes("exp2", z, t)[0]
        assert np.allclose((b - a) / 2e-6, slope[:, i], atol=1e-4)


def test_exp2_fit_stays_in_its_box():
    z = np.arange(60)
    y = 200 * np.exp(-z / 20) + 20
    b, d, a, c, sse, hit = depth.fitted(y[None], "exp2")[0]
    assert sse / 60 < 1 and 0 <= a <= 255 and 0 <= c <= 255 and -1 <= b <= 0 and -1 <= d <= 0
    out = depth.fitted((400 * np.exp(-z / 9))[None], "exp2")[0]
    assert 0 <= out[2] <= 255 and 0 <= out[3] <= 255


def test_fits_of_short_and_missing_profiles(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [3.0, None, 1.0, 1.0, 1.0]), (4, []), (5, [9.0, 5.0, 2.0, 1.0, 1.0, 1.0])], "id int, profile array<double>")
    got = {r.id: (r.knee, r.k) for r in depth.with_fit(depth.with_knee(df), "sigmoid").collect()}
    assert all(got[i] == (None, None) for i in (1, 2, 3, 4)) and got[5][0] is not None and got[5][1] is not None


STABLE = "s int, method string, n long, mean double, sd double, stable boolean"
COLUMNS = "s int, knee double, inflection double, shoulder double"


@pytest.mark.parametrize(
    ("row", "stability", "want", "label"),
    [
        ((1, None, 40.0, None), [("inflection", 40.0, 3.0, True)], 40.0, "inflection_only"),
        ((1, 50.0, None, 60.0), [("knee", 50.0, 2.0, True), ("shoulder", 60.0, 4.0, True)], 56.6666667, "knee_point+sigmoid_shoulder_weighted"),
        ((1, 50.0, 50.0, 50.0), [("knee", 50.0, 1.0, True), ("inflection", 50.0, 1.0, True), ("shoulder", 50.0, 1.0, True)], 50.0, "inflection_offset+knee_point+sigmoid_shoulder"),
        ((1, 55.0, None, None), [("knee", 55.0, 30.0, False)], 55.0, "fallback_knee_point"),
        ((1, None, None, None), [], None, "none"),
    ],
)
def test_combined_depth(spark, row, stability, want, label):
    df = spark.createDataFrame([row], COLUMNS)
    st = spark.createDataFrame([(1, m, 5, a, s, ok) for m, a, s, ok in stability], STABLE)
    r = depth.combined_depth(df, st, ["s"]).first()
    assert r.method == label and (r.combined is None if want is None else r.combined == pytest.approx(want))


def test_stability(spark):
    rows = [(1, "knee", 100.0)] * 5 + [(1, "shoulder", 10.0)]
    got = {r.method: r for r in depth.method_stability(spark.createDataFrame(rows, "s int, method string, depth double"), ["s"]).collect()}
    assert got["knee"].stable and got["knee"].sd == 0 and not got["shoulder"].stable and got["shoulder"].sd is None


def test_shoulder_modes(spark):
    z0, k = F.lit(30.0), F.lit(0.5)
    assert one(spark, depth.shoulder(z0, k)) == pytest.approx(30 + 1.7346 / 0.5, abs=1e-3)
    assert one(spark, depth.shoulder(z0, k, "analytic")) == pytest.approx(30 - 1.7346 / 0.5, abs=1e-3)


# --- long series


@pytest.mark.parametrize("block", [10, 300, 8192])
def test_windows_are_whole_at_the_joints_of_blocks(spark, block):
    draw = np.random.default_rng(block)
    rows = [(str(draw.choice(["a", "a", "a", "b"])) if i % 50 else None, int(i), float(draw.normal())) for i in draw.permutation(900)]
    got = {r.i: r.noise for r in ascan.noise_floor(spark.createDataFrame(rows, "s string, i int, v double"), ["s"], ["i"], "v", block=block).collect()}
    for key in ("a", "b", None):
        own = sorted((i, v) for s, i, v in rows if s == key)
        for at, (i, _) in enumerate(own):
            assert got[i] == pytest.approx(sum(v for _, v in own[max(0, at - 128) : at + 128]) / 256)
    assert len(got) == 900


def test_places_in_one_large_group(spark):
    df = spark.range(20_000, numPartitions=4).select(F.lit("host").alias("k"), F.xxhash64("id").alias("v"), (F.col("id") % 7).alias("w"))
    found = series.placed(df, ["k"], [F.col("w"), "v"])
    rows = found.orderBy("place").collect()
    assert [r.place for r in rows] == list(range(20_000)) and [(r.w, r.v) for r in rows] == sorted((r.w, r.v) for r in rows)
    held = df.repartitionByRange(4, "k", "w", "v").groupBy(F.spark_partition_id()).count().collect()
    assert len(held) == 4 and max(r["count"] for r in held) < 10_000  # a group of all rows lies in all tasks
    assert series.placed(df.limit(0), ["k"], ["v"]).count() == 0


# --- surfaces


def test_smooth_curve_keeps_polynomials_and_its_budget():
    x = np.arange(60.0)
    y = 3 + 0.5 * x - 0.01 * x**2
    assert np.abs(curves.smooth_curve(x, y, x, 3, 1.0) - y).max() < 1e-3
    noisy = y + np.random.default_rng(3).normal(0, 2, 60)
    fit = curves.smooth_curve(x, noisy, x, 3, 300.0)
    assert ((noisy - fit) ** 2).sum() <= 300.0001


@pytest.mark.parametrize(("degree", "budget"), [(5, 3000.0), (3, 3000.0), (3, 200.0)])
def test_knots_are_added_until_the_budget_is_kept(degree, budget):
    draw = np.random.default_rng(degree)
    x = np.arange(2000.0)
    y = 100 * np.sin(x / 20) + draw.normal(0, 1, 2000)
    sums = curves.Cells.of(x, y - y.mean(), 0, 2000, degree)
    fit = sums.smooth(budget)
    own = ((y - y.mean() - fit(x)) ** 2).sum()
    assert 0.99 * budget < own <= budget * (1 + 1e-9) and own == pytest.approx(fit.residual)
    assert 20 < len(fit.knots) < 300 or budget < 2000
    border = fit.knots[1:-1]
    assert np.abs(fit(border - 1e-7) - fit(border + 1e-7)).max() < 1e-2


def test_banded_systems():
    draw = np.random.default_rng(2)
    for n, k in ((5, 3), (curves.FULL + 200, 6)):
        full = np.triu(np.tril(draw.normal(size=(n, n)), k - 1), 1 - k)
        full = full + full.T + 20 * k * np.eye(n)
        band = np.stack([np.concatenate((np.diagonal(full, j), np.zeros(j))) for j in range(k)], axis=1)
        load = draw.normal(size=n)
        assert np.allclose(full @ curves.banded_solve(band, load), load)


def test_bases_of_splines_sum_to_one_and_are_smooth():
    knots = np.array([0.0, 1, 3, 4, 8])
    pieces = curves.basis_pieces(knots, 3)
    assert np.allclose(pieces.sum(axis=1), [[1, 0, 0, 0]] * 4)
    coefficients = np.random.default_rng(1).normal(size=7)
    fit = curves.Fit(knots, np.stack([(coefficients[j : j + 4, None] * pieces[j]).sum(axis=0) for j in range(4)]), 0.0)
    for at in knots[1:-1]:
        near = fit(np.array([at - 2e-3, at - 1e-3, at, at + 1e-3, at + 2e-3]))
        assert abs(near[0] - 2 * near[1] + near[2] - (near[2] - 2 * near[3] + near[4])) < 1e-7


def test_a_million_points_of_one_key(spark):
    n = 1_000_000
    noise = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20) * 2 - 1
    points = spark.range(n, numPartitions=8).select(F.lit("a").alias("s"), (F.col("id") * 1000 / n).alias("x"), (50 * F.sin(F.col("id") * 1000 / n / 3) + 1.7 * noise).alias("y"))
    points = points.unionByName(spark.createDataFrame([("b", float(x), float(x % 2)) for x in range(100)] + [("c", 1.0, 1.0)] * 3 + [("d", 1.0, None)] * 5, "s string, x double, y double"))
    spans = spark.createDataFrame([("a", 0, 1000), ("b", 0, 100), ("c", 0, 5), ("d", 0, 5)], "s string, start int, end int")
    fits = {r.s: r for r in curves.curve_fits(points, spans, ["s"], degree=5, smoothing=1.0, multiplier=1.0).collect()}
    assert set(fits) == {"a", "b"} and fits["a"].within and fits["a"].n == n and 0.99 * n < fits["a"].residual <= n
    model = curves.Fit(np.array(fits["a"].knots), np.array(fits["a"].pieces), 0.0)
    held = points.where("s = 'a'").select("x", "y").toPandas().to_numpy()
    assert ((held[:, 1] - fits["a"].middle - model(held[:, 0])) ** 2).sum() == pytest.approx(fits["a"].residual, rel=1e-6)
    tight = {r.s: r for r in curves.curve_fits(points, spans, ["s"], degree=3, smoothing=0.01, multiplier=1.0, cells=64).collect()}
    assert not tight["a"].within and tight["a"].residual > tight["a"].budget


@pytest.mark.parametrize("degree", [3, 5])
def test_pieces_of_uneven_knots_are_the_recursion_by_hand(degree):
    knots = np.array([0.0, 1, 3, 4, 8, 9, 15])
    full = np.concatenate(([knots[0]] * degree, knots, [knots[-1]] * degree))

    def spline(i, p, x):
        if p == 0:
            return float(full[i] <= x < full[i + 1])
        parts = ((full[i], full[i + p], 1, i), (full[i + p + 1], full[i + 1], -1, i + 1))
        return sum((x - a) / (b - a) * spline(j, p - 1, x) if sign > 0 else (a - x) / (a - b) * spline(j, p - 1, x) for a, b, sign, j in parts if a != b)

    pieces = curves.basis_pieces(knots, degree)
    for j, (a, b) in enumerate(zip(knots[:-1], knots[1:])):
        for u in (0.0, 0.3, 0.9):
            want = [spline(j + r, degree, a + u * (b - a)) for r in range(degree + 1)]
            assert np.allclose(pieces[j] @ u ** np.arange(degree + 1), want, atol=1e-12)
    draw, n = np.random.default_rng(1), 40
    band = np.abs(draw.normal(size=(n, degree + 2))) + np.where(np.arange(degree + 2) == 0, 20, 0)
    full_matrix = sum(np.diag(band[: n - k, k], k) + (np.diag(band[: n - k, k], -k) if k else 0) for k in range(degree + 2))
    load = draw.normal(size=n)
    assert np.allclose(curves.banded_solve(band, load), np.linalg.solve(full_matrix, load), atol=1e-12)


def test_fitted_curve(spark):
    points = spark.createDataFrame([(1, float(x), 100.0 + x % 3) for x in range(50)] + [(2, 1.0, 1.0)], "s int, x double, y double")
    spans = spark.createDataFrame([(1, 0, 50), (2, 0, 5)], "s int, start int, end int")
    got = surface.fitted_curve(points, spans, ["s"], "actual_surface").collect()
    assert len(got) == 50 and all(r.s == 1 and 98 <= r.y <= 103 for r in got)


def test_density_clusters_against_plain(spark):
    draw = np.random.default_rng(4)
    points = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate((draw.normal(0, 15, (60, 2)), draw.normal(120, 15, (60, 2)), draw.uniform(-300, 300, (40, 2)))))]
    xy = np.array([p[2:] for p in points])
    near = ((xy[:, None] - xy[None]) ** 2).sum(2) <= 17**2
    core = near.sum(1) >= 10
    name = np.where(core, np.arange(len(xy)), 10**6)
    for _ in range(len(xy)):
        name = np.where(core, np.where(near & core, name, 10**6).min(1), 10**6)
    border = np.where(near & core, name, 10**6).min(1)
    want = {i: None if b == 10**6 else int(b) for i, b in enumerate(border)}
    df = spark.createDataFrame(points, "s int, pid int, x double, y double")
    clustered = surface.density_clusters(df, ["s"])
    assert {r.pid: r.cluster for r in clustered.collect()} == want
    sizes = {c: sum(v == c for v in want.values()) for c in set(want.values()) - {None}}
    kept = surface.large_clusters(clustered, ["s"], 10**4).collect()
    assert len(kept) == max(sizes.values())
    assert surface.large_clusters(surface.density_clusters(df.limit(3), ["s"]), ["s"]).count() == 3


def test_density_clusters_of_odd_places(spark):
    crowd = [("a", i, float(i % 3), float(i % 2)) for i in range(40)]
    odd = [("a", 100, None, 1.0), ("a", 101, float("nan"), 1.0), ("a", 102, 1.0, float("inf")), (None, 103, 1.0, 1.0), ("b", 104, 1.0, 1.0)]
    far = [("a", 200 + i, 19.0 + 17.0 * i, 0.0) for i in range(2)]
    found = {r.pid: r.cluster for r in surface.density_clusters(spark.createDataFrame(crowd + odd + far, "s string, pid int, x double, y double"), ["s"]).collect()}
    assert {found[i] for i in range(40)} == {0} and found[200] == 0 and found[201] is None
    assert all(found[i] is None for i in range(100, 105))
    assert surface.density_clusters(spark.createDataFrame([], "s int, pid int, x double, y double"), ["s"]).count() == 0


def test_density_clusters_over_many_tiles(spark, monkeypatch):
    """Chains over small tiles, pixels, crowds and copies have the clusters of all pairs; inside tiles no rounds are needed."""
    draw = np.random.default_rng(5)
    walk = np.cumsum(draw.normal(0, 6, (500, 2)), axis=0)
    pixels = draw.integers(-150, -60, (500, 2)).astype(float)
    xy = np.concatenate((walk, pixels, np.repeat([[200.0, 90.0], [216.5, 90.0]], 30, axis=0), draw.uniform(-400, 400, (300, 2))))
    near = ((xy[:, None] - xy[None]) ** 2).sum(2) <= 17**2
    core, none = near.sum(1) >= 10, 10**6
    name, before = np.where(core, np.arange(len(xy)), none), None
    while not np.array_equal(name, before):
        before, name = name, np.where(core, np.where(near & core, name, none).min(1), none)
    want = {i: None if b == none else int(b) for i, b in enumerate(np.where(near & core, name, none).min(1))}
    cuts, cut = [], surface.cut
    monkeypatch.setattr(surface, "cut", lambda df: cuts.append(1) or cut(df))
    df = spark.createDataFrame([("s", i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "s string, pid long, x double, y double")
    for tile in (6, 1000):
        monkeypatch.setattr(surface, "TILE", tile)
        assert {r.pid: r.cluster for r in surface.density_clusters(df.withColumns({"x": F.col("x") + 3000, "y": F.col("y") + 3000}), ["s"]).collect()} == want
    cuts.clear()
    assert surface.density_clusters(df.where("x > 0 and y > 0"), ["s"]).count() and len(cuts) <= 2
    every = np.ones(len(xy), dtype=bool)
    one = np.zeros(len(xy), dtype=int)
    plain = surface.tile_clusters(one, *xy.T, every, every, 17.0, 10)
    monkeypatch.setattr(surface, "PAIRS", 7)
    assert all(np.array_equal(a, b) for a, b in zip(plain, surface.tile_clusters(one, *xy.T, every, every, 17.0, 10), strict=True))


def test_depth_methods_are_read_by_name(spark):
    df = spark.createDataFrame([(1, 2, 3), (None, 4, None)], "knee int, inflection int, shoulder int")
    for method, want in (("knee", [1.0]), ("inflection", [2.0, 4.0]), ("shoulder", [3.0]), ("combined", [1.0])):
        assert sorted(r.depth for r in depth.primary_depth(df, method).collect()) == want
    depth.DEPTH_METHODS["deeper"] = lambda: F.col("knee") + 10
    try:
        assert depth.primary_depth(df, "deeper").first().depth == 11
    finally:
        del depth.DEPTH_METHODS["deeper"]
    with pytest.raises(ValueError):
        depth.primary_depth(df, "none")


def test_queue_updates_know_their_fields(spark):
    df = spark.createDataFrame([("q", 0, "Pending")], "q string, position int, status string")
    with pytest.raises(ValueError):
        queue.updated(df, {"colour": F.lit(1)})
    assert queue.removed_at(df, ["q"], -1).first().error == "index -1 out of bounds"
    assert queue.removed_at(df, ["q"], 0).count() == 0


def test_cavitation(spark):
    curve = lambda y: spark.createDataFrame([(1, x, y) for x in range(50)], "s int, x int, y double")
    config = spark.createDataFrame([(1, 10, 40, 0)], "s int, lesion_start_x int, lesion_end_x int, buffer int")
    r = surface.cavitation(curve(150.0), curve(100.0), config, ["s"]).first()
    assert r.cavitated and r.depth == 50
    r = surface.cavitation(curve(100.0), curve(150.0), config, ["s"]).first()
    assert not r.cavitated and r.depth == 0


def test_specimen_analysis_finds_a_band(spark):
    image = np.full((120, 90), 10, dtype=np.uint8)
    for x in range(90):
        image[60:65, x] = 230
        for d in range(1, 50):
            image[64 + d, x] = int(np.clip(200 * np.exp(-d / 12) + 10, 0, 255))
    slices = spark.createDataFrame([("a", 0, 120, 90, bytearray(image.tobytes()))], "specimen_id string, slice int, height int, width int, pixels binary")
    config = spark.createDataFrame([("a", 0, 5, 30, 60, 88, 5, 0, 0, 20, 20)], "specimen_id string, slice int, start_x int, lesion_start_x int, lesion_end_x int, end_x int, buffer int, air_left int, air_top int, air_right int, air_bottom int")
    found = analysed(slices, config, 2, 2, above=20)
    assert {r.y for r in found["actual"].collect()} <= {63, 64}  # the last row of the plateau
    assert found["region_statistics"].count() == 4
    stats = found["depth_statistics"].first()
    assert stats.n == 20 and 0 < stats.mean < 60
    assert not found["cavities"].first().cavitated
    assert found["depth_curve"].count() == 20


# --- geometry


def frames(spark, rows, n):
    point = "struct<x:int,y:int>"
    df = spark.createDataFrame([(1, s, [(x + 10 * i, 10) for i in range(2)], k) for s, x, k in rows], f"g int, slice int, p array<{point}>, is_keyframe boolean")
    df = df.select("g", "slice", F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("b"), "is_keyframe")
    spine = spark.range(n).select(F.lit(1).alias("g"), F.col("id").cast("int").alias("slice"))
    return {r.slice: r.a.x if r.a else None for r in geometry.interpolated_keyframes(df, spine, ["g"], ["a", "b"]).collect()}


def test_keyframes(spark):
    assert set(frames(spark, [(2, 7, True)], 5).values()) == {7}
    assert frames(spark, [(0, 0, True), (2, 100, True)], 3)[1] == 50
    assert frames(spark, [(2, 5, True), (3, 9, True)], 5) == {0: 5, 1: 5, 2: 5, 3: 9, 4: 9}
    assert frames(spark, [(0, -5, True), (2, 0, True)], 3)[1] == -2
    assert frames(spark, [(0, 4, False)], 2) == {0: 4, 1: None}


def test_lengths(spark):
    assert one(spark, geometry.polyline_length(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (3, 4), (3, 10))]))) == 11
    assert one(spark, geometry.polyline_length(F.array(F.struct(F.lit(1).alias("x"), F.lit(1).alias("y"))))) == 0
    angle = np.linspace(0, np.pi, 9)
    rows = [("spline", [(float(100 * np.cos(a)), float(100 * np.sin(a))) for a in angle]), ("line", [(0.0, 0.0), (3.0, 4.0)]), ("spline", [(0.0, 0.0), (3.0, 4.0)]), ("spline", [(1.0, 1.0)] * 5)]
    got = [r.length for r in geometry.with_length(spark.createDataFrame(rows, "mode string, points array<struct<x:double,y:double>>").coalesce(1)).collect()]
    assert got[0] == pytest.approx(100 * np.pi, rel=2e-3) and got[1:] == [5, 5, 0]


def test_splines_of_many_points():
    t = np.sort(np.random.default_rng(8).uniform(0, 60, 100_000))
    line = geometry.spline(np.stack((t, np.sin(t)), axis=1), 200_000)
    inside = (line[:, 0] > 1) & (line[:, 0] < 59)
    assert np.abs(line[inside, 1] - np.sin(line[inside, 0])).max() < 1e-6
    points = np.random.default_rng(9).normal(size=(40, 2))
    h = np.hypot(*np.diff(points, axis=0).T)
    right = 6 * np.diff(np.diff(points, axis=0) / h[:, None], axis=0)
    system = np.zeros((40, 40))
    system[0, :3], system[-1, -3:] = (h[1], -(h[0] + h[1]), h[0]), (h[-1], -(h[-2] + h[-1]), h[-2])
    for i in range(1, 39):
        system[i, i - 1 : i + 2] = (h[i - 1], 2 * (h[i - 1] + h[i]), h[i])
    want = np.linalg.solve(system, np.vstack((np.zeros(2), right, np.zeros(2))))
    assert np.allclose(geometry._second_derivatives(h, right), want)


def test_spline_reproduces_cubics():
    t = np.linspace(0, 1, 6)
    line = geometry.spline(np.stack((t, 2 * t), axis=1), 50)
    assert np.allclose(line[:, 1], 2 * line[:, 0])
    assert np.allclose(line[0], (0, 0)) and np.allclose(line[-1], (1, 2))


def test_zoom_repeats_whole_factors(spark):
    picture = spark.createDataFrame([(1, r, c, float(10 * r + c)) for r in range(3) for c in range(2)], "k int, row int, col int, v double")
    assert {(r.row, r.col): r.v for r in geometry.zoomed(picture, ["k"]).collect()} == {(r, c): 10 * r + c for r in range(3) for c in range(2)}
    big = {(r.row, r.col): r.v for r in geometry.zoomed(picture, ["k"], rows=2, cols=2).collect()}
    assert len(big) == 24 and big[0, 0] == 0 and big[5, 3] == 21


# --- spectra


def test_spectral_parts():
    a = np.arange(10.0) ** 2
    want = [a[max(0, i - min(2, i, 9 - i)) : i + min(2, i, 9 - i) + 1].mean() for i in range(10)]
    assert np.allclose(spectral.shrinking_mean(a, 5), want)
    window = spectral.tukey(101, 0.5)
    assert window[0] == 0 and window[50] == 1 and np.allclose(window, window[::-1])
    spectra = np.random.default_rng(5).normal(size=(20, 600))
    low = np.concatenate((np.zeros(128), np.percentile(spectra, 1, axis=0), np.zeros(128)))
    assert np.allclose(spectra - spectral.noise_removed(spectra), [low[i : i + 256].mean() for i in range(600)])


def test_reconstruction_finds_a_reflector():
    n = 256
    chirp = np.arange(n, dtype=float)
    scan = 1000 + 300 * np.cos(2 * np.pi * 40 * chirp / n)
    spectra = np.concatenate((np.full((n, 8), 1000.0), np.repeat(scan[:, None], 6, axis=1)), axis=1)
    out = spectral.reconstructed(spectra, chirp, np.zeros(n), 8, taper=0.9, n=2)
    assert out.shape == (128, 3) and (out[5:].argmax(axis=0) + 5 == 40).all()
    assert spectral.grey_rows(out, 30, 100, speckle=True).dtype == np.uint8
    z = np.array([[1 + 1j, -1 - 1j, 2, 2]])
    assert np.allclose(spectral.averaged(z, 2, "incoherent"), [[2**0.5, 2]]) and np.allclose(spectral.averaged(z, 2, "coherent"), [[0, 2]]) and np.allclose(spectral.averaged(z, 2, "none"), [[2**0.5, 2]])


# --- cells, rules, queues


def test_cells(spark):
    c = lambda f, *v: one(spark, f(*[F.lit(x).cast("string") for x in v]))
    assert [c(cells.toggled, v) for v in ("", "YES", "NO", None)] == ["YES", "NO", "YES", "YES"]
    assert [c(cells.percentage, v) for v in ("95%", "100%", "", None, "x")] == ["100%", "100%", "5%", "5%", "5%"]
    assert c(cells.continuous, "", "1.005") in ("1.00", "1.01") and c(cells.continuous, "2.50", "1.25") == "3.75" and c(cells.continuous, "7", None) == "7"
    assert one(spark, cells.counted(F.lit(""), 0)) == "0" and one(spark, cells.counted(F.lit("4"), 1)) == "5"
    assert c(cells.parsed_integer, "3.0") is None and c(cells.parsed_integer, " 12 ") == 12 and c(cells.parsed_float, "3,5") == 3.5
    assert c(cells.natural_key, "slice_2") < c(cells.natural_key, "Slice_10")
    assert one(spark, cells.rgb(F.lit("#ff0010"))) == [255, 0, 16] and one(spark, cells.rgb(F.lit("x"))) == [255, 255, 178]
    assert one(spark, cells.font_colour(F.lit("#000000"))) == "white" and one(spark, cells.font_colour(F.lit("#ffffff"))) == "black"


def test_points_and_bounds(spark):
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(i).alias("y")) for i, x in enumerate((30, 10, 30, 5))])
    r = one(spark, rules.ordered_points(points))
    assert [(p.x, p.y) for p in r] == [(5, 3), (10, 1), (30, 0), (30, 2)]
    box = one(spark, rules.rectangle(points[0], points[1]))
    assert (box.top_left.x, box.top_left.y, box.bottom_right.x, box.bottom_right.y) == (10, 0, 30, 1)


def test_profile_functions(spark):
    p = F.array(*[F.lit(float(v)) for v in (1, 2, 9, 3, 8, 8, 2)])
    assert one(spark, profiles.first_crossing(p, F.lit(2.5), 0)) == 2
    assert one(spark, profiles.first_crossing(p, F.lit(99.0), 0)) is None
    assert one(spark, profiles.surface_peak(p, F.lit(1))) == 2
    assert one(spark, profiles.surface_peak(p, F.lit(2))) == 5  # the first inner maximum, not the edge
    assert one(spark, profiles.quantile(p, 0.25)) == np.percentile([1, 2, 9, 3, 8, 8, 2], 25)
    assert one(spark, profiles.intensity_grey(F.lit(1112000000), 20, 80)) == 127
    assert one(spark, profiles.exp2_curve(F.lit(2), F.lit(1.0), F.lit(-0.1), F.lit(2.0), F.lit(-0.2)))[0] == 3


def test_queue_edges(spark):
    q = spark.createDataFrame([("a", i, f"f{i}") for i in range(4)], "q string, position int, file string")
    names = lambda df: [r.file for r in df.orderBy("position").collect()]
    assert names(queue.reordered(q, ["q"], 3, 0)) == ["f3", "f0", "f1", "f2"]
    assert names(queue.reordered(q, ["q"], 9, 0)) == ["f0", "f1", "f2", "f3"]
    assert names(queue.removed(q, ["q"], [1, 7])) == ["f0", "f2", "f3"]
    bad = spark.createDataFrame([("a", "new", 5, 1)], "q string, file string, low int, high int")
    check = rules.result([rules.db_range_error(F.col("low"), F.col("high"))])
    assert queue.added(q, bad.select("q", "file", "low", "high").where(check["is_valid"]).select("q", "file"), ["q"]).count() == 4


def test_completeness(spark):
    s = spark.createDataFrame([("a",), ("b",)], "specimen_id string")
    p = "struct<x:int,y:int>"
    r = spark.createDataFrame([("a", (1, 1), (1, 1), None, (1, 1))], f"specimen_id string, specimen_start {p}, lesion_start {p}, lesion_end {p}, specimen_end {p}")
    a = spark.createDataFrame([("a", (1, 1))], f"specimen_id string, point1 {p}")
    got = {x.specimen_id: x.missing for x in results.completeness(s, r, a).collect()}
    assert got == {"a": ["region incomplete"], "b": ["region missing", "air missing"]}


def test_overlay(spark):
    config = spark.createDataFrame([("a", 0, 10, 40, 60, 90, 100, 1, 1, 5, 5), ("a", 1, None, None, None, None, 100, None, None, None, None)], "specimen_id string, slice int, start_x int, lesion_start_x int, lesion_end_x int, end_x int, height int, air_left int, air_top int, air_right int, air_bottom int")
    curve = spark.createDataFrame([("a", 0, "actual_surface", x, 20) for x in range(10, 90)], "specimen_id string, slice int, curve string, x int, y int")
    depths = spark.createDataFrame([("a", 0, 41, 25.0, None), ("a", 0, 42, 26.0, 27.0)], "specimen_id string, slice int, x int, y double, smoothed_y double")
    keys = ["specimen_id", "slice"]
    centres = spark.createDataFrame([("a", 0, "sound", 0, 30)], "specimen_id string, slice int, kind string, index int, centre int")
    regions = region_corners(centres, curve, keys)
    rows = overlay(config, curve, depths, regions, keys).collect()
    assert sorted(r.layer for r in rows) == ["actual_surface", "air", "lesion_boundary", "lesion_boundary", "lesion_depth", "sound_region", "specimen_boundary", "specimen_boundary"]
    square = next(r for r in rows if r.layer == "sound_region")
    assert [tuple(p) for p in square.points] == [(18, 30), (42, 30), (42, 54), (18, 54), (18, 30)] and square.label == "1"
    assert [tuple(p) for p in next(r for r in rows if r.layer == "lesion_depth").points] == [(41, 25), (42, 27)]


def test_sql_functions(spark):
    register(spark)
    assert [r.k for r in spark.sql("SELECT * FROM equidistant(1, 10, 4)").collect()] == [0, 3, 6, 9]
    assert spark.sql("SELECT moving_average(array(1D, 2D, 4D, 8D, 16D), 3) a").first().a == pytest.approx([1, 7 / 3, 14 / 3, 28 / 3, 16])
    assert spark.sql("SELECT knee(array(1D, 2D)) k").first().k is None
