"""Queries over depth profiles and series of intensities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lamella.functions.register import register
from lamella.functions.profiles import first_crossing, grey, quantile, refracted_depth, surface_peak
from lamella.operators.ascan import air_threshold, averaged_scans, inspected, moving_average, noise_floor, speckle_median, without_outliers
from lamella.operators.depth import combined_depth, lesion_statistics, long_form, method_stability, primary_depth, shoulder, with_fit, with_knee
from lamella.operators.surface import cut
from lamella.plans.common import POINTS, profiles, r6, table

KNEE_SQL = f"""
{POINTS},
norm AS (SELECT vec_id, label, z, z / (max(z) OVER w + 1e-10) AS x, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-10) AS y
         FROM pts WINDOW w AS (PARTITION BY vec_id)),
sums AS (SELECT vec_id, label, z, x, y,
                count(*) OVER l AS n1, sum(x) OVER l AS sx1, sum(x * x) OVER l AS sxx1, sum(y) OVER l AS sy1, sum(x * y) OVER l AS sxy1,
                count(*) OVER r AS n2, sum(x) OVER r AS sx2, sum(x * x) OVER r AS sxx2, sum(y) OVER r AS sy2, sum(x * y) OVER r AS sxy2
         FROM norm WINDOW l AS (PARTITION BY vec_id ORDER BY z), r AS (PARTITION BY vec_id ORDER BY z DESC)),
fits AS (SELECT vec_id, label, z AS i,
                (n1 * sxy1 - sx1 * sy1) / (n1 * sxx1 - sx1 * sx1) AS m1, (n2 * sxy2 - sx2 * sy2) / (n2 * sxx2 - sx2 * sx2) AS m2,
                sx1, sy1, n1, sx2, sy2, n2
         FROM sums WHERE n1 > 1 AND n2 > 1),
errs AS (SELECT f.vec_id, f.i,
                sum(CASE WHEN p.z <= f.i THEN abs(p.y - ((f.sy1 - f.m1 * f.sx1) / f.n1 + f.m1 * p.x)) ELSE 0 END)
                + sum(CASE WHEN p.z >= f.i THEN abs(p.y - ((f.sy2 - f.m2 * f.sx2) / f.n2 + f.m2 * p.x)) ELSE 0 END) AS err
         FROM fits f JOIN norm p ON p.vec_id = f.vec_id GROUP BY f.vec_id, f.i),
low AS (SELECT vec_id, min(err) AS least FROM errs GROUP BY vec_id),
knees AS (SELECT e.vec_id, min(e.i) AS knee FROM errs e JOIN low USING (vec_id) WHERE e.err <= least + 1e-9 GROUP BY e.vec_id)"""

GRID_K, GRID_Z = (0.05, 0.1, 0.2, 0.4, 0.8, 1.6), tuple(range(4, 61, 4))
GRID_B, GRID_D = (-0.8, -0.4, -0.2), (-0.1, -0.05, -0.02)


def _grid(a: tuple, b: tuple) -> list[tuple[float, float]]:
    return [(float(x), float(y)) for x in a for y in b]


def _values(grid: list[tuple[float, float]]) -> str:
    return ", ".join(f"(CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE))" for a, b in grid)


SIGMOID_SQL = f"""
grid AS (SELECT * FROM (VALUES {_values(_grid(GRID_K, GRID_Z))}) g(k, z0)),
shaped AS (SELECT p.vec_id, g.k, g.z0, p.v AS y, 1 / (1 + exp(g.k * (p.z - g.z0))) AS s FROM pts p, grid g),
fit AS (SELECT vec_id, k, z0, count(*) AS n, sum(s) AS ss, sum(s * s) AS sss, sum(y) AS sy, sum(s * y) AS ssy, sum(y * y) AS syy FROM shaped GROUP BY vec_id, k, z0),
solved AS (SELECT vec_id, k, z0, (n * ssy - ss * sy) / (n * sss - ss * ss) AS slope, n, ss, sy, sss, ssy, syy FROM fit),
sig AS (SELECT vec_id, arg_min(k, sse) AS k, arg_min(z0, sse) AS z0, arg_min(lower + slope, sse) AS upper, arg_min(lower, sse) AS lower, min(sse) AS sse
        FROM (SELECT vec_id, k, z0, slope, lower, syy - 2 * lower * sy - 2 * slope * ssy + n * lower * lower + 2 * lower * slope * ss + slope * slope * sss AS sse
              FROM (SELECT *, (sy - slope * ss) / n AS lower FROM solved)) GROUP BY vec_id)"""

DEPTHS_SQL = f"""{KNEE_SQL}, {SIGMOID_SQL},
depths AS (SELECT e.vec_id, e.label, CAST(knee AS DOUBLE) AS knee, z0 AS inflection, z0 + (-ln(1 / 0.85 - 1)) / k AS shoulder
           FROM embeddings e JOIN knees USING (vec_id) JOIN sig USING (vec_id)),
lng AS (SELECT vec_id, label, 'knee' AS method, knee AS depth FROM depths UNION ALL SELECT vec_id, label, 'inflection', inflection FROM depths
        UNION ALL SELECT vec_id, label, 'shoulder', shoulder FROM depths),
stab AS (SELECT label, method, count(*) AS n, avg(depth) AS mean, CASE WHEN count(*) >= 3 THEN stddev_pop(depth) END AS sd,
                coalesce(CASE WHEN count(*) >= 3 THEN stddev_pop(depth) END <= 20, false) AS stable FROM lng GROUP BY label, method)"""


def knee_depth_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_knee(profiles(spark, sf_dir))
    return found.groupBy("label").agg(F.count("*").alias("n"), r6(F.avg("knee")).alias("mean_knee"))


def sigmoid_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_fit(profiles(spark, sf_dir), "sigmoid", grid=_grid(GRID_K, GRID_Z), steps=0, box=None)
    return found.select("vec_id", "k", "z0", *[F.round(c, 4).alias(c) for c in ("upper", "lower", "sse")])


def exp2_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_fit(profiles(spark, sf_dir), "exp2", grid=_grid(GRID_B, GRID_D), steps=0, box=None)
    return found.select("vec_id", "b", "d", *[F.round(c, 4).alias(c) for c in ("a", "c", "sse")])


EXP2_SQL = f"""WITH {POINTS},
grid AS (SELECT * FROM (VALUES {_values(_grid(GRID_B, GRID_D))}) g(b, d)),
shaped AS (SELECT p.vec_id, g.b, g.d, p.v AS y, exp(g.b * p.z) AS p, exp(g.d * p.z) AS q FROM pts p, grid g),
fit AS (SELECT vec_id, b, d, sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq, sum(y * p) AS yp, sum(y * q) AS yq, sum(y * y) AS yy FROM shaped GROUP BY vec_id, b, d),
solved AS (SELECT *, (yp * qq - yq * pq) / (pp * qq - pq * pq) AS a, (yq * pp - yp * pq) / (pp * qq - pq * pq) AS c FROM fit),
scored AS (SELECT *, yy - 2 * a * yp - 2 * c * yq + a * a * pp + 2 * a * c * pq + c * c * qq AS sse FROM solved)
SELECT vec_id, arg_min(b, sse) AS b, arg_min(d, sse) AS d, round(arg_min(a, sse), 4) AS a, round(arg_min(c, sse), 4) AS c, round(min(sse), 4) AS sse FROM scored GROUP BY vec_id"""


def _bounded_sql(first: str, second: str, grid: str, p: str, q: str, factors: tuple[str, str]) -> str:
    """The best fit on a grid with both factors from 0 to 255: free where they fall inside, else the best of the four edges."""
    edges = " UNION ALL ".join(
        f"SELECT vec_id, i, u, v, pp, pq, qq, yp, yq, yy, {e}::DOUBLE AS a, greatest(0, least(255, (yq - {e} * pq) / qq)) AS c, {2 + n} AS o FROM fit UNION ALL "
        f"SELECT vec_id, i, u, v, pp, pq, qq, yp, yq, yy, greatest(0, least(255, (yp - {e} * pq) / pp)), {e}::DOUBLE, {3 + n} FROM fit" for n, e in ((0, 0), (2, 255)))
    a, c = factors
    return f"""WITH {POINTS},
    grid AS (SELECT row_number() OVER () AS i, u, v FROM (VALUES {grid}) g(u, v)),
    shaped AS (SELECT s.vec_id, g.i, g.u, g.v, s.v AS y, {p} AS p, {q} AS q FROM pts s, grid g),
    fit AS (SELECT vec_id, i, u, v, sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq, sum(y * p) AS yp, sum(y * q) AS yq, sum(y * y) AS yy FROM shaped GROUP BY vec_id, i, u, v),
    free AS (SELECT *, (yp * qq - yq * pq) / (pp * qq - pq * pq) AS a, (yq * pp - yp * pq) / (pp * qq - pq * pq) AS c, 1 AS o FROM fit),
    inner_ AS (SELECT * FROM free WHERE a BETWEEN 0 AND 255 AND c BETWEEN 0 AND 255),
    outer_ AS (SELECT e.* FROM ({edges}) e ANTI JOIN inner_ USING (vec_id, i)),
    tried AS (SELECT *, yy - 2 * a * yp - 2 * c * yq + a * a * pp + 2 * a * c * pq + c * c * qq AS sse FROM (SELECT * FROM inner_ UNION ALL SELECT * FROM outer_)),
    best AS (SELECT * FROM tried QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(sse, 6), i, o) = 1)
    SELECT vec_id, u AS {first}, v AS {second}, round(a, 4) + 0.0 AS {a}, round(c, 4) + 0.0 AS {c}, round(sse, 4) AS sse, a <= 0 OR a >= 255 OR c <= 0 OR c >= 255 AS hit_bound FROM best"""


def sigmoid_bounded_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid fit with values from 0 to 255, and whether one of them is a bound."""
    found = with_fit(profiles(spark, sf_dir), "sigmoid", grid=_grid(GRID_K, GRID_Z), steps=0)
    return found.select("vec_id", "k", "z0", *[(F.round(c, 4) + 0.0).alias(c) for c in ("upper", "lower")], F.round("sse", 4).alias("sse"), "hit_bound")


def exp2_bounded_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid fit with factors from 0 to 255, and whether one of them is a bound."""
    found = with_fit(profiles(spark, sf_dir), "exp2", grid=_grid(GRID_B, GRID_D), steps=0)
    return found.select("vec_id", "b", "d", *[(F.round(c, 4) + 0.0).alias(c) for c in ("a", "c")], F.round("sse", 4).alias("sse"), "hit_bound")


def depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_fit(with_knee(profiles(spark, sf_dir)), "sigmoid", grid=_grid(GRID_K, GRID_Z), steps=0, box=None)
    return found.select("vec_id", "label", F.col("knee").cast("double").alias("knee"), F.col("z0").alias("inflection"), shoulder(F.col("z0"), F.col("k")).alias("shoulder"))


def method_stability_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = method_stability(long_form(depths(spark, sf_dir), ["vec_id", "label"]), ["label"])
    return found.select("label", "method", "n", r6("mean").alias("mean"), r6("sd").alias("sd"), "stable")


def combined_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(depths(spark, sf_dir))
    stability = method_stability(long_form(found, ["vec_id", "label"]), ["label"])
    return combined_depth(found, stability, ["label"]).select("vec_id", "label", r6("combined").alias("combined"), "method")


COMBINED_SQL = f"""WITH {DEPTHS_SQL},
wide AS (SELECT label, max(mean) FILTER (method = 'knee') AS km, max(sd) FILTER (method = 'knee') AS ks, bool_or(stable) FILTER (method = 'knee') AS ko,
                max(mean) FILTER (method = 'inflection') AS im, bool_or(stable) FILTER (method = 'inflection') AS io, max(sd) FILTER (method = 'inflection') AS isd,
                max(mean) FILTER (method = 'shoulder') AS sm, max(sd) FILTER (method = 'shoulder') AS ss, bool_or(stable) FILTER (method = 'shoulder') AS so FROM stab GROUP BY label),
shp AS (SELECT d.*, w.*, CASE WHEN ko AND so THEN (knee * greatest(ks, 0.1) + shoulder * greatest(ss, 0.1)) / (greatest(ks, 0.1) + greatest(ss, 0.1)) WHEN ko THEN knee WHEN so THEN shoulder END AS shape,
               CASE WHEN ko AND so THEN (km + sm) / 2 WHEN ko THEN km WHEN so THEN sm END AS centre,
               CASE WHEN ko AND so THEN 'knee_point+sigmoid_shoulder' WHEN ko THEN 'knee_point' WHEN so THEN 'sigmoid_shoulder' END AS lab
        FROM depths d JOIN wide w USING (label))
SELECT vec_id, label,
       round(CASE WHEN io AND shape IS NOT NULL THEN shape + (inflection - shape) * CASE WHEN abs(im - centre) > 0 THEN 0.4 * (1 - exp(-abs(inflection - shape) / abs(im - centre))) * 0.5 ELSE 0 END
            WHEN io THEN inflection WHEN shape IS NOT NULL THEN shape
            ELSE CASE WHEN ks <= isd AND ks <= ss THEN knee WHEN isd <= ss THEN inflection ELSE shoulder END END, 6) AS combined,
       CASE WHEN io AND shape IS NOT NULL THEN 'inflection_offset+' || lab WHEN io THEN 'inflection_only' WHEN ko AND so THEN lab || '_weighted' WHEN shape IS NOT NULL THEN lab
            ELSE CASE WHEN ks <= isd AND ks <= ss THEN 'fallback_knee_point' WHEN isd <= ss THEN 'fallback_sigmoid_fit' ELSE 'fallback_sigmoid_shoulder' END END AS method
FROM shp"""


def lesion_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refracted depths of each slice; every third scan is in a cavity, with a reference curve for every second one."""
    cavity, reference = F.col("vec_id") % 3 == 0, F.when(F.col("vec_id") % 2 == 0, F.lit(10.0))
    found = primary_depth(depths(spark, sf_dir), "knee").withColumn("depth", refracted_depth(F.col("depth"), cavity, F.lit(12.0), reference))
    return lesion_statistics(found, ["label"]).select("label", "n", *[r6(c).alias(c) for c in ("mean", "median", "sd", "se")])


LESION_SQL = f"""WITH {DEPTHS_SQL},
d AS (SELECT label, CASE WHEN vec_id % 3 = 0 AND vec_id % 2 = 0 THEN 2.0 + knee / 1.5 ELSE knee / 1.5 END AS depth FROM depths)
SELECT label, count(*) AS n, round(avg(depth), 6) AS mean, round(median(depth), 6) AS median, round(stddev_pop(depth), 6) AS sd, round(stddev_pop(depth) / sqrt(count(*)), 6) AS se FROM d GROUP BY label"""


def air_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pixels of one slice a user; views are the air rectangle of users with an even number."""
    pixels = table(spark, sf_dir, "events").withColumn("air", (F.col("event_type") == "view") & (F.col("user_id") % 2 == 0))
    return air_threshold(pixels, ["user_id"], "value", "air").select("user_id", r6("threshold").alias("threshold"))


AIR_SQL = """SELECT user_id, round(coalesce(quantile_cont(value, 0.95) FILTER (event_type = 'view' AND user_id % 2 = 0) * 1.6, quantile_cont(value, 0.5)), 6) AS threshold
FROM events GROUP BY user_id"""


def first_crossing_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profiles(spark, sf_dir).withColumn("crossing", first_crossing(F.col("profile"), F.lit(150.0), 5))
    return found.select("vec_id", "crossing", surface_peak(F.col("profile"), F.col("crossing"), 24).alias("surface_y"))


CROSSING_SQL = f"""WITH {POINTS},
c AS (SELECT vec_id, min(z) FILTER (z >= 5 AND v > 150) AS crossing FROM pts GROUP BY vec_id),
w AS (SELECT p.vec_id, crossing, z, v, lag(v) OVER s AS before, lead(v) OVER s AS after, max(v) OVER (PARTITION BY p.vec_id) AS top
      FROM pts p JOIN c USING (vec_id) WHERE z >= crossing AND z < crossing + 24 WINDOW s AS (PARTITION BY p.vec_id ORDER BY z)),
f AS (SELECT vec_id, arg_min(z, z) FILTER (v >= before AND v > after) AS z1, arg_min(v, z) FILTER (v >= before AND v > after) AS v1, max(top) AS top, min(z) FILTER (v = top) AS zt FROM w GROUP BY vec_id)
SELECT c.vec_id, CAST(crossing AS INTEGER) AS crossing, CAST(CASE WHEN v1 >= 0.66 * top THEN z1 ELSE zt END AS INTEGER) AS surface_y FROM c LEFT JOIN f USING (vec_id)"""


def moving_average_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = moving_average(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 7)
    return found.select("event_id", r6("smooth").alias("smooth"))


ORDERED = "ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
MOVING_SQL = f"""WITH {ORDERED}
SELECT a.event_id, round(avg(b.value), 6) AS smooth FROM ev a JOIN ev b ON a.user_id = b.user_id AND abs(a.i - b.i) <= least(3, a.i, a.n - 1 - a.i) GROUP BY a.event_id"""


def speckle_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speckle_median(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", r6("filtered").alias("filtered"))


SPECKLE_SQL = f"""WITH {ORDERED},
near AS (SELECT a.event_id, a.value, o.d, CASE WHEN a.i + o.d < 0 THEN -1 - (a.i + o.d) WHEN a.i + o.d >= a.n THEN 2 * a.n - 1 - (a.i + o.d) ELSE a.i + o.d END AS j, a.user_id
         FROM ev a, (VALUES (-2), (-1), (0), (1), (2)) o(d)),
m AS (SELECT x.event_id, any_value(x.value) AS value, median(b.value) AS med FROM near x JOIN ev b ON b.user_id = x.user_id AND b.i = x.j GROUP BY x.event_id)
SELECT event_id, round(CASE WHEN value < 100 THEN med ELSE value END, 6) AS filtered FROM m"""


def noise_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = profiles(spark, sf_dir).withColumn("low", quantile(F.col("profile"), 0.01))
    return noise_floor(scans, ["label"], ["vec_id"], "low").select("vec_id", r6("noise").alias("noise"))


NOISE_SQL = f"""WITH {POINTS}, lows AS (SELECT vec_id, label, quantile_cont(v, 0.01) AS low FROM pts GROUP BY vec_id, label)
SELECT vec_id, round(sum(low) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 128 PRECEDING AND 127 FOLLOWING) / 256, 6) AS noise FROM lows"""


def robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_outliers(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return found.select("event_id", r6("filtered").alias("filtered"), "kept")


OUTLIER_SQL = f"""WITH {ORDERED},
f AS (SELECT a.event_id, a.user_id, a.value, list_sort(list_concat(list(b.value), list_resize(CAST([] AS DOUBLE[]), 7 - count(*), 0.0)))[4] AS filtered
      FROM ev a JOIN ev b ON a.user_id = b.user_id AND abs(a.i - b.i) <= 3 GROUP BY a.event_id, a.user_id, a.value),
g AS (SELECT *, abs(value - filtered - avg(value - filtered) OVER u) <= 2 * stddev_pop(value - filtered) OVER u AS good FROM f WINDOW u AS (PARTITION BY user_id))
SELECT event_id, round(filtered, 6) AS filtered, CASE WHEN sum(CAST(good AS INTEGER)) OVER (PARTITION BY user_id) < 4 THEN true ELSE good END AS kept FROM g"""


def ascan_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complex scans whose imaginary part is the profile upside down, in fours."""
    points = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("z", "re"), F.reverse("embedding").alias("back"))
    points = points.select("vec_id", "z", F.col("re").cast("double").alias("re"), F.get("back", F.col("z")).cast("double").alias("im"))
    return averaged_scans(points, ["z"], "vec_id", 4).select("group", "z", *[r6(c).alias(c) for c in ("incoherent", "coherent", "first")])


AVERAGE_SQL = """WITH p AS (SELECT vec_id, unnest(range(0, len(embedding))) AS z, CAST(unnest(embedding) AS DOUBLE) AS re, CAST(unnest(list_reverse(embedding)) AS DOUBLE) AS im FROM embeddings)
SELECT vec_id // 4 AS "group", CAST(z AS INTEGER) AS z, round(avg(sqrt(re * re + im * im)), 6) AS incoherent, round(sqrt(avg(re) ** 2 + avg(im) ** 2), 6) AS coherent,
       round(arg_min(sqrt(re * re + im * im), vec_id), 6) AS first FROM p GROUP BY vec_id // 4, z"""


def grey_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", r6(grey(F.col("value") * 100, 30, 100)).alias("grey"))


GREY_SQL = "SELECT event_id, round(least(greatest(255 * (20 * log10(value * 100) - 30) / 70, 0.0), 255.0), 6) AS grey FROM events"


def scan_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profiles(spark, sf_dir).withColumn("y", F.coalesce(first_crossing(F.col("profile"), F.lit(150.0), 5), F.lit(0)))
    parts = rows.select("vec_id", F.explode(inspected(F.col("profile"), F.col("y"), 20)).alias("p"))
    return parts.groupBy("vec_id", "p.segment").agg(F.count("*").alias("n"), r6(F.avg("p.v")).alias("mean"))


INSPECT_SQL = f"""WITH {POINTS}, c AS (SELECT vec_id, coalesce(min(z) FILTER (z >= 5 AND v > 150), 0) AS y FROM pts GROUP BY vec_id)
SELECT vec_id, CASE WHEN z < y THEN 'above' WHEN z < y + 20 THEN 'fitting' ELSE 'below' END AS segment, count(*) AS n, round(avg(v), 6) AS mean FROM pts JOIN c USING (vec_id) GROUP BY 1, 2"""

def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered functions over all profiles."""
    register(spark)
    rows = profiles(spark, sf_dir).selectExpr("vec_id", "knee(profile) AS knee", "grey(profile[0], 20D, 80D) AS g", "moving_average(profile, 5)[3] AS m")
    return rows.select("vec_id", "knee", r6("g").alias("g"), r6("m").alias("m"))


QUERIES = {
    "sql_functions": sql_functions,
    "knee_depth_by_label": knee_depth_by_label, "sigmoid_grid": sigmoid_grid, "exp2_grid": exp2_grid, "sigmoid_bounded_grid": sigmoid_bounded_grid, "exp2_bounded_grid": exp2_bounded_grid, "method_stability": method_stability_by_label,
    "combined_depth": combined_depths, "lesion_stats": lesion_stats, "air_threshold": air_thresholds, "first_crossing_peak": first_crossing_peak,
    "moving_average_shrink": moving_average_shrink, "speckle_median": speckle_filter, "noise_floor": noise_floors, "robust_outliers": robust_outliers,
    "ascan_average": ascan_average, "grey_map": grey_map, "scan_inspection": scan_inspection,
}
ORACLE_SQL = {
    "sql_functions": f"""WITH {KNEE_SQL}, a AS (SELECT vec_id, round(least(greatest(255 * (20 * log10(max(v) FILTER (z = 0)) - 20) / 60, 0.0), 255.0), 6) AS g, round(avg(v) FILTER (z BETWEEN 1 AND 5), 6) AS m FROM pts GROUP BY vec_id)
    SELECT vec_id, CAST(knee AS INTEGER) AS knee, g, m FROM knees JOIN a USING (vec_id)""",
    "knee_depth_by_label": f"WITH {KNEE_SQL} SELECT label, count(*) AS n, round(avg(knee), 6) AS mean_knee FROM embeddings JOIN knees USING (vec_id) GROUP BY label",
    "sigmoid_grid": f"WITH {POINTS}, {SIGMOID_SQL} SELECT vec_id, k, z0, round(upper, 4) AS upper, round(lower, 4) AS lower, round(sse, 4) AS sse FROM sig",
    "exp2_grid": EXP2_SQL,
    "sigmoid_bounded_grid": _bounded_sql("k", "z0", _values(_grid(GRID_K, GRID_Z)), "1 / (1 + exp(g.u * (s.z - g.v)))", "1 - 1 / (1 + exp(g.u * (s.z - g.v)))", ("upper", "lower")),
    "exp2_bounded_grid": _bounded_sql("b", "d", _values(_grid(GRID_B, GRID_D)), "exp(g.u * s.z)", "exp(g.v * s.z)", ("a", "c")),
    "method_stability": f"WITH {DEPTHS_SQL} SELECT label, method, n, round(mean, 6) AS mean, round(sd, 6) AS sd, stable FROM stab",
    "combined_depth": COMBINED_SQL, "lesion_stats": LESION_SQL, "air_threshold": AIR_SQL, "first_crossing_peak": CROSSING_SQL, "moving_average_shrink": MOVING_SQL,
    "speckle_median": SPECKLE_SQL, "noise_floor": NOISE_SQL, "robust_outliers": OUTLIER_SQL, "ascan_average": AVERAGE_SQL, "grey_map": GREY_SQL, "scan_inspection": INSPECT_SQL,
}
