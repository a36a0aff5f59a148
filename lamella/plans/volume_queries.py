"""Queries on slices, keyframes, regions, curves and pictures."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lamella.operators import geometry, results
from lamella.operators.ascan import air_threshold, value_counts
from lamella.operators.geometry import equidistant_rounded, equidistant_truncated, interpolated_keyframes, polyline_length, region_centres, region_statistics, resliced, slices_to_load, turned_centres, zoomed
from lamella.operators.stacks import resliced_stack, zoomed_stack
from lamella.operators.surface import cavitation, density_clusters, large_clusters
from lamella.plans.common import POINTS, profiles, r6, table

#: Slices that a task counts.
TASK_SLICES = 1 << 20
ORDERED = "ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS x FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("x", F.row_number().over(w) - 1)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as requests for slices: from 1 + key mod 7 to that plus size, some for none, some for too many."""
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 7 + 1).cast("int").alias("first"), (F.col("p_partkey") % 7 + 1 + F.col("p_size")).cast("int").alias("last"), (F.col("p_partkey") % 60).cast("int").alias("n"))


def _counted(requests: DataFrame, slices: Column) -> DataFrame:
    """How often each part asks for a slice. Parts are dealt before their slices become rows, to tasks of about ``TASK_SLICES``, so that a task counts its own only."""
    total = requests.agg(F.sum(F.greatest("n", F.lit(1)))).first()[0] or 0
    tasks = max(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(total / TASK_SLICES))
    return requests.repartition(tasks, "p_partkey").select("p_partkey", F.explode(slices).alias("k")).groupBy("p_partkey", "k").agg(F.count("*").alias("n"))


def equidistant_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_parts(spark, sf_dir), equidistant_truncated(F.col("first"), F.col("last"), F.col("n")))


PARTS = "p AS (SELECT p_partkey, p_partkey % 7 + 1 AS first, p_partkey % 7 + 1 + p_size AS last, p_partkey % 60 AS n FROM part)"
TRUNC_SQL = f"""WITH {PARTS}, k AS (SELECT p_partkey, CAST(trunc(CASE WHEN n = 1 THEN first - 1 WHEN i = n - 1 THEN last - 1 ELSE first - 1 + i * (CAST(last - first AS DOUBLE) / nullif(n - 1, 0)) END) AS INTEGER) AS k
FROM (SELECT p_partkey, first, last, n, unnest(range(0, n)) AS i FROM p))
SELECT p_partkey, k, count(*) AS n FROM k GROUP BY 1, 2"""


def equidistant_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_parts(spark, sf_dir), equidistant_rounded(F.col("first"), F.col("last"), F.col("n")))


ROUND_SQL = f"""WITH {PARTS}, k AS (
SELECT p_partkey, CAST(CASE WHEN n = 1 THEN (first + last) // 2 ELSE round_even(first + i * (CAST(last - first AS DOUBLE) / (n - 1)), 0) END AS INTEGER) AS k
FROM (SELECT *, unnest(range(0, n)) AS i FROM p WHERE n > 0 AND n < last - first + 1)
UNION ALL SELECT p_partkey, CAST(unnest(range(first, last + 1)) AS INTEGER) FROM p WHERE n > 1 AND n >= last - first + 1
UNION ALL SELECT p_partkey, CAST((first + last) // 2 AS INTEGER) FROM p WHERE n = 1 AND n >= last - first + 1)
SELECT p_partkey, k, count(*) AS n FROM k GROUP BY 1, 2"""


def slices_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    direction = F.get(F.array(F.lit("XZ"), F.lit("YZ"), F.lit("XY")), (F.col("p_partkey") % 3).cast("int"))
    rows = _parts(spark, sf_dir).where("n > 0").withColumn("loaded", slices_to_load(direction, equidistant_truncated(F.col("first"), F.col("last"), F.col("n")), F.col("last")))
    return rows.select("p_partkey", F.size("loaded").alias("n_loaded"), F.array_max("loaded").alias("highest"))


LOADED_SQL = f"""WITH {PARTS} SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN n ELSE last END AS INTEGER) AS n_loaded,
CAST(CASE WHEN p_partkey % 3 = 0 AND n = 1 THEN first - 1 ELSE last - 1 END AS INTEGER) AS highest FROM p WHERE n > 0"""


def keyframe_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as slices, every third a keyframe; some have no optional point."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("slice", F.row_number().over(w) - 1)
    point = lambda c: F.struct((c / 10).cast("int").alias("x"), (-c / 7).cast("int").alias("y"))
    price = F.col("o_totalprice")
    frames = rows.select("o_custkey", "slice", point(price).alias("p"), F.when(F.col("o_orderstatus") != "P", point(price + 5)).alias("q"), (F.col("slice") % 3 == 1).alias("is_keyframe"))
    found = interpolated_keyframes(frames, frames, ["o_custkey"], ["p", "q"])
    return found.select("o_custkey", "slice", F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("q.x").alias("qx"), "is_keyframe")


KEYFRAME_SQL = """WITH f AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS slice, CAST(trunc(o_totalprice / 10) AS INTEGER) AS px, CAST(trunc(-o_totalprice / 7) AS INTEGER) AS py,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(trunc((o_totalprice + 5) / 10) AS INTEGER) END AS qx FROM orders),
k AS (SELECT *, CASE WHEN slice % 3 = 1 THEN {'s': slice, 'px': px, 'py': py, 'qx': qx} END AS own FROM f),
n AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b0,
  first_value(own IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY slice ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a0 FROM k),
m AS (SELECT *, coalesce(b0, a0) AS b, coalesce(a0, b0) AS a FROM n),
t AS (SELECT *, CASE WHEN a.s > b.s THEN CAST(slice - b.s AS DOUBLE) / (a.s - b.s) ELSE 0.0 END AS t FROM m)
SELECT o_custkey, CAST(slice AS INTEGER) AS slice, CASE WHEN b IS NULL THEN px ELSE CAST(trunc(b.px + t * (a.px - b.px)) AS INTEGER) END AS px, CASE WHEN b IS NULL THEN py ELSE CAST(trunc(b.py + t * (a.py - b.py)) AS INTEGER) END AS py,
  CASE WHEN b IS NULL THEN qx WHEN b.qx IS NULL THEN NULL WHEN a.qx IS NULL THEN b.qx ELSE CAST(trunc(b.qx + t * (a.qx - b.qx)) AS INTEGER) END AS qx, own IS NOT NULL AS is_keyframe FROM t"""


def cavitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of events as two curves by the order of events, the lesion in the middle."""
    ev = _events(spark, sf_dir)
    pairs = ev.select("user_id", F.floor(F.col("x") / 2).cast("int").alias("x"), (F.col("x") % 2).alias("side"), F.col("value").alias("y"))
    configs = ev.groupBy("user_id").agg(F.lit(5).alias("lesion_start_x"), F.lit(40).alias("lesion_end_x"), F.lit(3).alias("buffer"))
    found = cavitation(pairs.where("side = 0"), pairs.where("side = 1"), configs, ["user_id"], 10, 0.5)
    return found.select("user_id", "cavitated", r6("depth").alias("depth"))


CAVITY_SQL = f"""WITH {ORDERED}, p AS (SELECT user_id, x // 2 AS x, max(value) FILTER (x % 2 = 0) AS a, max(value) FILTER (x % 2 = 1) AS b FROM ev GROUP BY user_id, x // 2),
d AS (SELECT user_id, a - b AS d FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND x BETWEEN 8 AND 37)
SELECT user_id, coalesce(avg(d) FILTER (d > 0) > 10 AND count(*) FILTER (d > 0) / count(*) >= 0.5, false) AS cavitated, round(coalesce(avg(d) FILTER (d > 0), 0.0), 6) AS depth FROM d GROUP BY user_id"""


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    start = (F.col("s_suppkey") % 50).cast("int")
    return s.select("s_suppkey", start.alias("start_x"), (start + 60).alias("lesion_start_x"), (start + 160 + F.col("s_nationkey")).alias("lesion_end_x"), (start + 300).alias("end_x"), F.lit(10).alias("buffer"))


def region_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_centres(_bounds(spark, sf_dir), ["s_suppkey"], 7, 6)


LAYOUT_SQL = """WITH b AS (SELECT s_suppkey, s_suppkey % 50 AS s, s_suppkey % 50 + 60 AS l, s_suppkey % 50 + 160 + s_nationkey AS r, s_suppkey % 50 + 300 AS e FROM supplier),
i AS (SELECT * FROM b, range(0, 6) t(i))
SELECT s_suppkey, 'sound' AS kind, CAST(i AS INTEGER) AS "index", CAST(trunc(s + (l - 10 - s) / CAST(4 AS DOUBLE) * (i + 1)) AS INTEGER) AS centre FROM i WHERE i < 3
UNION ALL SELECT s_suppkey, 'sound', CAST(i + 3 AS INTEGER), CAST(trunc(r + 10 + (e - r - 10) / CAST(4 AS DOUBLE) * (i + 1)) AS INTEGER) FROM i WHERE i < 3
UNION ALL SELECT s_suppkey, 'lesion', CAST(i AS INTEGER), CAST(trunc(l + 10 + (r - l - 20) / CAST(7 AS DOUBLE) * (i + 1)) AS INTEGER) FROM i"""


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pixels: a slice for each order's last digits, regions by line number and flag."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 200).cast("int").alias("slice"), F.when(F.col("l_returnflag") == "R", "lesion").otherwise("sound").alias("kind"), (F.col("l_linenumber") % 3).cast("int").alias("index"), F.col("l_quantity").alias("v"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice"))


REGIONS = "px AS (SELECT CAST(l_orderkey % 200 AS INTEGER) AS slice, CASE WHEN l_returnflag = 'R' THEN 'lesion' ELSE 'sound' END AS kind, CAST(l_linenumber % 3 AS INTEGER) AS i, l_quantity AS v, * FROM lineitem)"


def region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = region_statistics(_regions(spark, sf_dir), ["slice"])
    return found.select("slice", "kind", "index", "n", *[r6(c).alias(c) for c in ("mean", "median", "sd", "se")])


STATS_SQL = f"""WITH {REGIONS} SELECT slice, kind, i AS "index", count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS sd, round(stddev_pop(v) / sqrt(count(*)), 6) AS se FROM px GROUP BY slice, kind, i"""


def region_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = region_statistics(_regions(spark, sf_dir), ["slice"]).withColumn("k", F.lit(1))
    depth = stats.where("kind = 'lesion'").groupBy("k", "slice").agg(F.avg("mean").alias("mean")).where("slice % 5 > 0")
    cavity = stats.groupBy("k", "slice").agg((F.max("sd") > 14.7).alias("cavitated")).where("slice % 7 > 0")
    found = results.summary(stats, depth, cavity, ["k"], 3, 3)
    return found.select(F.col("SLICE").alias("slice_no"), *[c for c in found.columns if c.endswith("MEDIAN")], r6("LESION_DEPTH_MEAN").alias("LESION_DEPTH_MEAN"), "IS_CAVITATED")


SUMMARY_SQL = f"""WITH {REGIONS}, s AS (SELECT slice, kind, i, median(v) AS median, avg(v) AS mean, stddev_pop(v) AS sd FROM px GROUP BY slice, kind, i)
SELECT slice + 1 AS slice_no, {", ".join(f"max(median) FILTER (kind = '{k}' AND i = {i}) AS {k.upper()}_{i + 1}_MEDIAN" for k in ("sound", "lesion") for i in range(3))},
round(coalesce(CASE WHEN slice % 5 > 0 THEN avg(mean) FILTER (kind = 'lesion') END, 0.0), 6) AS LESION_DEPTH_MEAN,
CASE WHEN slice % 7 = 0 THEN '' WHEN max(sd) > 14.7 THEN 'TRUE' ELSE 'FALSE' END AS IS_CAVITATED FROM s GROUP BY slice"""


def turned_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each seventh event of a user as a region's centre, turned with the curve of the user's values; some lie off it."""
    curve = _events(spark, sf_dir).where("x % 11 > 0").select("user_id", "x", F.col("value").alias("y"))
    centres = _events(spark, sf_dir).where("x % 7 = 0").select("user_id", F.lit("sound").alias("kind"), F.floor(F.col("x") / 7).alias("index"), F.col("x").alias("centre"))
    return turned_centres(centres, curve, ["user_id"]).select("user_id", "kind", "index", "centre", r6("y").alias("y"), r6("angle").alias("angle"))


TURNED_SQL = f"""WITH {ORDERED}, c AS (SELECT user_id, x, value AS y FROM ev WHERE x % 11 > 0), b AS (SELECT user_id, min(x) AS low, max(x) AS high FROM c GROUP BY user_id),
r AS (SELECT m.user_id, m.x, m.y, greatest(low, m.x - 10) AS l, least(high, m.x + 10) AS h FROM c m JOIN b USING (user_id) WHERE m.x % 7 = 0)
SELECT r.user_id, 'sound' AS kind, CAST(r.x // 7 AS BIGINT) AS "index", r.x AS centre, round(r.y, 6) AS y, round(coalesce(atan((coalesce(q.y, r.y) - coalesce(p.y, r.y)) / nullif(h - l, 0)), 0.0), 6) AS angle
FROM r LEFT JOIN c p ON p.user_id = r.user_id AND p.x = l LEFT JOIN c q ON q.user_id = r.user_id AND q.x = h"""


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as scans of bytes: a picture for each label, a column for each vector."""
    x = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    level = F.transform("embedding", lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 200 * e.cast("double")))).cast("int"))
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", x.alias("x"), level.alias("profile"))


SCANS = """s AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS x, embedding FROM embeddings),
px AS (SELECT label, vec_id, x, unnest(range(0, len(embedding))) AS y, CAST(greatest(0, least(255, floor(128 + 200 * CAST(unnest(embedding) AS DOUBLE)))) AS INTEGER) AS v FROM s)"""


def region_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of eight by eight below a surface that rises and falls from scan to scan, at every fifth scan."""
    scans = _scans(spark, sf_dir)
    curve = scans.select("label", "x", (5 + F.col("vec_id") % 13).cast("double").alias("y"))
    centres = scans.where("x % 5 = 0").select("label", F.lit("sound").alias("kind"), F.floor(F.col("x") / 5).alias("index"), F.col("x").alias("centre"))
    return geometry.region_pixels(centres, curve, scans, ["label"], size=8, offset=3)


REGION_SQL = f"""WITH {SCANS}, c AS (SELECT label, x, CAST(5 + vec_id % 13 AS DOUBLE) AS y FROM s), b AS (SELECT label, max(x) AS high FROM c GROUP BY label),
r AS (SELECT c.*, greatest(0, c.x - 10) AS l, least(high, c.x + 10) AS h FROM c JOIN b USING (label) WHERE c.x % 5 = 0),
t AS (SELECT r.*, coalesce(atan((q.y - p.y) / nullif(h - l, 0)), 0.0) AS angle FROM r JOIN c p ON p.label = r.label AND p.x = l JOIN c q ON q.label = r.label AND q.x = h),
g AS (SELECT *, pixel % 8 - 4 AS dx, pixel // 8 - 4 AS dy FROM (SELECT *, unnest(range(0, 64)) AS pixel FROM t)),
at_ AS (SELECT label, x // 5 AS i, pixel, CAST(round_even(x + dx * cos(angle) - dy * sin(angle), 0) AS INTEGER) AS px, CAST(round_even(y + 3 + 4 + dx * sin(angle) + dy * cos(angle), 0) AS INTEGER) AS py FROM g)
SELECT a.label, 'sound' AS kind, CAST(i AS BIGINT) AS "index", CAST(pixel AS INTEGER) AS pixel, v FROM at_ a JOIN px ON px.label = a.label AND px.x = a.px AND px.y = a.py"""


def counted_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds from counts of values; every second picture has an air rectangle."""
    corner = lambda n: F.when(F.col("label") % 2 == 0, F.lit(n))
    scans = _scans(spark, sf_dir).withColumns({"air_left": corner(3), "air_top": corner(5), "air_right": corner(30), "air_bottom": corner(31)})
    return air_threshold(value_counts(scans, ["label"]), ["label"], "v", "air", "n").select("label", r6("threshold").alias("threshold"))


COUNTED_SQL = f"""WITH {SCANS} SELECT label, round(coalesce(quantile_cont(v, 0.95) FILTER (label % 2 = 0 AND x BETWEEN 3 AND 29 AND y BETWEEN 5 AND 30) * 1.6, quantile_cont(v, 0.5)), 6) AS threshold FROM px GROUP BY label"""


def region_pixels_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixel = Window.partitionBy("slice", "kind", "index").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = _regions(spark, sf_dir).withColumn("pixel", F.row_number().over(pixel) - 1)
    return results.wide_pixels(rows, ["slice"], 3, 3)


WIDE_SQL = f"""WITH {REGIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY slice, kind, i ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pixel FROM px)
SELECT slice, CAST(pixel AS INTEGER) AS pixel, {", ".join(f"max(v) FILTER (kind = '{k}' AND i = {i}) AS {k}_{i + 1}" for k in ("sound", "lesion") for i in range(3))} FROM r GROUP BY slice, pixel"""


def surface_depth_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profiles(spark, sf_dir).select("label", F.col("vec_id").alias("x"), F.element_at("profile", 1).alias("a"), F.element_at("profile", 2).alias("b"))
    found = results.surface_and_depth(rows.withColumn("y", F.col("a")), rows.select("label", "x", F.when(F.col("x") % 2 == 0, "actual").otherwise("reference").alias("curve"), F.col("b").alias("y")), rows.where("a > b").withColumn("y", F.col("a") - F.col("b")), ["label"])
    return found.select("label", "type", "x", r6("y").alias("y"))


LONG_SQL = """WITH r AS (SELECT label, CAST(vec_id AS INTEGER) AS x, 128 + 200 * CAST(embedding[1] AS DOUBLE) AS a, 128 + 200 * CAST(embedding[2] AS DOUBLE) AS b FROM embeddings)
SELECT label, 'raw_surface' AS type, x, round(a, 6) AS y FROM r UNION ALL SELECT label, CASE WHEN x % 2 = 0 THEN 'curve_actual' ELSE 'curve_reference' END, x, round(b, 6) FROM r
UNION ALL SELECT label, 'lesion_depth', x, round(a - b, 6) FROM r WHERE a > b"""


def region_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.region_counts(region_statistics(_regions(spark, sf_dir), ["slice"]), ["slice"])


COUNTS_SQL = f"WITH {REGIONS} SELECT slice, kind, count(DISTINCT i) AS n FROM px GROUP BY slice, kind"


def polyline_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of a kind as the points of an annotation."""
    ev = _events(spark, sf_dir)
    lines = ev.groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("value").alias("y")))).alias("points"))
    return lines.select("user_id", "event_type", r6(polyline_length(F.col("points"))).alias("length"))


LENGTH_SQL = f"""WITH {ORDERED}, s AS (SELECT user_id, event_type, x - lag(x) OVER w AS dx, value - lag(value) OVER w AS dy FROM ev WINDOW w AS (PARTITION BY user_id, event_type ORDER BY x))
SELECT user_id, event_type, round(coalesce(sum(sqrt(dx * dx + dy * dy)), 0.0), 6) AS length FROM s GROUP BY user_id, event_type"""


def _volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as volumes of 4 by 8 by 8: four vectors a volume, a slice each."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") / 4).cast("int").alias("volume"), (F.col("vec_id") % 4).cast("int").alias("slice"), F.posexplode("embedding").alias("i", "v"))
    return rows.select("volume", "slice", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


VOLUME = "vol AS (SELECT CAST(vec_id // 4 AS INTEGER) AS volume, CAST(vec_id % 4 AS INTEGER) AS slice, i // 8 AS y, i % 8 AS x, v FROM (SELECT vec_id, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings))"


def reslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    volume = _volume(spark, sf_dir)
    found = [resliced(volume, d).groupBy("volume", "k").agg(F.sum(F.col("v") * (F.col("row") * 10 + F.col("col") + 1)).alias("s"), F.count("*").alias("n"), F.max("row").alias("rows"), F.max("col").alias("cols")).withColumn("direction", F.lit(d)) for d in ("XZ", "YZ", "XY")]
    return found[0].unionByName(found[1]).unionByName(found[2]).withColumn("s", F.round("s", 6))


RESLICE_SQL = f"WITH {VOLUME} " + " UNION ALL ".join(
    f"SELECT volume, {k} AS k, round(sum(v * ({row} * 10 + {col} + 1)), 6) AS s, count(*) AS n, max({row}) AS rows, max({col}) AS cols, '{d}' AS direction FROM vol GROUP BY volume, {k}"
    for d, k, row, col in (("XZ", "slice", "y", "x"), ("YZ", "x", "y", "slice"), ("XY", "y", "slice", "x"))
)


def nearest_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    picture = resliced(_volume(spark, sf_dir), "XZ")
    return zoomed(picture, ["volume", "k"], rows=1.33, cols=2.0).select("volume", "k", "row", "col", r6("v").alias("v"))


ZOOM_SQL = f"""WITH {VOLUME}, t AS (SELECT CAST(r AS INTEGER) AS row, CAST(floor(r * 7.0 / 10 + 0.5) AS INTEGER) AS y FROM range(0, 11) a(r)), u AS (SELECT CAST(c AS INTEGER) AS col, CAST(floor(c * 7.0 / 15 + 0.5) AS INTEGER) AS x FROM range(0, 16) b(c))
SELECT volume, slice AS k, row, col, round(v, 6) AS v FROM vol JOIN t USING (y) JOIN u USING (x)"""


def _stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same volumes as pictures of bytes, a slice a row."""
    level = lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 200 * e.cast("double")))).cast("int")
    pixels = F.unhex(F.array_join(F.transform("embedding", lambda e: F.lpad(F.hex(level(e)), 2, "0")), ""))
    rows = table(spark, sf_dir, "embeddings")
    return rows.select((F.col("vec_id") / 4).cast("int").cast("string").alias("volume_id"), (F.col("vec_id") % 4).cast("int").alias("slice"), F.lit(8).alias("height"), F.lit(8).alias("width"), pixels.alias("pixels"))


def _weighed(stack: DataFrame) -> DataFrame:
    """A number that changes with every pixel of a picture, and its size."""
    digits = F.sequence(F.lit(0), F.length("pixels") - 1)
    hexed = F.hex("pixels")
    weight = F.transform(digits, lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("long") * (F.floor(i / F.col("width")) * 100 + i % F.col("width") + 1))
    return stack.select(F.col("volume_id").cast("int").alias("volume"), F.col("slice").alias("k"), "height", "width", F.aggregate(weight, F.lit(0).cast("long"), lambda a, b: a + b).alias("s"))


def reslice_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes of bytes along all axes, and zoomed."""
    stack = _stack(spark, sf_dir)
    found = [_weighed(resliced_stack(stack, d, 256)).withColumn("direction", F.lit(d)) for d in ("XZ", "YZ", "XY")]
    return reduce(DataFrame.unionByName, [*found, _weighed(zoomed_stack(stack, 1.33, 2.0)).withColumn("direction", F.lit("zoomed"))])


_BYTE = "CAST(greatest(0, least(255, floor(128 + 200 * v))) AS BIGINT)"
RESLICE_STACK_SQL = f"WITH {VOLUME}, t AS (SELECT CAST(r AS INTEGER) AS row, CAST(floor(r * 7.0 / 10 + 0.5) AS INTEGER) AS y FROM range(0, 11) a(r)), u AS (SELECT CAST(c AS INTEGER) AS col, CAST(floor(c * 7.0 / 15 + 0.5) AS INTEGER) AS x FROM range(0, 16) b(c)) " + " UNION ALL ".join(
    f"SELECT volume, {k} AS k, CAST(max({row}) + 1 AS INTEGER) AS height, CAST(max({col}) + 1 AS INTEGER) AS width, CAST(sum({_BYTE} * ({row} * 100 + {col} + 1)) AS BIGINT) AS s, '{d}' AS direction FROM {source} GROUP BY volume, {k}"
    for d, k, row, col, source in (("XZ", "slice", "y", "x", "vol"), ("YZ", "x", "y", "slice", "vol"), ("XY", "y", "slice", "x", "vol"), ("zoomed", "slice", "row", "col", "vol JOIN t USING (y) JOIN u USING (x)"))
)


def _density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("user_id", F.col("event_id").alias("pid"), F.col("x").cast("double").alias("x"), F.col("value").alias("y"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of each user's events by order and value."""
    found = density_clusters(_density(spark, sf_dir), ["user_id"], 17.0, 10)
    return found.select("user_id", "pid", "cluster")


CLUSTER_SQL = f"""WITH RECURSIVE {ORDERED},
near AS MATERIALIZED (SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM ev a JOIN ev b ON a.user_id = b.user_id AND (a.x - b.x) * (a.x - b.x) + (a.value - b.value) * (a.value - b.value) <= 289),
core AS MATERIALIZED (SELECT a AS pid FROM near GROUP BY a HAVING count(*) >= 10),
link AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT pid FROM core) AND b IN (SELECT pid FROM core)),
reach AS (SELECT pid, pid AS root FROM core UNION SELECT l.b, r.root FROM reach r JOIN link l ON l.a = r.pid WHERE l.b > r.root),
name AS (SELECT pid, min(root) AS name FROM reach GROUP BY pid),
border AS (SELECT n.a AS pid, min(m.name) AS name FROM near n JOIN name m ON m.pid = n.b GROUP BY n.a)
SELECT e.user_id, e.event_id AS pid, coalesce(n.name, b.name) AS cluster FROM ev e LEFT JOIN name n ON n.pid = e.event_id LEFT JOIN border b ON b.pid = e.event_id"""


def cluster_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = large_clusters(density_clusters(_density(spark, sf_dir), ["user_id"], 17.0, 10), ["user_id"], 30)
    return found.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("clusters"))


POINTS_SQL = CLUSTER_SQL.replace("SELECT e.user_id, e.event_id AS pid", ", named AS (SELECT e.user_id, e.event_id AS pid", 1) + """),
sized AS (SELECT *, CASE WHEN cluster IS NOT NULL THEN count(cluster) OVER (PARTITION BY user_id, cluster) END AS n FROM named),
top AS (SELECT user_id, max(n) AS most, arg_max(cluster, n * 1000000000 - cluster) FILTER (cluster IS NOT NULL) AS first FROM sized GROUP BY user_id)
SELECT user_id, count(*) AS n, count(DISTINCT cluster) AS clusters FROM sized JOIN top USING (user_id) WHERE CASE WHEN most IS NULL THEN true WHEN most > 30 THEN n > 30 ELSE cluster = first END GROUP BY user_id"""

QUERIES = {
    "equidistant_trunc": equidistant_trunc, "equidistant_round": equidistant_round, "slices_loaded": slices_loaded, "keyframe_interpolation": keyframe_interpolation, "cavitation": cavitations,
    "region_layout": region_layout, "region_stats": region_stats, "region_summary": region_summary, "region_pixels_wide": region_pixels_wide, "surface_depth_long": surface_depth_long,
    "region_counts": region_counts, "polyline_length": polyline_lengths, "reslice": reslice, "nearest_zoom": nearest_zoom, "density_clusters": clusters, "cluster_points": cluster_points,
    "turned_regions": turned_regions, "region_pixels": region_pixels, "counted_thresholds": counted_thresholds, "reslice_stack": reslice_stack,
}
ORACLE_SQL = {
    "equidistant_trunc": TRUNC_SQL, "equidistant_round": ROUND_SQL, "slices_loaded": LOADED_SQL, "keyframe_interpolation": KEYFRAME_SQL, "cavitation": CAVITY_SQL, "region_layout": LAYOUT_SQL,
    "region_stats": STATS_SQL, "region_summary": SUMMARY_SQL, "region_pixels_wide": WIDE_SQL, "surface_depth_long": LONG_SQL, "region_counts": COUNTS_SQL, "polyline_length": LENGTH_SQL,
    "reslice": RESLICE_SQL, "nearest_zoom": ZOOM_SQL, "density_clusters": CLUSTER_SQL, "cluster_points": POINTS_SQL,
    "turned_regions": TURNED_SQL, "region_pixels": REGION_SQL, "counted_thresholds": COUNTED_SQL, "reslice_stack": RESLICE_STACK_SQL,
}
