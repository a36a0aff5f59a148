"""Queries that write documents and names from tables and read them back, and further measures of pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lamella.functions.profiles import exp2_curve, intensity_grey, sigmoid_curve
from lamella.operators import results
from lamella.operators.ascan import speckle_median_square
from lamella.operators.overlay import region_corners
from lamella.plans.common import r6, table
from lamella.plans.measurement_queries import _actions
from lamella.plans.volume_queries import VOLUME, _volume
from lamella.sources import files, sinks
from lamella.streaming.measurements import folded


def config_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as regions and air of a specimen, written as JSON and read back."""
    o = table(spark, sf_dir, "orders").withColumn("specimen_id", F.col("o_custkey").cast("string"))
    slice_ = F.col("o_orderkey").cast("int").alias("slice")
    point = lambda dx: F.struct((F.col("o_totalprice") / 100 + dx).cast("int").alias("x"), (F.col("o_orderkey") % 50).cast("int").alias("y"))
    regions = o.select("specimen_id", slice_, *[point(d).alias(n) for n, d in (("specimen_start", 0), ("lesion_start", 10), ("lesion_end", 20), ("specimen_end", 30))], (F.col("o_orderstatus") == "F").alias("is_keyframe"), (F.col("o_orderkey") % 7).cast("int").alias("buffer"))
    air = o.where("o_orderkey % 3 = 0").select("specimen_id", slice_, point(1).alias("point1"), F.when(F.col("o_orderstatus") == "O", point(2)).alias("point2"), F.lit(False).alias("is_keyframe"))
    documents = sinks.config_json(regions, air).withColumnRenamed("specimen_id", "path")
    r, a = files.config_regions(documents), files.config_air(documents)
    rows = r.join(a.select("path", "slice", F.col("point1.x").alias("air_x"), F.col("point2.x").alias("air_x2")), ["path", "slice"], "left")
    return rows.select("path", "slice", F.col("specimen_start.x").alias("start_x"), F.col("specimen_end.x").alias("end_x"), F.col("lesion_end.y").alias("y"), "is_keyframe", "buffer", "air_x", "air_x2")


CONFIG_SQL = """SELECT CAST(o_custkey AS VARCHAR) AS path, CAST(o_orderkey AS INTEGER) AS slice, CAST(trunc(o_totalprice / 100) AS INTEGER) AS start_x, CAST(trunc(o_totalprice / 100 + 30) AS INTEGER) AS end_x, CAST(o_orderkey % 50 AS INTEGER) AS y,
o_orderstatus = 'F' AS is_keyframe, CAST(o_orderkey % 7 AS INTEGER) AS buffer, CASE WHEN o_orderkey % 3 = 0 THEN CAST(trunc(o_totalprice / 100 + 1) AS INTEGER) END AS air_x,
CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'O' THEN CAST(trunc(o_totalprice / 100 + 2) AS INTEGER) END AS air_x2 FROM orders"""


def annotation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as annotations of a user's slices, written as JSON and read back."""
    e = table(spark, sf_dir, "events")
    notes = e.select(F.col("user_id").cast("string").alias("path"), (F.col("event_id") % 5).cast("int").alias("slice"), F.concat_ws("_", "event_type", "event_id").alias("id"), F.when(F.col("event_id") % 4 > 0, F.col("event_type")).alias("feature"),
        F.array(F.struct(F.col("value").alias("x"), F.col("event_id").cast("double").alias("y"))).alias("points"), F.lit(None).cast("string").alias("mode"), F.lit(None).cast("string").alias("color"), F.lit(None).cast("boolean").alias("locked"), F.col("ts").alias("timestamp"))
    back = files.slice_annotations(sinks.annotations_json(notes, ["path"]))
    return back.select("path", "slice", "id", "feature", "mode", "color", "locked", r6(F.get("points", F.lit(0))["x"]).alias("x"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


ANNOTATION_SQL = """SELECT CAST(user_id AS VARCHAR) AS path, CAST(event_id % 5 AS INTEGER) AS slice, event_type || '_' || event_id AS id, CASE WHEN event_id % 4 > 0 THEN event_type ELSE 'unknown' END AS feature, 'line' AS mode, '#FFFFFF' AS color, false AS locked,
round(value, 6) AS x, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events"""


def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 12).cast("int").alias("experiment"), F.col("p_name").alias("name"), F.col("p_size").alias("n_slices"), F.lit("XZ").alias("direction"), F.col("p_brand").alias("study"), F.lit(".tiff").alias("extension"), (F.col("p_partkey") % 900).cast("int").alias("export_index"), F.col("p_size").alias("slice"))
    return sinks.export_rows(p).select("p_partkey", "folder", "file", "description")


EXPORT_SQL = """SELECT p_partkey, lpad(CAST(p_partkey % 12 AS VARCHAR), 2, '0') || '_' || p_name || '_' || p_size || '_Slices_XZ' AS folder, p_name || '_' || p_partkey % 12 || '_#' || (p_size + 1) || '_' || lpad(CAST(p_partkey % 900 + 1 AS VARCHAR), 4, '0') || '.tiff' AS file,
'OCT Export - ' || p_brand AS description FROM part"""


def export_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as exports, their items as slices; returned ones failed."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("file_path"), (F.col("o_orderkey") % 9).alias("num_slices"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("file_path"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("slice "), F.col("l_linenumber").cast("string"))).alias("error"))
    return sinks.export_report(rows, o)


REPORT_SQL = """WITH d AS (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS n, min(CASE WHEN l_returnflag = 'R' THEN 'slice ' || l_linenumber END) AS error FROM lineitem GROUP BY l_orderkey)
SELECT CAST(o_orderkey AS VARCHAR) AS file_path, coalesce(n, 0) AS exported, greatest(o_orderkey % 9 - coalesce(n, 0), 0) AS failed, error FROM orders LEFT JOIN d ON l_orderkey = o_orderkey"""


def measurement_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each user and slice, a column for each kind of cell."""
    cells = folded(_actions(spark, sf_dir), ["user_id", "slice"], ["ts", "event_id"]).withColumn("column", F.col("data_type"))
    return results.wide_measurements(cells, ["user_id", "slice"], ["Continuous", "Boolean", "Percentage", "Categorical"])


TABLE_SQL = """SELECT user_id, event_id % 2 AS slice, CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'click') AS VARCHAR) AS Continuous,
CASE WHEN count(*) FILTER (event_type = 'view') = 0 THEN NULL WHEN count(*) FILTER (event_type = 'view') % 2 = 1 THEN 'YES' ELSE 'NO' END AS Boolean,
CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN least(count(*) FILTER (event_type = 'purchase') * 5, 100) || '%' END AS Percentage,
CASE WHEN count(*) FILTER (event_type = 'signup') > 0 THEN CAST(count(*) FILTER (event_type = 'signup') - 1 AS VARCHAR) END AS Categorical FROM events GROUP BY user_id, event_id % 2"""


def label_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' cells that are shown as labels; a nation has its own columns."""
    n = table(spark, sf_dir, "nation")
    kind = F.get(F.array(F.lit("Boolean"), F.lit("Continuous"), F.lit("Text")), F.col("n_nationkey") % 3)
    columns = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), kind.alias("data_type"), F.lit("#ffffff").alias("color"))
    cells = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.concat(F.lit("NATION_"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_nationkey")).otherwise(0).cast("string")).alias("column"), "s_suppkey")
    return results.labelled(cells, columns, ["k"])


LABEL_SQL = """SELECT s_nationkey AS k, n_name AS "column", s_suppkey, list_extract(['Boolean', 'Continuous', 'Text'], n_nationkey % 3 + 1) AS data_type, '#ffffff' AS color FROM supplier JOIN nation ON n_nationkey = s_nationkey AND (s_suppkey % 4 > 0 OR s_nationkey = 0) WHERE n_nationkey % 3 <> 1"""


def key_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey").cast("string")).alias("keybinding"))
    found = results.key_map(columns, ["k"])
    return found.select("k", F.explode("key_map").alias("key", "name"))


KEY_SQL = "SELECT s_nationkey AS k, CAST(s_suppkey AS VARCHAR) AS key, s_name AS name FROM supplier WHERE s_suppkey % 3 > 0"


def legacy_speckle(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _volume(spark, sf_dir).withColumn("v", 128 + 200 * F.col("v"))
    return speckle_median_square(pixels, ["volume", "slice"], 110.0).select("volume", "slice", "x", "y", r6("filtered").alias("filtered"))


LEGACY_SQL = f"""WITH {VOLUME}, p AS (SELECT volume, slice, x, y, 128 + 200 * v AS v FROM vol),
m AS (SELECT a.volume, a.slice, a.x, a.y, median(b.v) AS m FROM p a JOIN p b ON a.volume = b.volume AND a.slice = b.slice AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 WHERE a.v < 110 GROUP BY 1, 2, 3, 4)
SELECT volume, slice, x, y, round(coalesce(m, v), 6) AS filtered FROM p LEFT JOIN m USING (volume, slice, x, y)"""


def curve_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "part"), F.lit(20)
    low, high = (F.col("p_partkey") % 50).cast("double"), (F.col("p_partkey") % 50 + 100).cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return s.select("p_partkey", r6(total(sigmoid_curve(n, low, high, F.lit(0.3), F.col("p_size").cast("double")))).alias("sigmoid"), r6(total(exp2_curve(n, high, F.lit(-0.2), low, F.lit(-0.01)))).alias("exp2"))


CURVE_SQL = """SELECT p_partkey, round(sum(p_partkey % 50 + 100 / (1 + exp(0.3 * (z - p_size)))), 6) AS sigmoid, round(sum((p_partkey % 50 + 100) * exp(-0.2 * z) + p_partkey % 50 * exp(-0.01 * z)), 6) AS exp2
FROM part, range(0, 20) t(z) GROUP BY p_partkey"""


def stored_grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as stored intensities."""
    return table(spark, sf_dir, "orders").select("o_orderkey", intensity_grey(1100000000 + F.col("o_totalprice") * 50, 20, 80).alias("grey"))


STORED_SQL = "SELECT o_orderkey, CAST(trunc(255 * (least(greatest(1100000000 + o_totalprice * 50, 1105000000.0), 1119000000.0) - 1105000000) / 14000000) AS INTEGER) AS grey FROM orders"


def region_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of regions on a curve of suppliers' balances; a nation is a slice."""
    curve = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("slice"), (F.col("s_suppkey") % 37).alias("x"), F.floor(F.col("s_acctbal") / 100).alias("y")).groupBy("slice", "x").agg(F.max("y").alias("y"))
    centres = curve.select("slice", F.lit("sound").alias("kind"), F.lit(0).alias("index"), F.col("x").alias("centre"))
    found = region_corners(centres, curve, ["slice"])
    return found.select("slice", "centre", r6("middle").alias("middle"), r6(F.get("corners", F.lit(0))["x"]).alias("x0"), r6(F.get("corners", F.lit(2))["y"]).alias("y2"))


OUTLINE_SQL = """WITH c AS (SELECT s_nationkey AS slice, s_suppkey % 37 AS x, max(floor(s_acctbal / 100)) AS y FROM supplier GROUP BY 1, 2),
e AS (SELECT slice, min(x) AS low, max(x) AS high FROM c GROUP BY slice),
a AS (SELECT c.slice, c.x, c.y, coalesce(atan((coalesce(r.y, c.y) - coalesce(l.y, c.y)) / nullif(least(high, c.x + 10) - greatest(low, c.x - 10), 0)), 0) AS t FROM c JOIN e ON e.slice = c.slice LEFT JOIN c l ON l.slice = c.slice AND l.x = greatest(low, c.x - 10) LEFT JOIN c r ON r.slice = c.slice AND r.x = least(high, c.x + 10))
SELECT slice, x AS centre, round(y + 22.0, 6) AS middle, round(x - 12 * cos(t) + 12 * sin(t), 6) AS x0, round(y + 22 + 12 * sin(t) + 12 * cos(t), 6) AS y2 FROM a"""

_HERE = {
    "config_documents": (config_documents, CONFIG_SQL), "annotation_documents": (annotation_documents, ANNOTATION_SQL), "export_names": (export_names, EXPORT_SQL), "export_reports": (export_reports, REPORT_SQL),
    "measurement_table": (measurement_table, TABLE_SQL), "label_cells": (label_cells, LABEL_SQL), "key_maps": (key_maps, KEY_SQL), "legacy_speckle": (legacy_speckle, LEGACY_SQL),
    "curve_models": (curve_models, CURVE_SQL), "stored_grey": (stored_grey, STORED_SQL), "region_outlines": (region_outlines, OUTLINE_SQL),
}
QUERIES = {k: v[0] for k, v in _HERE.items()}
ORACLE_SQL = {k: v[1] for k, v in _HERE.items()}
