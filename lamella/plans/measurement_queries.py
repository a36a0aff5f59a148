"""Queries on export queues, settings, files, measured cells and their logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lamella.functions import cells, rules
from lamella.operators import queue, results
from lamella.operators.series import placed
from lamella.plans.common import r6, table
from lamella.sources.files import sidecar_settings, stacks_of
from lamella.streaming.measurements import folded, progress, restored, save_points, surviving, undone_from


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as queue items, with all kinds of mistakes among them."""
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", (k % 30).cast("int").alias("first_slice"), size.alias("last_slice"), (k % 41).cast("int").alias("num_slices"), (k % 60).cast("int").alias("db_min"), (size + 40).alias("db_max"),
        F.get(F.array(F.lit("XZ"), F.lit("YZ"), F.lit("XY"), F.lit("ZZ"), F.lit(None)), (k % 5).cast("int")).alias("slice_direction"), ((k % 56).cast("double") / 10).alias("refractive_index"),
        F.when(k % 11 > 0, F.col("p_name")).otherwise(F.lit("")).alias("file_path"),
    )


ITEMS = """q AS (SELECT p_partkey, CAST(p_partkey % 30 AS INTEGER) AS f, p_size AS l, CAST(p_partkey % 41 AS INTEGER) AS n, CAST(p_partkey % 60 AS INTEGER) AS lo, p_size + 40 AS hi,
  list_extract(['XZ', 'YZ', 'XY', 'ZZ', NULL], p_partkey % 5 + 1) AS d, (p_partkey % 56) / CAST(10 AS DOUBLE) AS ri, CASE WHEN p_partkey % 11 > 0 THEN p_name ELSE '' END AS path FROM part)"""
DB_RANGE = "CASE WHEN lo >= hi THEN 'db_min (' || lo || ') must be less than db_max (' || hi || ')' END"
ORDER = "CASE WHEN f > l THEN 'first_slice (' || f || ') must be <= last_slice (' || l || ')' END"
INDEX = "CASE WHEN ri < 0.1 OR ri > 5.0 THEN 'refractive_index (' || ri || ') must be between 0.1 and 5.0' END"


def _flat(df: DataFrame, name: str) -> DataFrame:
    return df.select("p_partkey", F.col(f"{name}.is_valid").alias("is_valid"), F.array_join(f"{name}.errors", " | ").alias("errors"), F.array_join(f"{name}.warnings", " | ").alias("warnings"))


def _flat_sql(source: str, errors: list[str], warnings: list[str]) -> str:
    joined = lambda parts: f"concat_ws(' | ', {', '.join(parts)})" if parts else "''"
    return f"SELECT p_partkey, {joined(errors)} = '' AS is_valid, {joined(errors)} AS errors, {joined(warnings)} AS warnings FROM {source}"


def validate_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _items(spark, sf_dir)
    c = [F.col(x) for x in ("first_slice", "last_slice", "num_slices", "db_min", "db_max", "slice_direction", "refractive_index", "file_path")]
    return _flat(q.withColumn("v", rules.queue_item(*c)), "v")


QUEUE_SQL = f"WITH {ITEMS} " + _flat_sql("q", [ORDER, DB_RANGE, "CASE WHEN n > l - f + 1 THEN 'num_slices (' || n || ') exceeds available range (' || (l - f + 1) || ')' END",
    "CASE WHEN d IS NULL OR d NOT IN ('XZ', 'YZ', 'XY') THEN 'Invalid slice_direction: ' || coalesce(d, 'None') END", INDEX, "CASE WHEN path = '' THEN 'file_path cannot be empty' END"], ["CASE WHEN n = 1 THEN 'Only 1 slice will be exported' END"])


def validate_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slice ranges against totals, decibel windows, and equidistant counts, one below the other."""
    q = _items(spark, sf_dir)
    found = [rules.slice_range(F.col("first_slice"), F.col("last_slice"), F.lit(35)), rules.db_limits(F.col("db_min"), F.col("db_max")), rules.equidistant(F.col("num_slices"), F.col("first_slice"), F.col("last_slice"))]
    flat = [_flat(q.withColumn("v", v), "v").withColumn("rule", F.lit(n)) for n, v in zip(("range", "db", "equidistant"), found, strict=True)]
    return flat[0].unionByName(flat[1]).unionByName(flat[2])


RANGES_SQL = f"WITH {ITEMS} SELECT *, 'range' AS rule FROM (" + _flat_sql("q", ["CASE WHEN f < 1 THEN 'first_slice (' || f || ') must be >= 1' END", "CASE WHEN l < 1 THEN 'last_slice (' || l || ') must be >= 1' END", ORDER,
    "CASE WHEN l > 35 THEN 'last_slice (' || l || ') exceeds total_slices (35)' END", "CASE WHEN f > 35 THEN 'first_slice (' || f || ') exceeds total_slices (35)' END"], []) + ") UNION ALL SELECT *, 'db' AS rule FROM (" + _flat_sql("q", [
    "CASE WHEN lo > 50 THEN 'db_min (' || lo || ') must be between 0 and 50' END", "CASE WHEN hi < 50 OR hi > 120 THEN 'db_max (' || hi || ') must be between 50 and 120' END", DB_RANGE],
    ["CASE WHEN hi - lo < 20 THEN 'Narrow dynamic range may result in low contrast images' END", "CASE WHEN hi - lo > 80 THEN 'Wide dynamic range may result in washed out images' END"]) + ") UNION ALL SELECT *, 'equidistant' AS rule FROM (" + _flat_sql("q", [
    "CASE WHEN n <= 0 THEN 'num_slices must be positive' END", "CASE WHEN n > 0 AND n > l - f + 1 THEN 'The input value for ''NumSlices'' [' || n || '] is larger than the chosen export range [' || (l - f + 1) || ']! Please consider adapting the export range (First & Last) or the number of slices!' END"], []) + ")"


def validate_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings with their defaults where the part has none."""
    k = F.col("p_partkey")
    q = _items(spark, sf_dir)
    given = {"db_min": F.col("db_min"), "db_max": F.col("db_max"), "scale_length_um": F.when(k % 6 == 0, F.lit(0)).when(k % 6 == 1, F.lit(300)), "scale_enabled": k % 4 > 0, "refractive_index": F.col("refractive_index"),
             "dispersion_type": F.when(k % 3 == 0, F.lit("None")), "dispersion_coefficient": F.when(k % 9 < 4, (k % 250 - 120).cast("int")), "advanced_filter": k % 5 == 0, "averaging": F.when(k % 2 == 0, F.lit("none"))}
    c: dict[str, Column] = rules.with_defaults(given) | {"first_slice": F.col("first_slice"), "last_slice": F.col("last_slice")}
    return _flat(q.withColumn("v", rules.settings(c)), "v")


SETTINGS_SQL = f"""WITH {ITEMS}, s AS (SELECT *, CASE WHEN p_partkey % 6 = 0 THEN 0 WHEN p_partkey % 6 = 1 THEN 300 ELSE 500 END AS sl, CASE WHEN p_partkey % 3 = 0 THEN 'None' ELSE 'Quadratic' END AS dt,
CASE WHEN p_partkey % 9 < 4 THEN p_partkey % 250 - 120 ELSE -100 END AS dc, CASE WHEN p_partkey % 2 = 0 THEN 'none' ELSE 'coherent' END AS av FROM q) """ + _flat_sql("s", [DB_RANGE, ORDER,
    "CASE WHEN p_partkey % 4 > 0 AND sl <= 0 THEN 'scale_length_um must be positive when scale is enabled' END",
    "CASE WHEN dt = 'Quadratic' AND (dc < -100 OR dc > 100) THEN 'dispersion_coefficient (' || dc || ') must be between -100 and 100' END", INDEX],
    ["CASE WHEN p_partkey % 5 = 0 AND av = 'none' THEN 'Advanced filter may not be effective without averaging' END", "CASE WHEN dt = 'None' AND dc <> 0 THEN 'Dispersion coefficient is ignored when dispersion type is ''None''' END"])


def batch_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _items(spark, sf_dir).groupBy((F.col("p_partkey") % 10).alias("g")).agg(rules.batch_update(F.col("file_path")).alias("v"))
    return found.select("g", F.array_join("v.warnings", " | ").alias("warnings"))


BATCH_SQL = f"WITH {ITEMS} SELECT p_partkey % 10 AS g, CASE WHEN count(*) FILTER (path = '') > 0 THEN count(*) FILTER (path = '') || ' item(s) have no valid path' ELSE '' END AS warnings FROM q GROUP BY 1"


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.row_number().over(w) - 1).cast("int").alias("position"))


def queue_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each brand's queue: the second row moved to the fifth place, then the first and fourth removed, then one put in third."""
    q = queue.removed(queue.reordered(_queue(spark, sf_dir), ["p_brand"], 1, 4), ["p_brand"], [0, 3, -1])  # no queue of any length has a place -1
    new = q.groupBy("p_brand").agg((-F.max("p_partkey")).alias("p_partkey"))
    return queue.added(q, new, ["p_brand"], 2)


EDITS_SQL = """WITH a AS (SELECT p_brand, p_partkey, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY p_brand) AS n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
b AS (SELECT p_brand, p_partkey, CASE WHEN n < 5 THEN p WHEN p = 1 THEN 4 WHEN p > 1 AND p <= 4 THEN p - 1 ELSE p END AS p FROM a),
c AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p) - 1 AS p, count(*) OVER (PARTITION BY p_brand) AS n FROM b WHERE p NOT IN (0, 3)),
d AS (SELECT p_brand, max(n) AS n, -max(p_partkey) AS p_partkey FROM c GROUP BY p_brand)
SELECT p_brand, p_partkey, CAST(CASE WHEN p >= 2 THEN p + 1 ELSE p END AS INTEGER) AS position FROM c UNION ALL SELECT p_brand, p_partkey, CAST(least(2, n) AS INTEGER) FROM d"""


def queue_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as archives; every third has a sidecar, some with two views."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    kind = F.get(F.array(F.lit("Processed"), F.lit("RawSpectra"), F.lit("RawSpectraAndProcessedIntensity"), F.lit("Other")), (k % 4).cast("int"))
    headers = s.select(F.col("s_name").alias("file_path"), kind.alias("data_type"), F.when(k % 5 == 0, F.lit("M00427924")).otherwise(F.lit("X")).alias("serial"), F.lit(512).alias("dim_x"), (F.col("s_nationkey") + 1).alias("dim_y"), F.lit(512).alias("dim_z"))
    view = F.explode(F.when(k % 6 == 0, F.array(F.lit("XZ"), F.lit("YZ"))).otherwise(F.array(F.lit("XY"))))
    sidecars = s.where(k % 3 == 0).select(F.col("s_name").alias("file_path"), view.alias("view"), F.lit(2).alias("start"), F.lit(9).alias("end"), F.lit(4).alias("n"), F.lit(1.33).alias("index"))
    items = queue.queue_items(headers, sidecars)
    return queue.with_status(items, "Ready", F.col("num_slices") > 3)


DEFAULTS_SQL = """WITH v AS (SELECT s_suppkey, unnest(CASE WHEN s_suppkey % 3 > 0 THEN [NULL] WHEN s_suppkey % 6 = 0 THEN ['XZ', 'YZ'] ELSE ['XY'] END) AS view FROM supplier),
t AS (SELECT s.*, v.view, list_extract(['Processed', 'RawSpectra', 'RawSpectraAndProcessedIntensity', 'Other'], s.s_suppkey % 4 + 1) AS kind FROM supplier s JOIN v USING (s_suppkey))
SELECT s_name AS file_path, coalesce(view, 'XZ') AS slice_direction, CASE WHEN view IS NULL THEN 1 ELSE 2 END AS first_slice, CASE WHEN view IS NULL THEN s_nationkey + 1 ELSE 9 END AS last_slice,
CASE WHEN view IS NULL THEN s_nationkey + 1 ELSE 4 END AS num_slices, CAST(CASE WHEN view IS NULL THEN 1.0 ELSE 1.33 END AS DOUBLE) AS refractive_index, CASE WHEN kind = 'Processed' THEN 20 ELSE 30 END AS db_min,
CASE WHEN kind = 'Processed' THEN 80 ELSE 100 END AS db_max, CASE WHEN s_suppkey % 5 = 0 THEN -100 ELSE 20 END AS dispersion_coefficient, kind AS data_type,
CASE WHEN CASE WHEN view IS NULL THEN s_nationkey + 1 ELSE 4 END > 3 THEN 'Ready' ELSE 'Pending' END AS status FROM t"""


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _items(spark, sf_dir).select("p_partkey", "file_path", "first_slice", "last_slice", "num_slices", "slice_direction")
    headers = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("file_path")).agg(F.max("p_size").alias("dim_x"), F.min("p_size").alias("dim_y"), F.count("*").cast("int").alias("dim_z"))
    return queue.with_direction(q, headers, "YZ")


DIRECTIONS_SQL = f"""WITH {ITEMS}, h AS (SELECT p_name AS path, max(p_size) AS x FROM part GROUP BY p_name)
SELECT p_partkey, path AS file_path, f AS first_slice, CASE WHEN path <> '' THEN x ELSE l END AS last_slice, CASE WHEN path <> '' THEN x - f + 1 ELSE n END AS num_slices, CASE WHEN path <> '' THEN 'YZ' ELSE d END AS slice_direction FROM q LEFT JOIN h USING (path)"""


def scale_and_dpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    mm = F.when(k % 7 > 0, size / 8)
    bar = rules.scale_bar(F.lit(500), F.lit(640), F.lit(480), F.when(k % 2 == 0, F.lit("XZ")).otherwise(F.lit("YZ")), size / 4, size / 5)
    return table(spark, sf_dir, "part").select(
        "p_partkey", rules.dpi(F.lit(512), mm).alias("dpi"), bar["length"].alias("bar"), bar["x"].alias("bar_x"), rules.percent(k % 10, F.lit(0) + k % 3).alias("pct"),
        rules.dispersion_of_wavelength(size * 60).alias("dispersion"), rules.clamped(size, F.lit(1), F.lit(30)).alias("next"), rules.middle(size).alias("middle"), rules.slice_count(F.lit(3), size).alias("count"),
        rules.data_type_to_read(F.get(F.array(F.lit("RawSpectra"), F.lit("RawSpectraAndProcessedIntensity"), F.lit("Processed")), (k % 3).cast("int")), k % 2 == 0).alias("read"),
    ).withColumn("pct", r6("pct"))


SCALE_SQL = """SELECT p_partkey, CAST(CASE WHEN p_partkey % 7 > 0 THEN round_even(512 / (p_size / 8.0::DOUBLE), 0) ELSE 72 END AS INTEGER) AS dpi,
CAST(round_even(500 / (CASE WHEN p_partkey % 2 = 0 THEN p_size / 4.0::DOUBLE ELSE p_size / 5.0::DOUBLE END * 1000 / 640), 0) AS INTEGER) AS bar,
CAST(640 - round_even(500 / (CASE WHEN p_partkey % 2 = 0 THEN p_size / 4.0::DOUBLE ELSE p_size / 5.0::DOUBLE END * 1000 / 640), 0) - 90 AS INTEGER) AS bar_x,
round(CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 10) / CAST(p_partkey % 3 AS DOUBLE) * 100 ELSE 0.0 END, 6) AS pct,
CASE WHEN p_size * 60 >= 1400 THEN -100 WHEN p_size * 60 >= 1200 THEN 20 ELSE 0 END AS dispersion, greatest(0, least(p_size + 1, 29)) AS "next", CAST(p_size // 2 AS INTEGER) AS middle, p_size - 2 AS "count",
CASE WHEN p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND p_partkey % 2 = 0) THEN 'Raw' ELSE 'Processed' END AS read FROM part"""


def color_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    colour = F.when(k % 9 > 0, cells.hex_of(k % 256, (k * 7) % 256, (k * 13) % 256)).otherwise(F.lit("bad"))
    return table(spark, sf_dir, "part").select("p_partkey", colour.alias("hex"), F.get(cells.rgb(colour), F.lit(1)).alias("green"), r6(cells.luminance(colour)).alias("luminance"), cells.font_colour(colour).alias("font"), cells.column_width(F.col("p_name")).alias("width"))


COLOR_SQL = """WITH c AS (SELECT p_partkey, p_name, p_partkey % 9 > 0 AS ok, CASE WHEN p_partkey % 9 > 0 THEN p_partkey % 256 ELSE 255 END AS r, CASE WHEN p_partkey % 9 > 0 THEN p_partkey * 7 % 256 ELSE 255 END AS g,
CASE WHEN p_partkey % 9 > 0 THEN p_partkey * 13 % 256 ELSE 178 END AS b FROM part),
l AS (SELECT *, 0.2126 * CASE WHEN r / 255.0::DOUBLE <= 0.03928 THEN r / 255.0::DOUBLE / 12.92 ELSE pow((r / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END
 + 0.7152 * CASE WHEN g / 255.0::DOUBLE <= 0.03928 THEN g / 255.0::DOUBLE / 12.92 ELSE pow((g / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END
 + 0.0722 * CASE WHEN b / 255.0::DOUBLE <= 0.03928 THEN b / 255.0::DOUBLE / 12.92 ELSE pow((b / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS lum FROM c)
SELECT p_partkey, CASE WHEN ok THEN printf('#%02x%02x%02x', r, g, b) ELSE 'bad' END AS hex, CAST(g AS INTEGER) AS green, round(lum, 6) AS luminance, CASE WHEN lum < 0.5 THEN 'white' ELSE 'black' END AS font, CAST(least(greatest(40, length(p_name) * 7 + 20), 250) AS INTEGER) AS width FROM l"""


def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a host in the natural order of their addresses."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))
    order = [cells.natural_key(F.col("url")), "page_id"]
    return placed(pages, ["host"], order).select("page_id", "host", (F.col("place") + 1).cast("int").alias("place"))


NATURAL_SQL = """WITH p AS (SELECT page_id, url, split_part(url, '/', 3) AS host, list_transform(regexp_extract_all(lower(url), '([0-9]+|[^0-9]+)'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(regexp_replace(x, '^0+(.)', '\\1'), 20, '0') ELSE x END) AS k FROM pages)
SELECT page_id, host, CAST(row_number() OVER (PARTITION BY host ORDER BY array_to_string(k, ''), page_id) AS INTEGER) AS place FROM p"""


def file_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: every fourth has another ending, some are missing, empty or small."""
    k = F.col("doc_id")
    path = F.concat(F.lit("/"), "source", F.lit("/"), k.cast("string"), F.when(k % 4 == 0, F.lit(".txt")).otherwise(F.lit(".oct")))
    length = F.when(k % 13 == 0, F.lit(None)).when(k % 7 == 0, F.lit(0)).otherwise(F.col("n_chars"))
    found = table(spark, sf_dir, "documents").select("doc_id", rules.file_check(path, length.cast("long"), k % 17 > 0).alias("v"))
    return found.select("doc_id", "v.is_valid", F.array_join("v.errors", " | ").alias("errors"), F.array_join("v.warnings", " | ").alias("warnings"))


DISCOVERY_SQL = """WITH f AS (SELECT doc_id, '/' || source || '/' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '.txt' ELSE '.oct' END AS path, doc_id || CASE WHEN doc_id % 4 = 0 THEN '.txt' ELSE '.oct' END AS name,
CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars END AS n FROM documents),
e AS (SELECT doc_id, n, CASE WHEN n IS NULL THEN 'File does not exist: ' || path WHEN doc_id % 17 = 0 THEN 'Path is not a file: ' || path WHEN doc_id % 4 = 0 THEN 'File does not have .oct extension: ' || name WHEN n = 0 THEN 'File is empty' ELSE '' END AS errors FROM f)
SELECT doc_id, errors = '' AS is_valid, errors, CASE WHEN errors = '' AND n < 1000 THEN 'File is very small, may be corrupted' ELSE '' END AS warnings FROM e"""


def sidecar_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' export files of up to three lines, some of them bad."""
    k = F.col("s_suppkey").cast("string")
    first = F.concat(F.lit("10-"), (F.col("s_nationkey") + 12).cast("string"))
    lines = {0: F.when(F.col("s_suppkey") % 2 == 0, F.lit("# note")).otherwise(first), 1: F.concat(F.lit("yz:20-80:"), F.col("s_nationkey").cast("string")), 2: F.when(F.col("s_suppkey") % 5 == 0, F.lit("1:2:3:4:5:6")).when(F.col("s_suppkey") % 5 == 1, F.lit("5-9:1.33")).otherwise(F.lit("  "))}
    rows = table(spark, sf_dir, "supplier").select(k.alias("file_path"), F.posexplode(F.array(*lines.values())).alias("line", "text"))
    return sidecar_settings(rows)


SIDECAR_SQL = """WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS file_path, s_suppkey AS k, s_nationkey AS n FROM supplier),
bad AS (SELECT file_path, CASE WHEN k % 5 = 0 AND n = 0 THEN least('1:2:3:4:5:6', 'yz:20-80:0') WHEN k % 5 = 0 THEN '1:2:3:4:5:6' WHEN n = 0 THEN 'yz:20-80:0' END AS t FROM s)
SELECT file_path, NULL AS view, CAST(NULL AS INTEGER) AS start, CAST(NULL AS INTEGER) AS "end", CAST(NULL AS INTEGER) AS n, CAST(NULL AS DOUBLE) AS "index", 'Unrecognized format in line: ' || t AS error FROM bad WHERE t IS NOT NULL
UNION ALL SELECT file_path, 'YZ', 20, 80, n, 1.0, NULL FROM s WHERE k % 5 > 0 AND n > 0
UNION ALL SELECT file_path, 'XZ', CASE WHEN k % 5 = 1 THEN 5 ELSE 10 END, CASE WHEN k % 5 = 1 THEN 9 ELSE n + 12 END, CASE WHEN k % 5 = 1 THEN 5 ELSE n + 3 END, CASE WHEN k % 5 = 1 THEN 1.33 ELSE 1.0 END, NULL FROM s WHERE k % 5 > 0 AND n > 0 AND (k % 5 = 1 OR k % 2 = 1)"""


def image_stack_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pictures in folders of their source and language; German ones lie under a folder for annotations."""
    folder = F.when(F.col("lang") == "de", F.lit("/Annotations")).otherwise(F.lit(""))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("/root/"), "source", folder, F.lit("/"), "lang", F.lit("/slice_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 6 == 0, ".txt").otherwise(".PNG")).alias("path"))
    return stacks_of(files).select("specimen_id", "folder", "path", "slice", "duplicate")


STACK_SQL = """WITH f AS (SELECT lang AS specimen_id, '/root/' || source || '/' || lang AS folder, '/root/' || source || '/' || lang || '/slice_' || doc_id || '.PNG' AS path, doc_id, source FROM documents WHERE lang <> 'de' AND doc_id % 6 > 0)
SELECT specimen_id, folder, path, CAST(row_number() OVER (PARTITION BY folder ORDER BY doc_id) - 1 AS INTEGER) AS slice, (SELECT count(DISTINCT g.folder) > 1 FROM f g WHERE g.specimen_id = f.specimen_id) AS duplicate FROM f"""

#: Kinds of events as data types of cells.
TYPES = {"click": "Continuous", "view": "Boolean", "purchase": "Percentage", "signup": "Categorical", "error": "Text"}


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in TYPES.items()])
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_id") % 2).alias("slice"), kind.alias("data_type"), F.col("value").alias("measured"), F.col("props").alias("entered"))


def measurement_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(_actions(spark, sf_dir), ["user_id", "slice"], ["ts", "event_id"])


FOLD_SQL = """SELECT user_id, event_id % 2 AS slice, CASE event_type WHEN 'click' THEN 'Continuous' WHEN 'view' THEN 'Boolean' WHEN 'purchase' THEN 'Percentage' WHEN 'signup' THEN 'Categorical' ELSE 'Text' END AS data_type,
CASE event_type WHEN 'click' THEN CAST(sum(CAST(value AS DECIMAL(18,2))) AS VARCHAR) WHEN 'view' THEN CASE WHEN count(*) % 2 = 1 THEN 'YES' ELSE 'NO' END WHEN 'purchase' THEN least(count(*) * 5, 100) || '%' WHEN 'signup' THEN CAST(count(*) - 1 AS VARCHAR) ELSE arg_max(props, (ts, event_id)) END AS value,
count(*) AS n FROM events GROUP BY user_id, event_id % 2, event_type"""


def undo_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as undos: the events of each user that stand."""
    kept = surviving(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    return kept.select("user_id", "event_id")


UNDO_SQL = """WITH s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
l AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS level FROM s),
k AS (SELECT *, min(level) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS least FROM l)
SELECT user_id, event_id FROM k WHERE event_type <> 'error' AND least >= level"""


def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return save_points(table(spark, sf_dir, "events"), ["user_id"], "ts", "6 hours")


DEBOUNCE_SQL = """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS first, max(ts) + INTERVAL 6 HOUR AS saved_at, count(*) AS n FROM s GROUP BY user_id, s"""


def cell_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule for a single cell, on the numbers of parts as text."""
    k = F.col("p_partkey")
    now = F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit("x")).otherwise(k.cast("string"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", cells.continuous(now, (F.col("p_retailprice")).cast("string")).alias("continuous"), cells.toggled(F.when(k % 2 == 0, F.lit(" no ")).otherwise(F.lit("YES"))).alias("boolean"),
        cells.percentage(F.concat((k % 120).cast("string"), F.lit("%"))).alias("percentage"), cells.counted(now, 0).alias("categorical"), cells.counted(now, 1).alias("ordinal"),
        cells.parsed_float(F.concat(k.cast("string"), F.lit(",5"))).alias("float"), cells.parsed_integer(F.concat(k.cast("string"), F.when(k % 2 == 0, F.lit(".5")).otherwise(F.lit("")))).alias("integer"),
        cells.feature_of(cells.annotation_id(F.col("p_name"), k)).alias("feature"), cells.run_folder(F.col("p_brand"), F.col("p_size").cast("string")).alias("folder"),
        F.array_join(cells.free_keys(F.array(F.substring("p_name", 1, 1))), "").alias("free"),
    )


CELLS_SQL = """WITH p AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE CAST(p_partkey AS VARCHAR) END AS now FROM part)
SELECT p_partkey, CAST(CAST(coalesce(TRY_CAST(now AS DECIMAL(18,2)), 0) + CAST(p_retailprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS VARCHAR) AS continuous, CASE WHEN p_partkey % 2 = 0 THEN 'YES' ELSE 'NO' END AS boolean,
least(p_partkey % 120 + 5, 100) || '%' AS percentage, CAST(coalesce(TRY_CAST(now AS INTEGER) + 1, 0) AS VARCHAR) AS categorical, CAST(coalesce(TRY_CAST(now AS INTEGER) + 1, 1) AS VARCHAR) AS ordinal,
p_partkey + CAST(0.5 AS DOUBLE) AS float, CASE WHEN p_partkey % 2 = 1 THEN p_partkey END AS integer, p_name AS feature, 'Data_' || p_brand || '_' || p_size AS folder,
replace(replace(replace('abcdefghijklmnopqrstuvwxyz', p_name[1], ''), 'f', ''), 'h', '') AS free FROM p"""


def progress_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    slices = orders.select(F.col("o_custkey").alias("specimen_id"), F.when(F.col("o_orderstatus") == "F", F.lit("failed")).alias("error"))
    totals = orders.groupBy(F.col("o_custkey").alias("specimen_id")).agg(F.count("*").alias("total"))
    return progress(slices, totals).withColumn("percent", r6("percent"))


PROGRESS_SQL = "SELECT o_custkey AS specimen_id, count(*) FILTER (o_orderstatus <> 'F') AS done, count(*) AS total, round(count(*) FILTER (o_orderstatus <> 'F') / CAST(count(*) AS DOUBLE) * 100, 6) AS percent FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus <> 'F') > 0"


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as specimens and exports, their orders as slices."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("done"))
    cancelled, failed = F.col("o_custkey") % 3 == 0, results.failed_slices(F.col("total"), F.col("done") * 2)
    return o.select("o_custkey", results.specimen_status(F.col("done"), F.col("total"), cancelled).alias("status"), results.export_status(F.when(F.col("o_custkey") % 10 == 0, F.lit("x")), failed).alias("export"))


STATUS_SQL = """WITH o AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS done FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN o_custkey % 3 > 0 OR done >= total THEN 'Completed' WHEN done = 0 THEN 'Cancelled' ELSE 'Partial' END AS status,
CASE WHEN o_custkey % 10 = 0 THEN 'Error' WHEN total - done * 2 > 0 THEN 'Done (' || (total - done * 2) || ' failed)' ELSE 'Done' END AS export FROM o"""


def fifo_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders of a customer meet the open ones, the first the first."""
    o = table(spark, sf_dir, "orders")
    left = o.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("row_key"))
    right = o.where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("result_key"))
    return queue.matched_first_come(left, right, ["o_custkey"], ["row_key"], ["result_key"])


FIFO_SQL = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS r FROM orders)
SELECT a.o_custkey, a.o_orderkey AS row_key, b.o_orderkey AS result_key FROM n a LEFT JOIN n b ON a.o_custkey = b.o_custkey AND a.r = b.r AND b.o_orderstatus = 'O' WHERE a.o_orderstatus = 'F'"""


def config_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as specimens, suppliers as runs: the asked one, else the first that has a config."""
    runs = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("specimen_id"), F.concat(F.lit("op"), (F.col("s_suppkey") % 4).cast("string")).alias("operator"), (F.col("s_suppkey") % 3).cast("string").alias("measurement"), (F.col("s_acctbal") > 3000).alias("has_config"), F.col("s_suppkey").alias("run_order"))
    specimens = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("specimen_id"))
    return results.chosen_run(specimens, runs, "op1", "2").select("specimen_id", "operator", "measurement", "run_order")


FALLBACK_SQL = """WITH r AS (SELECT s_nationkey, 'op' || s_suppkey % 4 AS operator, CAST(s_suppkey % 3 AS VARCHAR) AS measurement, s_suppkey, s_acctbal > 3000 AS ok FROM supplier),
k AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY (operator = 'op1' AND measurement = '2') DESC, s_suppkey) AS n FROM r WHERE ok OR (operator = 'op1' AND measurement = '2'))
SELECT n_nationkey AS specimen_id, operator, measurement, s_suppkey AS run_order FROM nation LEFT JOIN k ON s_nationkey = n_nationkey AND k.n = 1"""


def column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 > 0, F.substring("p_type", 1, 1)).alias("keybinding"))
    return results.column_order(columns, ["p_brand"], "p_partkey").select("p_brand", "p_partkey", "order", "position_after", "duplicate")


COLUMN_SQL = """WITH p AS (SELECT *, CASE WHEN p_partkey % 3 > 0 THEN p_type[1] END AS k FROM part)
SELECT p_brand, p_partkey, CAST(row_number() OVER w - 1 AS INTEGER) AS "order", lag(p_name, 1, 'SLICE') OVER w AS position_after,
count(*) OVER (PARTITION BY p_brand, p_name) > 1 OR (k IS NOT NULL AND count(*) OVER (PARTITION BY p_brand, k) > 1) AS duplicate FROM p WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)"""


def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "customer").select((F.col("c_acctbal") > 5000).alias("has_results"), (F.col("c_acctbal") > 0).alias("has_coordinates"))
    return results.load_summary(s)


SUMMARY_SQL = "SELECT count(*) AS total, count(*) FILTER (c_acctbal > 5000) AS analysed, count(*) FILTER (c_acctbal <= 0) AS missing FROM customer"


def undo_to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's events that stand, all but the first three taken back: what their cells hold again and which annotations go."""
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", F.col("props").alias("old_value"), F.col("event_id").alias("annotation_id"))
    kept = surviving(log, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    found = restored(undone_from(kept, ["user_id"], ["ts", "event_id"], 3), ["user_id", "event_type"], ["ts", "event_id"])
    return found.select("user_id", "event_type", "value", "undone", F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))


TO_INDEX_SQL = UNDO_SQL.replace("SELECT user_id, event_id FROM k", ", e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM k", 1) + """)
SELECT user_id, event_type, arg_min(props, (ts, event_id)) AS value, count(*) AS undone, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS dropped FROM e WHERE r > 3 GROUP BY user_id, event_type"""


def queue_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that a queue doesn't take, and why."""
    c = [F.col(x) for x in ("first_slice", "last_slice", "num_slices", "db_min", "db_max", "slice_direction", "refractive_index", "file_path")]
    found = queue.rejected(_items(spark, sf_dir), rules.queue_item(*c))
    return found.select("p_partkey", F.array_join("errors", " | ").alias("errors"), F.array_join("warnings", " | ").alias("warnings"))


REJECTS_SQL = f"SELECT p_partkey, errors, warnings FROM ({QUEUE_SQL}) WHERE NOT is_valid"


def queue_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's queue without its 31st row, where it has one."""
    return queue.removed_at(_queue(spark, sf_dir), ["p_brand"], 30)


REMOVAL_SQL = """WITH a AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS p, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p) - 1 AS INTEGER) AS position, CASE WHEN n <= 30 THEN 'index 30 out of bounds' END AS error FROM a WHERE n <= 30 OR p <> 30"""


def queue_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items set to a window for all and to a direction for some; then those that are ready."""
    items = queue.with_status(_items(spark, sf_dir).withColumn("status", F.lit("Pending")), "Ready", F.col("num_slices") > 3)
    items = queue.updated(items, {"db_min": F.lit(25), "db_max": F.col("db_min") + 60})
    items = queue.updated(items, {"slice_direction": F.lit("XY")}, F.col("first_slice") == 1)
    return queue.of_status(items, "Ready").select("p_partkey", "db_min", "db_max", "slice_direction", "status")


UPDATES_SQL = f"WITH {ITEMS} SELECT p_partkey, 25 AS db_min, lo + 60 AS db_max, CASE WHEN f = 1 THEN 'XY' ELSE d END AS slice_direction, 'Ready' AS status FROM q WHERE n > 3"


def measurement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as users see it: static columns, and one for each kind of cell behind SLICE."""
    actions = _actions(spark, sf_dir)
    shown = folded(actions, ["user_id", "slice"], ["ts", "event_id"]).withColumn("column", F.col("data_type"))
    last = actions.groupBy("user_id", "slice", "data_type").agg(F.max("ts").alias("ts"))
    static = {"SPECIMEN_NAME": F.concat(F.lit("user_"), F.first("user_id").cast("string")), "SLICE": F.first("slice") + 1, "OPERATOR": F.lit("op"), "MEASUREMENT": F.lit("1"), "DATE_TIME": results.written_at(F.col("ts"))}
    return results.wide_measurements(shown.join(last, ["user_id", "slice", "data_type"]), ["user_id", "slice"], ["Continuous", "Categorical"], static)


ROWS_SQL = """SELECT user_id, 'user_' || user_id AS SPECIMEN_NAME, CAST(event_id % 2 + 1 AS VARCHAR) AS SLICE, CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'click') AS VARCHAR) AS Continuous,
CASE WHEN count(*) FILTER (event_type = 'signup') > 0 THEN CAST(count(*) FILTER (event_type = 'signup') - 1 AS VARCHAR) END AS Categorical, 'op' AS OPERATOR, '1' AS MEASUREMENT, '' AS SYSTEM,
strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS DATE_TIME FROM events GROUP BY user_id, event_id % 2"""

_HERE = {
    "validate_queue": (validate_queue, QUEUE_SQL), "validate_ranges": (validate_ranges, RANGES_SQL), "validate_settings": (validate_settings, SETTINGS_SQL), "batch_validation": (batch_validation, BATCH_SQL),
    "queue_edits": (queue_edits, EDITS_SQL), "queue_defaults": (queue_defaults, DEFAULTS_SQL), "queue_direction": (directions, DIRECTIONS_SQL), "scale_and_dpi": (scale_and_dpi, SCALE_SQL),
    "color_functions": (color_functions, COLOR_SQL), "natural_sort": (natural_sort, NATURAL_SQL), "file_discovery": (file_discovery, DISCOVERY_SQL), "sidecar_parse": (sidecar_parse, SIDECAR_SQL),
    "image_stacks": (image_stack_listing, STACK_SQL), "measurement_fold": (measurement_fold, FOLD_SQL), "undo_replay": (undo_replay, UNDO_SQL), "debounce_sessions": (debounce_sessions, DEBOUNCE_SQL),
    "cell_changes": (cell_changes, CELLS_SQL), "progress_rollup": (progress_rollup, PROGRESS_SQL), "run_status": (run_status, STATUS_SQL), "fifo_match": (fifo_match, FIFO_SQL),
    "config_fallback": (config_fallback, FALLBACK_SQL), "column_order": (column_order, COLUMN_SQL), "load_summary": (load_summary, SUMMARY_SQL),
    "undo_to_index": (undo_to_index, TO_INDEX_SQL), "queue_rejects": (queue_rejects, REJECTS_SQL), "queue_removal": (queue_removal, REMOVAL_SQL), "queue_updates": (queue_updates, UPDATES_SQL),
    "measurement_rows": (measurement_rows, ROWS_SQL),
}
QUERIES = {k: v[0] for k, v in _HERE.items()}
ORACLE_SQL = {k: v[1] for k, v in _HERE.items()}
