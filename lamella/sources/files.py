"""Pictures, sidecars, configurations, annotations and tables in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lamella.functions.cells import natural_key

#: Names of folders and keys of the files.
SKIPPED_FOLDER, RUN_PREFIX = "annotations", "Data_"
CONFIG_KEYS = ("metadata", "columns", "config_info")
POINT = "array<double>"
REGION = f"struct<slice_index:int,specimen_start:{POINT},lesion_start:{POINT},lesion_end:{POINT},tooth_end:{POINT},start_point:{POINT},end_point:{POINT},is_keyframe:boolean,buffer_pixels:int>"
AIR = f"struct<slice_index:int,point1:{POINT},point2:{POINT},is_keyframe:boolean>"
STORED = f"""struct<surface:struct<raw_points:array<{POINT}>,fitted_curves:map<string,array<{POINT}>>,is_cavitated:boolean,cavitation_depth:double>,
lesion_depth:struct<points:array<{POINT}>,mean:double,median:double,std:double,se:double>>"""
CONFIG_SCHEMA = f"specimen_id string, regions map<string,{REGION}>, air map<string,{AIR}>"
ANNOTATION = f"struct<id:string,feature:string,points:array<{POINT}>,mode:string,color:string,locked:boolean,timestamp:string>"


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def list_files(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """``path, length, modified`` of files, without their bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def stacks_of(files: DataFrame) -> DataFrame:
    """``specimen_id, folder, path, slice``: pictures of each folder in natural order; folders under one for annotations are left out.

    A specimen is named by its folder; ``duplicate`` marks names that several folders have.
    """
    pictures = files.where(F.lower(_name(F.col("path"))).rlike(r"\.(png|tif|tiff)$")).withColumn("folder", _folder(F.col("path")))
    kept = pictures.where(~F.exists(F.split(F.lower("folder"), "/"), lambda p: p == SKIPPED_FOLDER)).withColumn("specimen_id", _name(F.col("folder")))
    order = Window.partitionBy("folder").orderBy(natural_key(_name(F.col("path"))), "path")
    kept = kept.withColumn("slice", (F.row_number().over(order) - 1).cast("int"))
    several = F.size(F.collect_set("folder").over(Window.partitionBy("specimen_id"))) > 1
    return kept.select("specimen_id", "folder", "path", "slice", several.alias("duplicate"))


def image_stacks(spark: SparkSession, root: str) -> DataFrame:
    return stacks_of(list_files(spark, root, "*.{png,tif,tiff,PNG,TIF,TIFF}"))


def image_list(spark: SparkSession, folder: str) -> DataFrame:
    """Pictures of one folder for annotation, in natural order."""
    files = list_files(spark, folder, "*.{png,tif,tiff,jpg,jpeg,PNG,TIF,TIFF,JPG,JPEG}", recursive=False)
    order = Window.orderBy(natural_key(_name(F.col("path"))))  # one folder's pictures
    return files.select("path", (F.row_number().over(order) - 1).cast("int").alias("slice"))


def image_slices(spark: SparkSession, stacks: DataFrame, root: str) -> DataFrame:
    """Grey slices ``specimen_id, slice, height, width, pixels`` of a stack's pictures; those that can't be decoded are dropped."""
    pictures = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,tif,tiff,PNG,TIF,TIFF}").load(root)
    rows = pictures.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("pixels"))
    plain = lambda p: F.regexp_replace(p, "^file:/+", "/")
    keyed = stacks.withColumn("_p", plain(F.col("path"))).drop("path")
    return rows.where("n = 1").withColumn("_p", plain(F.col("path"))).join(keyed, "_p").select("specimen_id", "slice", "height", "width", "pixels")


def prior_runs(files: DataFrame) -> DataFrame:
    """``folder, run, operator, measurement`` of the result folders beside stacks."""
    runs = files.select(_folder(F.col("path")).alias("run_path")).distinct().where(_name(F.col("run_path")).startswith(RUN_PREFIX))
    parts = F.regexp_extract(_name(F.col("run_path")), f"^{RUN_PREFIX}(.*)_([^_]*)$", 1), F.regexp_extract(_name(F.col("run_path")), f"^{RUN_PREFIX}(.*)_([^_]*)$", 2)
    return runs.select(_folder(F.col("run_path")).alias("folder"), _name(F.col("run_path")).alias("run"), parts[0].alias("operator"), parts[1].alias("measurement"))


def sidecar_settings(lines: DataFrame) -> DataFrame:
    """``file_path, view, start, end, n, index, error`` of export sidecars, from rows ``file_path, line, text``.

    A line is ``[view:]start-end[:count][:index]``; blank lines and those that begin with # are skipped. The
    last line of a view counts. A file with a bad line gives one row with ``error`` and nothing else.
    """
    used = lines.where((F.trim("text") != "") & ~F.col("text").startswith("#"))
    t = F.filter(F.transform(F.split("text", ":"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
    rows = used.withColumn("t", t).withColumn("k", F.size("t"))
    g = lambda i: F.get("t", F.lit(i))
    whole = lambda c: F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("int"))
    dashed = lambda i: g(i).contains("-")
    shape = F.when((F.col("k") == 1) & dashed(0), 1).when((F.col("k") == 2) & dashed(0), 2).when((F.col("k") == 3) & dashed(1), 3).when(F.col("k") == 4, 4)
    rows = rows.withColumn("shape", shape)
    long = F.col("shape") >= 3
    span = F.split(F.when(long, g(1)).otherwise(g(0)), "-")
    count = F.when(F.col("shape") == 2, whole(g(1))).when(long, whole(g(2)))
    index = F.when((F.col("shape") == 2) & whole(g(1)).isNull(), g(1).try_cast("double")).when(F.col("shape") == 4, g(3).try_cast("double")).when(F.col("shape").isNotNull(), F.lit(1.0))
    rows = rows.withColumns({"view": F.when(long, F.upper(g(0))).otherwise(F.lit("XZ")), "start": F.when(F.size(span) == 2, whole(F.trim(F.get(span, F.lit(0))))), "end": F.when(F.size(span) == 2, whole(F.trim(F.get(span, F.lit(1))))), "_count": count, "index": index})
    rows = rows.withColumn("n", F.when((F.col("shape") == 1) | ((F.col("shape") == 2) & F.col("_count").isNull()), F.col("end") - F.col("start") + 1).otherwise(F.col("_count")))
    fine = F.coalesce((F.col("start") >= 1) & (F.col("end") >= F.col("start")) & (F.col("n") >= 1) & F.col("index").between(0.1, 5.0), F.lit(False))
    last = rows.withColumn("ok", fine).groupBy("file_path", "view").agg(F.max_by(F.struct("start", "end", "n", "index"), "line").alias("s"), F.bool_and("ok").alias("ok"), F.min(F.when(~F.col("ok"), F.col("text"))).alias("bad"))
    good = F.min(F.col("ok").cast("int")).over(Window.partitionBy("file_path")) == 1
    first_bad = F.min("bad").over(Window.partitionBy("file_path"))
    marked = last.withColumns({"good": good, "error": F.when(~good, F.concat(F.lit("Unrecognized format in line: "), first_bad)), "_r": F.row_number().over(Window.partitionBy("file_path").orderBy("view"))})
    value = lambda c: F.when(F.col("good"), c)
    return marked.where("good or _r = 1").select("file_path", value(F.col("view")).alias("view"), *[value(F.col(f"s.{c}")).alias(c) for c in ("start", "end", "n", "index")], "error")


def read_sidecars(spark: SparkSession, glob: str) -> DataFrame:
    """Sidecar files by path, split into lines and parsed."""
    files = spark.read.option("wholetext", True).text(glob).select(F.col("_metadata.file_path").alias("file_path"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    return sidecar_settings(files)


def archives_with_sidecars(headers: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Archives with the settings of the text file of the same name; a missing or bad one means all XZ slices."""
    stem = lambda p: F.regexp_replace(p, r"\.[^./]*$", "")
    named = sidecars.withColumn("_stem", stem(F.col("file_path"))).drop("file_path")
    rows = headers.withColumn("_stem", stem(F.col("path"))).join(named, "_stem", "left")
    default = {"view": F.lit("XZ"), "start": F.lit(1), "end": F.col("dim_y"), "n": F.col("dim_y"), "index": F.lit(1.0)}
    return rows.withColumns({k: F.coalesce(F.col(k), v) for k, v in default.items()}).drop("_stem")


def _xy(p: Column) -> Column:
    return F.when(F.size(p) == 2, F.struct(F.get(p, F.lit(0)).cast("int").alias("x"), F.get(p, F.lit(1)).cast("int").alias("y")))


def config_regions(configs: DataFrame, json: str = "json") -> DataFrame:
    """``path, slice`` and the four points of each region of configurations; old ones with two points count for both pairs."""
    rows = configs.withColumn("c", F.from_json(json, CONFIG_SCHEMA)).select("path", F.explode("c.regions").alias("k", "r"))
    old = F.col("r.specimen_start").isNull()
    point = lambda new, two: _xy(F.when(old, F.col(f"r.{two}")).otherwise(F.col(f"r.{new}")))
    return rows.select(
        "path", F.col("k").try_cast("int").alias("slice"), point("specimen_start", "start_point").alias("specimen_start"), point("lesion_start", "start_point").alias("lesion_start"),
        point("lesion_end", "end_point").alias("lesion_end"), point("tooth_end", "end_point").alias("specimen_end"),
        F.when(old, F.lit(False)).otherwise(F.coalesce("r.is_keyframe", F.lit(False))).alias("is_keyframe"), F.coalesce("r.buffer_pixels", F.lit(10)).alias("buffer"),
    )


def config_air(configs: DataFrame, json: str = "json") -> DataFrame:
    """``path, slice, point1, point2, is_keyframe`` of the air rectangles of configurations."""
    rows = configs.withColumn("c", F.from_json(json, CONFIG_SCHEMA)).select("path", F.explode("c.air").alias("k", "a"))
    return rows.select("path", F.col("k").try_cast("int").alias("slice"), _xy(F.col("a.point1")).alias("point1"), _xy(F.col("a.point2")).alias("point2"), F.coalesce("a.is_keyframe", F.lit(False)).alias("is_keyframe"))


def stored_results(configs: DataFrame, json: str = "json", full: bool = True) -> DataFrame:
    """Results kept in configurations: ``path, slice, surface, lesion_depth``; or only ``path, has_results``, which reads none of them."""
    if not full:
        return configs.select("path", F.get_json_object(json, "$.annotations").isNotNull().alias("has_results"))
    rows = configs.withColumn("c", F.from_json(json, f"annotations map<string,{STORED}>"))
    return rows.select("path", F.explode("c.annotations").alias("k", "v")).select("path", F.col("k").try_cast("int").alias("slice"), "v.surface", "v.lesion_depth")


def slice_annotations(files: DataFrame, json: str = "json") -> DataFrame:
    """``path, slice`` and the annotations of each slice, defaults filled in."""
    rows = files.select("path", F.explode(F.from_json(json, f"map<string,array<{ANNOTATION}>>")).alias("k", "list")).select("path", F.regexp_extract("k", "([0-9]+)$", 1).try_cast("int").alias("slice"), F.explode("list").alias("a"))
    default = {"feature": F.lit("unknown"), "mode": F.lit("line"), "color": F.lit("#FFFFFF"), "locked": F.lit(False)}
    points = F.transform(F.coalesce("a.points", F.array()), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return rows.select("path", "slice", "a.id", points.alias("points"), *[F.coalesce(F.col(f"a.{k}"), v).alias(k) for k, v in default.items()], F.coalesce(F.col("a.timestamp").try_cast("timestamp"), F.current_timestamp()).alias("timestamp"))


def column_config(files: DataFrame, json: str = "json") -> DataFrame:
    """``path`` and the columns of column configurations that have all their keys; others give nothing."""
    whole = F.lit(True)
    for key in CONFIG_KEYS:
        whole = whole & F.get_json_object(json, f"$.{key}").isNotNull()
    spec = "array<struct<name:string,keybinding:string,position_after:string,order:int,data_type:string,color:string>>"
    rows = files.where(whole).select("path", F.explode(F.from_json(F.get_json_object(json, "$.columns.dynamic_columns"), spec)).alias("c"))
    return rows.select("path", "c.*")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A results table with a header, all columns text."""
    return spark.read.option("header", True).csv(path)


def read_summary(table: DataFrame, n_sound: int, n_lesion: int) -> DataFrame:
    """A summary table back as ``slice`` (from 0), ``sound`` and ``lesion`` medians and ``depth``; rows without a slice are skipped."""
    names = table.columns[1:]
    value = lambda part: F.array(*[F.col(f"`{c}`").try_cast("double") for c in part])
    depth = names[n_sound + n_lesion] if len(names) > n_sound + n_lesion else None
    rows = table.where(F.col(f"`{table.columns[0]}`").try_cast("int").isNotNull())
    return rows.select((F.col(f"`{table.columns[0]}`").try_cast("int") - 1).alias("slice"), value(names[:n_sound]).alias("sound"), value(names[n_sound : n_sound + n_lesion]).alias("lesion"), (F.col(f"`{depth}`").try_cast("double") if depth else F.lit(None).cast("double")).alias("depth"))


def find_file(files: DataFrame, pattern: str, sample: str | None = None) -> DataFrame:
    """The file whose name matches, one with the sample's name in it first, then by path."""
    named = files.where(_name(F.col("path")).rlike(pattern))
    has = F.contains(_name(F.col("path")), F.lit(sample)) if sample else F.lit(False)
    return named.orderBy(has.desc(), "path").limit(1)
