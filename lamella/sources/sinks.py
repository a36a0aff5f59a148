"""Where results go: partitioned tables, JSON documents, export rows, error logs."""

from __future__ import annotations

import re
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType


#: Folders of a results table, from the outside in.
PLACE = ["operator", "measurement", "specimen_id"]


def _replace(df: DataFrame, path: str, by: list[str], file_format: str) -> None:
    """Put ``df`` in the place of the folders that it has rows for; all others stay as they are.

    Files are made beside the table and moved in when the job is done, so a job that fails changes nothing and one
    that is repeated gives what it gave.
    """
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(file_format)
    (writer.option("header", True) if file_format == "csv" else writer).save(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_results(tables: dict[str, DataFrame], root: str, operator: str, measurement: str, file_format: str = "parquet", specimens: DataFrame | None = None) -> None:
    """Each table under its name, in folders for operator, measurement and specimen.

    What this run has rows for replaces what was there for the same operator, measurement and specimen; other
    operators, measurements and specimens stay. Of ``specimens`` (``specimen_id``), if given, nothing old stays even where a
    table has no new rows. All tables are worked out before the first is touched, so a run that fails leaves all of
    them as they were, and one that is stopped between two tables is made whole by running it again.
    """
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    staged = f"{root}/_staged-{uuid4().hex}"
    try:
        for name, df in tables.items():
            df.withColumns({"operator": F.lit(operator), "measurement": F.lit(measurement)}).write.parquet(f"{staged}/{name}")
        for name in tables:
            rows = spark.read.parquet(f"{staged}/{name}")
            # a specimen's rows come together, in as many tasks as their size asks for
            _replace(rows.hint("rebalance", "specimen_id"), f"{root}/{name}", PLACE, file_format)
            if specimens is not None:
                emptied = specimens.select(F.col("specimen_id").cast("string")).distinct().join(rows.select(F.col("specimen_id").cast("string")), "specimen_id", "left_anti")
                for r in emptied.toLocalIterator():
                    _delete(spark, f"{root}/{name}/{_folder(operator=operator, measurement=measurement, specimen_id=r['specimen_id'])}")
    finally:
        _delete(spark, staged)


def _folder(**place: str | None) -> str:
    """The folder of a partition: characters that paths can't hold are written as Spark writes them."""
    mark = lambda v: "__HIVE_DEFAULT_PARTITION__" if v is None or v == "" else re.sub(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", v)
    return "/".join(f"{k}={mark(v)}" for k, v in place.items())


def read_written(spark: SparkSession, root: str, name: str, file_format: str = "parquet", by: list[str] | None = None) -> DataFrame:
    """A table of ``write_results`` or ``write_json`` back, with the names of its folders as text (``001`` stays so)."""
    reader = lambda: spark.read.option("header", True).format(file_format)
    by = PLACE if by is None else by
    found = reader().load(f"{root}/{name}" if name else root).schema
    return reader().schema(StructType([StructField(f.name, StringType()) if f.name in by else f for f in found])).load(f"{root}/{name}" if name else root)


def results_writer(name: str, root: str, operator: str, measurement: str, file_format: str = "parquet") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch replaces the specimens that it brings; one that is delivered again changes nothing more."""
    return lambda batch, _: write_results({name: batch}, root, operator, measurement, file_format)


def _pair(p: str) -> Column:
    return F.when(F.col(p).isNotNull(), F.array(F.col(f"{p}.x").cast("int"), F.col(f"{p}.y").cast("int")))


def config_json(regions: DataFrame, air: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """``specimen_id, json``: a configuration document for each specimen; a missing number of a result is null in it.

    A specimen's document is one row, so it must fit into a task; its results are a few kilobytes a slice.
    """
    entry = lambda df, value: df.groupBy("specimen_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("slice").cast("string").alias("key"), value.alias("value"))))).alias("m"))
    region = F.struct(F.col("slice").alias("slice_index"), *[_pair(p).alias(n) for p, n in (("specimen_start", "specimen_start"), ("lesion_start", "lesion_start"), ("lesion_end", "lesion_end"), ("specimen_end", "tooth_end"))], "is_keyframe", F.col("buffer").alias("buffer_pixels"))
    place = F.struct(F.col("slice").alias("slice_index"), _pair("point1").alias("point1"), _pair("point2").alias("point2"), "is_keyframe")
    rows = entry(regions, region).withColumnRenamed("m", "regions").join(entry(air, place).withColumnRenamed("m", "air"), "specimen_id", "full")
    fields = ["specimen_id", "regions", "air"]
    if results is not None:
        value = F.struct(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in results.dtypes if c not in ("specimen_id", "slice")])
        rows = rows.join(entry(results, value).withColumnRenamed("m", "annotations"), "specimen_id", "left")
        fields.append("annotations")
    return rows.select("specimen_id", F.to_json(F.struct(*fields)).alias("json"))


def annotations_json(annotations: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, json``: the annotations of each document by slice."""
    points = F.transform("points", lambda p: F.array(p["x"], p["y"]))
    one = F.struct("id", "feature", points.alias("points"), "mode", "color", "locked", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    slices = annotations.groupBy(*keys, "slice").agg(F.array_sort(F.collect_list(one)).alias("list"))
    entry = F.struct(F.format_string("slice_%d", "slice").alias("key"), F.col("list").alias("value"))
    return slices.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("json"))


def column_config_json(columns: DataFrame, metadata: dict[str, str]) -> DataFrame:
    """One document of the columns in their order, with metadata and the number of columns."""
    spec = F.struct("name", "keybinding", "position_after", "order", "data_type", "color")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("order", spec.alias("spec")))), lambda s: s["spec"])
    meta = F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()])
    return columns.agg(F.to_json(F.struct(meta.alias("metadata"), F.struct(ordered.alias("dynamic_columns")).alias("columns"), F.struct(F.count("*").alias("n_columns")).alias("config_info"))).alias("json"))


def write_json(documents: DataFrame, root: str, by: list[str]) -> None:
    """A text file of one document in a folder for each of ``by``; folders that ``documents`` doesn't name stay."""
    _replace(documents.select(*by, F.col("json").alias("value")), root, by, "text")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_rows(slices: DataFrame) -> DataFrame:
    """Folder, file name and description of exported slices (experiment, name, n_slices, direction, study, extension, export_index, slice), both counted from 0 in the table and from 1 in the name."""
    folder = F.concat_ws("_", F.format_string("%02d", "experiment"), "name", F.col("n_slices").cast("string"), F.lit("Slices"), "direction")
    file = F.format_string("%s_%d_#%d_%04d%s", "name", "experiment", F.col("slice") + 1, F.col("export_index") + 1, "extension")
    return slices.withColumns({"folder": folder, "file": file, "description": F.concat(F.lit("OCT Export - "), F.col("study"))})


def export_report(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``file_path, exported, failed, error`` of each file: what was planned and has no row, or one with an error, failed."""
    done = rows.groupBy("file_path").agg(F.count_if(F.col("error").isNull()).alias("exported"), F.min("error").alias("error"))
    joined = planned.join(done, "file_path", "left").withColumn("exported", F.coalesce("exported", F.lit(0).cast("long")))
    return joined.select("file_path", "exported", F.greatest(F.col("num_slices") - F.col("exported"), F.lit(0)).alias("failed"), "error")


def append_errors(errors: DataFrame, root: str) -> None:
    """Errors (at, function, message) appended to a log with a folder for each day."""
    errors.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(root)
