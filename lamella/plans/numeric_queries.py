"""Queries whose results no SQL gives: curve fits, splines, spectra, whole analyses. Tests hold them against plain versions."""

from __future__ import annotations

from struct import pack

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lamella.operators.geometry import with_length
from lamella.operators.specimen import analysed
from lamella.operators.spectral import reconstruct
from lamella.operators.surface import depth_curve, fitted_curve
from lamella.plans.common import r6, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).alias("x"), F.col("value").alias("y"), "event_type")


def surface_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A smooth curve through each user's events, by order and value."""
    ev = _events(spark, sf_dir)
    spans = ev.groupBy("user_id").agg(F.min("x").alias("start"), (F.max("x") + 1).alias("end"))
    return fitted_curve(ev, spans, ["user_id"], "actual_surface")


def depth_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through medians, without outliers."""
    ev = _events(spark, sf_dir)
    spans = ev.groupBy("user_id").agg(F.min("x").alias("start"), (F.max("x") + 1).alias("end"))
    return depth_curve(ev.select("user_id", "x", "y"), spans, ["user_id"])


def annotation_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of a user's events of a kind as annotations, errors and views as splines."""
    lines = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), "y"))).alias("points"))
    mode = F.when(F.col("event_type").isin("error", "view"), "spline").otherwise("line")
    return with_length(lines.withColumn("mode", mode)).select("user_id", "event_type", "mode", r6("length").alias("length"))


def spectral_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as scans of 64 elements, the scans of a label's slice those of 160 neighbouring ids, the first four for apodisation."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.array_join(F.transform("embedding", lambda v: F.format_string("%04x", F.shiftright((v * 2000).cast("int") + 2000, 8) + F.shiftleft(((v * 2000).cast("int") + 2000) % 256, 8))), "").alias("hex"))
    scans = e.withColumn("slice", F.floor(F.col("vec_id") / 160).cast("int"))
    slices = scans.groupBy("label", "slice").agg(F.array_sort(F.collect_list(F.struct("vec_id", "hex"))).alias("s"))
    chirp = "".join(f"{int.from_bytes(pack('<f', i + 0.001 * i * i), 'big'):08x}" for i in range(64))
    raw = slices.select(F.col("label").cast("string").alias("volume_id"), "slice", F.unhex(F.array_join(F.transform("s", lambda x: x["hex"]), "")).alias("spectra"), F.unhex(F.lit(chirp)).alias("chirp"), F.lit(None).cast("binary").alias("offsets"), F.lit(4).alias("n_apo"), F.lit(2).alias("n_average"), F.lit(1.0).alias("scale"))
    return reconstruct(raw, dispersion=20).select("volume_id", "slice", "height", "width", F.sha2("pixels", 256).alias("digest"))


def specimen_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label as a specimen: its vectors of 400 neighbouring ids make a slice of 64 rows, a column each, analysed from surface to depth."""
    e = table(spark, sf_dir, "embeddings")
    scans = e.select("label", "vec_id", F.floor(F.col("vec_id") / 400).cast("int").alias("slice"), F.transform("embedding", lambda v: F.greatest(F.least((128 + 200 * v).cast("int"), F.lit(255)), F.lit(0))).alias("p"))
    scans = scans.withColumn("x", F.row_number().over(Window.partitionBy("label", "slice").orderBy("vec_id")) - 1)
    pixels = scans.select("label", "slice", "x", F.posexplode("p").alias("y", "v"))
    rows = pixels.groupBy("label", "slice").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("s"), (F.max("x") + 1).alias("width"))
    slices = rows.select(F.col("label").cast("string").alias("specimen_id"), "slice", F.lit(64).alias("height"), "width", F.unhex(F.array_join(F.transform("s", lambda q: F.lpad(F.hex(q["v"]), 2, "0")), "")).alias("pixels"))
    none = F.lit(None).cast("int")
    configs = slices.select("specimen_id", "slice", F.lit(0).alias("start_x"), F.floor(F.col("width") / 4).cast("int").alias("lesion_start_x"), F.floor(F.col("width") * 3 / 4).cast("int").alias("lesion_end_x"), F.col("width").alias("end_x"), F.lit(2).alias("buffer"), none.alias("air_left"), none.alias("air_top"), none.alias("air_right"), none.alias("air_bottom"))
    found = analysed(slices, configs, 2, 2, least=3, above=5)
    return found["depth_statistics"].select("specimen_id", "slice", "n", *[r6(c).alias(c) for c in ("mean", "median", "sd", "se")])


QUERIES = {"surface_curves": surface_curves, "depth_curves": depth_curves, "annotation_lengths": annotation_lengths, "spectral_reconstruction": spectral_reconstruction, "specimen_analysis": specimen_analysis}
ORACLE_SQL: dict[str, str] = {}
