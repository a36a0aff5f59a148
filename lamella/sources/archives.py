"""Instrument archives: zip files with an XML header and binary members."""

from __future__ import annotations

import contextlib
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Names and numbers of the archive format.
HEADER, INTENSITY, VIDEO, CHIRP, OFFSETS, SPECTRAL = "Header.xml", "data/Intensity.data", "data/VideoImage.data", "data/Chirp.data", "data/OffsetErrors.data", "data/Spectral%d.data"
AT_20_DB, AT_80_DB = 1105000000, 1119000000
#: Bytes that a row may have, about.
LARGEST = (1 << 31) - (1 << 16)
NO_RATE, NO_VERSION, NO_TIME = "notAvail-Old_OCT_Version", "notAvail-Old_OCT_Version", "Unknown"

HEADER_SCHEMA = """Image struct<_Type:string>, SizeReal string, SizePixel string, PixelSpacing string, Study string, ExperimentNumber string,
SpectrometerElements string, IntensityAveraging struct<AScans:string>, BinaryToElectronCountScaling string, Model string, Serial string, Probe string,
CentralWavelength string, DevicePresetDescription string, Timestamp string, ScanTime string, OriginalSoftwareVer string,
DataFiles struct<DataFile:array<struct<_Type:string,_ApoRegionEnd0:string,_ScanRegionStart0:string,_ScanRegionEnd0:string,_SizeZ:string,_SizeX:string>>>"""
DISCOVERY_SCHEMA = "Image struct<_Type:string>, Serial string, SizePixel string"


def scan_archives(spark: SparkSession, root: str, recursive: bool = True, pattern: str = "*.oct") -> DataFrame:
    """``path, length, modified`` of the archives under a folder, without their bytes, by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified")).orderBy("path")


def scan_reported(spark: SparkSession, root: str, recursive: bool = True, pattern: str = "*.oct") -> DataFrame:
    """``scan_archives`` with ``error``: where a folder is missing, is none or holds no archive, one row that says so instead of an exception."""
    schema = "path string, length long, modified timestamp, error string"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(at) and not store.getFileStatus(at).isDirectory():
        return spark.createDataFrame([(None, None, None, f"Path is not a directory: {root}")], schema)
    try:
        found = scan_archives(spark, root, recursive, pattern).withColumn("error", F.lit(None).cast("string"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([(None, None, None, f"Directory does not exist: {root}")], schema)
    empty = found.limit(1).agg(F.count("*").alias("_n")).where("_n = 0")
    return found.unionByName(empty.select(F.lit(f"No archives found in: {root}").alias("error")), allowMissingColumns=True)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if ":/" in path else f"file://{path}")


def with_members(files: DataFrame, members: list[str], content: str = "content") -> DataFrame:
    """``path, member, bytes`` of the named members that archives have, with ``error`` instead of bytes where one can't be read.

    Without a ``content`` column archives are opened by path, where Arrow knows the store, and only the zip's
    directory and the asked members are read, whatever the archive's size; with one its bytes are taken.
    Members that aren't asked for are never inflated. A name may hold ``*``.
    """
    schema = "path string, member string, bytes binary, error string"
    loaded = content in files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column(0).to_pylist()):
                try:
                    with contextlib.ExitStack() as stack:
                        if loaded:
                            source = io.BytesIO(batch.column(1)[i].as_buffer())
                        else:
                            store, name = opened(path)
                            source = stack.enter_context(store.open_input_file(name))
                        archive = stack.enter_context(zipfile.ZipFile(source))
                        names = [n for n in archive.namelist() if any(fnmatch(n, m) for m in members)]
                        # a cell holds 2 GB at most; larger members are read by slices, as volumes
                        large = lambda n: archive.getinfo(n).file_size >= LARGEST
                        out = [(path, n, None, f"member of {archive.getinfo(n).file_size} bytes") if large(n) else (path, n, archive.read(n), None) for n in names] or [(path, None, None, "no such member")]
                except Exception as e:  # a bad archive is a row, not an end
                    out = [(path, None, None, f"{type(e).__name__}: {e}")]
                for row in out:
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.string(), pa.string(), pa.binary(), pa.string()), strict=True)], ["path", "member", "bytes", "error"])

    return files.select("path", *[content] * loaded).mapInArrow(run, schema)


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def _part(text: Column, i: int, kind: str, default=None) -> Column:
    value = F.get(_lines(text), F.lit(i)).try_cast(kind)
    return value if default is None else F.coalesce(value, F.lit(default).cast(kind))


def discover_headers(headers: DataFrame, reader: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Type, serial and size of archives whose header is in ``bytes``: three fields of it, sizes 1 where missing or bad."""
    if reader is not None:
        return reader(headers)
    h = F.from_xml(F.decode("bytes", "UTF-8"), DISCOVERY_SCHEMA)
    rows = headers.withColumn("h", h)
    return rows.select("path", F.col("h.Image._Type").alias("data_type"), F.trim("h.Serial").alias("serial"), *[_part(F.col("h.SizePixel"), i, "int", 1).alias(n) for n, i in (("dim_x", 1), ("dim_y", 2), ("dim_z", 0))])


def read_headers(headers: DataFrame) -> DataFrame:
    """All that the header in ``bytes`` tells of an archive; what is missing or bad is null or its default."""
    h = lambda name: F.col(f"h.{name}")
    rows = headers.withColumn("h", F.from_xml(F.decode("bytes", "UTF-8"), HEADER_SCHEMA))
    files = F.coalesce(h("DataFiles.DataFile"), F.array())
    by_type = lambda t: F.get(F.filter(files, lambda d: d["_Type"] == t), F.lit(0))
    with_regions = F.get(F.filter(files, lambda d: d["_ApoRegionEnd0"].isNotNull() & d["_ScanRegionEnd0"].isNotNull()), F.lit(0))
    rows = rows.withColumns({"_raw": F.when(F.coalesce(h("Image._Type"), F.lit("Unknown")) != "Processed", F.coalesce(by_type("RawSpectral"), with_regions)), "_video": by_type("Colored")})
    spacing = {a: _part(h("PixelSpacing"), i, "double", 1.0) * 1000 for a, i in (("z", 0), ("x", 1), ("y", 2))}
    mm_y, dim_y = _part(h("SizeReal"), 2, "double"), _part(h("SizePixel"), 2, "int", 1)
    ratio = lambda a: F.when(spacing["z"] != 0, F.round(spacing[a] / spacing["z"], 2)).otherwise(F.lit(1.0))
    moment = F.coalesce(F.trim(h("Timestamp")), F.lit("0")).try_cast("long")
    rate = F.split_part(F.get(F.split(h("DevicePresetDescription"), r"\("), F.lit(1)), F.lit(" "), F.lit(1))
    number = lambda name, kind, default: F.coalesce(F.trim(h(name)).try_cast(kind), F.lit(default).cast(kind))
    return rows.select(
        "path", F.coalesce(h("Image._Type"), F.lit("Unknown")).alias("data_type"),
        *[_part(h("SizeReal"), i, "double").alias(n) for n, i in (("mm_z", 0), ("mm_x", 1), ("mm_y", 2))],
        *[_part(h("SizePixel"), i, "int", 1).alias(n) for n, i in (("dim_z", 0), ("dim_x", 1), ("dim_y", 2))],
        *[spacing[a].alias(f"spacing_{a}") for a in "zxy"],
        _part(h("SizeReal"), 1, "double").alias("pixel_size_z"),  # the second line, as the format's users have it
        ratio("x").alias("resize_x"), ratio("y").alias("resize_y"),
        F.replace(F.coalesce(h("Study"), F.lit("")), F.lit(" "), F.lit("_")).alias("study"), number("ExperimentNumber", "int", 0).alias("experiment"),
        number("SpectrometerElements", "int", 0).alias("n_elements"), F.col("_raw._ApoRegionEnd0").try_cast("int").alias("n_apo"),
        (F.col("_raw._ScanRegionEnd0").try_cast("int") - F.col("_raw._ScanRegionStart0").try_cast("int")).alias("n_scans"),
        F.when(F.coalesce(h("Image._Type"), F.lit("Unknown")) != "Processed", F.trim(h("BinaryToElectronCountScaling")).try_cast("double")).alias("scale"),
        F.coalesce(F.trim(h("IntensityAveraging.AScans")).try_cast("int"), F.lit(1)).alias("n_average"),
        h("Model").alias("model"), h("Serial").alias("serial"), F.coalesce(F.concat(F.when(rate != "", rate), F.lit(" kHz")), F.lit(NO_RATE)).alias("sensitivity"), h("Probe").alias("probe"),
        F.split_part(F.coalesce(h("CentralWavelength"), F.lit("")), F.lit("."), F.lit(1)).alias("wavelength"),
        F.coalesce(F.date_format(F.timestamp_seconds(moment), "yyyy-MM-dd HH:mm:ss"), F.lit(NO_TIME)).alias("acquired"), F.timestamp_seconds(moment).alias("acquired_at"),
        number("ScanTime", "double", 0.0).alias("scan_time"), F.coalesce(h("OriginalSoftwareVer"), F.lit(NO_VERSION)).alias("software"),
        (mm_y.isNotNull() & (dim_y > 1) & (spacing["y"] > 0)).alias("is_3d"),
        F.coalesce(F.col("_video._SizeZ").try_cast("int"), F.lit(0)).alias("video_z"), F.coalesce(F.col("_video._SizeX").try_cast("int"), F.lit(0)).alias("video_x"),
    )


def header_value(read: DataFrame, key: str) -> DataFrame:
    return read.select("path", F.col(key).alias("value"))


def video_pixels(members: DataFrame, headers: DataFrame) -> DataFrame:
    """``path, row, col, r, g, b`` of preview pictures: four bytes a pixel, blue first, in rows of the header's size."""
    rows = members.join(headers.select("path", "video_z", "video_x"), "path").where("bytes is not null and video_z > 0")
    at = rows.select("path", "bytes", "video_z", F.explode(F.sequence(F.lit(0), F.floor(F.length("bytes") / 4).cast("int") - 1)).alias("i"))
    byte = lambda k: F.conv(F.hex(F.substring("bytes", F.col("i") * 4 + k + 1, F.lit(1))), 16, 10).cast("int")
    return at.select("path", F.floor(F.col("i") / F.col("video_z")).cast("int").alias("row"), (F.col("i") % F.col("video_z")).cast("int").alias("col"), byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"))


def grey_levels(stored: np.ndarray, db_min: float, db_max: float) -> np.ndarray:
    """Bytes for stored intensities in a decibel window."""
    slope = (AT_80_DB - AT_20_DB) / 60
    low, high = (slope * db + AT_20_DB - slope * 20 for db in (db_min, db_max))
    return (255 * (np.clip(stored.astype(np.float64), low, high) - low) / (high - low)).astype(np.uint8)


def processed_slices(members: DataFrame, headers: DataFrame, db_min: float = 20, db_max: float = 80) -> DataFrame:
    """Grey slices ``volume_id, slice, height, width, pixels`` of stored intensities, mapped to bytes in a decibel window.

    Intensities are stored from the last slice to the first, scan by scan. A member of the wrong size gives no slice.
    """
    rows = members.join(headers.select("path", "dim_x", "dim_y", "dim_z"), "path").select("path", "bytes", "dim_x", "dim_y", "dim_z")
    schema = "volume_id string, slice int, height int, width int, pixels binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x, y, z = r["dim_x"], r["dim_y"], r["dim_z"]
                if r["bytes"] is None or len(r["bytes"]) != 4 * x * y * z:
                    continue
                volume = np.frombuffer(r["bytes"], dtype="<i4").reshape(y, x, z)
                for s in range(y):
                    grey = grey_levels(volume[y - 1 - s], db_min, db_max).T
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((r["path"], pa.string()), (s, pa.int32()), (z, pa.int32()), (x, pa.int32()), (grey.tobytes(), pa.binary()))], ["volume_id", "slice", "height", "width", "pixels"])

    return rows.mapInArrow(run, schema)


def spectral_slices(members: DataFrame, headers: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Rows for ``reconstruct``: spectra with their volume's chirp and offsets; only the ``selected`` (volume_id, slice) ones, if given."""
    number = F.regexp_extract("member", r"Spectral([0-9]+)\.data$", 1).try_cast("int")
    one = lambda name, out: members.where(F.col("member") == name).select("path", F.col("bytes").alias(out))
    rows = members.where(number.isNotNull()).select("path", number.alias("slice"), F.col("bytes").alias("spectra"))
    if selected is not None:
        rows = rows.join(selected.select(F.col("volume_id").alias("path"), "slice"), ["path", "slice"], "left_semi")
    rows = rows.join(one(CHIRP, "chirp"), "path", "left").join(one(OFFSETS, "offsets"), "path", "left")
    return rows.join(headers.select("path", "n_apo", "n_average", "scale"), "path").withColumnRenamed("path", "volume_id")
