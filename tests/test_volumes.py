"""Slices of archives read by byte range."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators.stacks import resliced_stack, zoomed_stack
from lamella.sources import archives
from lamella.sources.volumes import Wanted, asked_slices, parse_ranges, volume_slices
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains, StringStartsWith

HEADER = "<Ocity><Image Type='Processed'/><SizePixel>{z}\n{x}\n{y}</SizePixel></Ocity>"


class Holes:
    """A file in which runs of zeros take no room."""

    def __init__(self, path):
        self.file = path.open("wb")

    def write(self, data):
        if len(data) >= 1 << 20 and not any(data):
            self.file.seek(len(data), 1)
        else:
            self.file.write(data)
        return len(data)

    def __getattr__(self, name):
        return getattr(self.file, name)


def volume(path, stored, kind=zipfile.ZIP_STORED, spectra=0):
    y, x, z = stored.shape
    with zipfile.ZipFile(path, "w", kind) as archive:
        archive.writestr("Header.xml", HEADER.format(z=z, x=x, y=y))
        archive.writestr("data/Intensity.data", stored.astype("<i4").tobytes())
        archive.writestr("data/Chirp.data", b"chirp")
        for i in range(spectra):
            archive.writestr(f"data/Spectral{i}.data", bytes([i]) * 1000)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("volumes")
    draw = np.random.default_rng(4)
    volume(root / "a.oct", draw.integers(1_100_000_000, 1_125_000_000, (1000, 16, 12)), spectra=3)
    (root / "sub").mkdir()
    volume(root / "sub" / "b.oct", draw.integers(1_100_000_000, 1_125_000_000, (9, 5, 4)), zipfile.ZIP_DEFLATED, spectra=2)
    volume(root / "wrong.oct", np.zeros((2, 2, 2)))
    with zipfile.ZipFile(root / "short.oct", "w") as archive:
        archive.writestr("Header.xml", HEADER.format(z=2, x=2, y=3))
        archive.writestr("data/Intensity.data", b"1234")
    (root / "c.oct").write_bytes(b"not a zip")
    (root / "d.txt").write_text("x")
    return root


def short(path):
    return path.rsplit("/", 1)[1]


@pytest.mark.parametrize("size", [20_000, 1 << 27])
def test_source_equals_whole_members(spark, folder, size):
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.oct").option("recursiveFileLookup", True).load(str(folder))
    members = archives.with_members(files, ["Header.xml", "data/Intensity.data"])
    headers = archives.read_headers(members.where("member = 'Header.xml'"))
    want = archives.processed_slices(members.where("member like '%Intensity%'"), headers, 30, 70)
    got = volume_slices(spark, str(folder), range_bytes=size, db_min=30, db_max=70)
    rows = lambda df, name: {(short(r[name]), r["slice"], r.height, r.width, bytes(r.pixels)) for r in df.collect()}
    assert rows(got, "path") == rows(want, "volume_id") and got.count() == 1000 + 9 + 2
    assert got.rdd.getNumPartitions() > 30 if size < 1 << 20 else got.rdd.getNumPartitions() == 5


def test_a_slice_costs_a_slice(spark, folder):
    size = (folder / "a.oct").stat().st_size
    one = volume_slices(spark, str(folder / "a.oct"), slices="500").collect()
    assert [r.slice for r in one] == [500] and one[0].bytes_read < size / 100
    asked = asked_slices(spark.createDataFrame([(str(folder / "a.oct"), s) for s in (500, 3)], "path string, slice int")).collect()
    assert {r.slice for r in asked} == {500, 3} and sum(r.bytes_read for r in asked) < size / 100
    assert bytes(next(r.pixels for r in asked if r.slice == 500)) == bytes(one[0].pixels)
    some = volume_slices(spark, str(folder)).where("slice > 996 and slice <= 998 and path like '%a.oct'")
    assert sorted(r.slice for r in some.collect()) == [997, 998]
    some = volume_slices(spark, str(folder)).where(F.col("slice").isin(1, 5) & (F.col("height") == 4))
    assert sorted((short(r.path), r.slice) for r in some.collect()) == [("b.oct", 1), ("b.oct", 5)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "height" in plan.split("Filter")[1].split("\n")[0] and "slice" not in plan.split("Filter")[1].split("\n")[0]


def test_columns_that_are_not_wanted_are_not_read(spark, folder):
    found = volume_slices(spark, str(folder), columns=["slice", "path", "bytes_read"])
    assert found.columns == ["slice", "path", "bytes_read"]
    assert found.agg(F.sum("bytes_read")).first()[0] == 0 and found.where("path like '%b.oct'").count() == 9


def test_spectra(spark, folder):
    rows = volume_slices(spark, str(folder), kind="spectral").collect()
    assert {(short(r.path), r.slice, bytes(r.spectra), bytes(r.chirp), r.offsets) for r in rows} == {(f"{n}.oct", i, bytes([i]) * 1000, b"chirp", None) for n, k in (("a", 3), ("b", 2)) for i in range(k)}
    got = asked_slices(spark.createDataFrame([(str(folder / "a.oct"), 1), (str(folder / "a.oct"), 7)], "path string, slice int"), "spectral").collect()
    assert {(r.slice, r.error, None if r.spectra is None else bytes(r.spectra)) for r in got} == {(1, None, b"\x01" * 1000), (7, "no such slice", None)}


def test_asked_slices_that_are_not_there(spark, folder):
    asks = [(str(folder / "sub/b.oct"), 8), (str(folder / "sub/b.oct"), 8), (str(folder / "sub/b.oct"), 9), (str(folder / "sub/b.oct"), None), (str(folder / "c.oct"), 0), (str(folder / "none.oct"), 0), (None, 1), (str(folder / "short.oct"), 0)]
    got = asked_slices(spark.createDataFrame(asks, "path string, slice int").coalesce(1)).collect()
    assert len(got) == len(asks) and sorted((r.slice, short(r.path)) for r in got if r.error is None) == [(8, "b.oct")] * 2
    errors = {(short(r.path) if r.path else None, r.slice): r.error for r in got if r.error}
    assert errors["b.oct", 9] == errors["short.oct", 0] == "no such slice" and "BadZipFile" in errors["c.oct", 0] and len(errors) == 6


def test_member_larger_than_a_cell(spark, tmp_path):
    x, z, y = 1024, 1024, 1200  # 5 GB
    path = tmp_path / "large.oct"
    with zipfile.ZipFile(Holes(path), "w") as archive:
        archive.writestr("Header.xml", HEADER.format(z=z, x=x, y=y))
        with archive.open("data/Intensity.data", "w", force_zip64=True) as member:
            zeros = bytes(4 * x * z)
            for i in range(y):
                member.write(zeros if i != y - 1 - 700 else np.full(x * z, 1_112_000_000, dtype="<i4").tobytes())
        archive.fp.file.flush()
    assert path.stat().st_size > 5 * 10**9
    rows = {r["slice"]: r for r in volume_slices(spark, str(tmp_path), slices="699-701").collect()}
    assert set(rows) == {699, 700, 701} and set(rows[700].pixels) == {127} and set(rows[701].pixels) == {0}
    assert sum(r.bytes_read for r in rows.values()) < 13 * 10**6
    parts = volume_slices(spark, str(tmp_path), columns=["slice"], range_bytes=1 << 29)
    assert parts.rdd.getNumPartitions() == 10 and parts.count() == y
    whole = archives.with_members(archives.scan_archives(spark, str(tmp_path)), ["data/*"]).first()
    assert whole.bytes is None and whole.error.startswith("member of 50")


def test_folders_that_are_none(spark, folder, tmp_path):
    error = archives.scan_reported(spark, str(folder / "a.oct")).collect()
    assert len(error) == 1 and error[0].path is None and error[0].error.startswith("Path is not a directory")
    assert volume_slices(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="does not exist"):
        volume_slices(spark, str(tmp_path / "none")).count()
    with pytest.raises(Exception, match="no such columns|PYTHON_DATA_SOURCE"):
        spark.read.format("oct_archive").schema("nonsense int").load(str(folder)).count()


@pytest.mark.parametrize("task_bytes", [1, 200, 1 << 25])
def test_stacks_along_other_axes(spark, task_bytes):
    draw = np.random.default_rng(task_bytes)
    volumes = {"a": draw.integers(0, 256, (7, 5, 9), dtype=np.uint8), "b": draw.integers(0, 256, (1, 3, 2), dtype=np.uint8)}
    schema = "volume_id string, slice int, height int, width int, pixels binary"
    rows = [(k, 2 * i, *p.shape, p.tobytes()) for k, v in volumes.items() for i, p in enumerate(v)]
    odd = [("size", 0, 2, 2, bytes(4)), ("size", 1, 2, 3, bytes(6)), ("twice", 0, 1, 1, b"x"), ("twice", 0, 1, 1, b"x"), ("short", 0, 2, 2, b"123"), ("none", 0, 1, 1, None)]
    stack = spark.createDataFrame(rows + odd, schema).repartition(3)
    for direction, axes in (("YZ", (2, 1, 0)), ("XY", (1, 0, 2))):
        got = {(r.volume_id, r["slice"]): np.frombuffer(r.pixels, dtype=np.uint8).reshape(r.height, r.width) for r in resliced_stack(stack, direction, task_bytes).collect()}
        want = {(k, i): p for k, v in volumes.items() for i, p in enumerate(v.transpose(axes))}
        assert set(got) == set(want) and all((got[k] == want[k]).all() for k in want)
    assert resliced_stack(stack, "XZ").count() == len(rows) + len(odd) and resliced_stack(stack.limit(0), "YZ").count() == 0


def test_tiles_are_what_is_shuffled(spark):
    stack = spark.range(64).select(F.lit("v").alias("volume_id"), F.col("id").cast("int").alias("slice"), F.lit(64).alias("height"), F.lit(64).alias("width"), F.unhex(F.repeat(F.lit("7f"), 4096)).alias("pixels"))
    found = resliced_stack(stack, "YZ", 64 * 64 * 16)
    assert found.count() == 64 and "posexplode" not in found._jdf.queryExecution().toString()


def test_zoomed_stacks(spark):
    picture = np.arange(12, dtype=np.uint8).reshape(3, 4)
    stack = spark.createDataFrame([("a", 0, 3, 4, picture.tobytes()), ("b", 0, 3, 4, b"1")], "volume_id string, slice int, height int, width int, pixels binary")
    rows = zoomed_stack(stack, 2.0, 0.1).collect()
    assert len(rows) == 1 and (rows[0].height, rows[0].width) == (6, 1) and list(rows[0].pixels) == [0, 0, 4, 4, 8, 8]
    assert bytes(zoomed_stack(stack).first().pixels) == picture.tobytes()


def test_filters():
    wanted = Wanted(only=parse_ranges("1, 3-6"))
    assert [wanted.narrow(f) for f in (GreaterThan(("slice",), 1), LessThanOrEqual(("slice",), 5), In(("path",), ("a", "ab", "b")), StringStartsWith(("path",), "a"), StringContains(("path",), "b"), EqualTo(("height",), 3))] == [True, True, True, True, False, False]
    assert wanted.numbers(0, 100) == [3, 4, 5] and wanted.numbers(4, 5) == [4] and [wanted.has_path(p) for p in ("a", "ab", "b", "ac")] == [True, True, False, False]
