"""Archives, stacks, configurations, sinks and streams on files made here."""

import json
import zipfile
import zlib
from datetime import datetime
from struct import pack

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators.spectral import reconstruct
from lamella.sources import archives, files, sinks
from lamella.streaming.measurements import arriving_archives, arriving_items, folded, progress, save_points, streamed_cells, streamed_saves, surviving, undo_history

HEADER = """<?xml version="1.0" encoding="utf-8"?>
<Ocity><Image Type="{kind}"/><SizeReal>1.8
4.8
5.4</SizeReal><SizePixel>{z}
{x}
{y}</SizePixel><PixelSpacing>0.004
0.01
0.05</PixelSpacing><Study>Molar Series</Study><ExperimentNumber>7</ExperimentNumber><SpectrometerElements>1024</SpectrometerElements>
<IntensityAveraging><AScans>2</AScans></IntensityAveraging><BinaryToElectronCountScaling>1.0</BinaryToElectronCountScaling><Model>M</Model><Serial>SN-0817</Serial>
<Probe>P</Probe><CentralWavelength>1310.2</CentralWavelength><DevicePresetDescription>Slow (50 kHz steady)</DevicePresetDescription><Timestamp>1719835200</Timestamp><ScanTime>3.5</ScanTime><OriginalSoftwareVer>6.1</OriginalSoftwareVer>
<DataFiles><DataFile Type="RawSpectral" ApoRegionEnd0="48" ScanRegionStart0="8" ScanRegionEnd0="408"/><DataFile Type="Colored" SizeZ="2" SizeX="2"/></DataFiles></Ocity>"""
BAD = """<Ocity><Image Type="RawSpectra"/><SizeReal>1.5
3.5</SizeReal><SizePixel>x</SizePixel><Timestamp>some day</Timestamp><DataFiles><DataFile ApoRegionEnd0="32" ScanRegionStart0="16" ScanRegionEnd0="272"/></DataFiles></Ocity>"""


def archive(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)


def png(path, grey):
    chunk = lambda kind, data: pack(">I", len(data)) + kind + data + pack(">I", zlib.crc32(kind + data))
    h, w = grey.shape
    raw = b"".join(b"\0" + row.tobytes() for row in grey)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("archives")
    stored = np.full((1, 2, 2), 1112000000, dtype="<i4")
    archive(root / "a.oct", {"Header.xml": HEADER.format(kind="RawSpectraAndProcessedIntensity", z=2, x=2, y=1), "data/Intensity.data": stored.tobytes(), "data/VideoImage.data": pack("<IIII", *[0xFF0A141E] * 4)})
    (root / "sub").mkdir()
    archive(root / "sub" / "b.oct", {"Header.xml": BAD})
    (root / "sub" / "c.oct").write_bytes(b"not a zip")
    (root / "note.txt").write_text("x")
    return root


def read(spark, folder, members):
    return archives.with_members(spark.read.format("binaryFile").option("pathGlobFilter", "*.oct").option("recursiveFileLookup", True).load(str(folder)), members)


def test_scan_and_headers(spark, folder):
    assert [r.path.rsplit("/", 1)[1] for r in archives.scan_archives(spark, str(folder)).collect()] == ["a.oct", "b.oct", "c.oct"]
    assert archives.scan_archives(spark, str(folder), recursive=False).count() == 1
    members = read(spark, folder, ["Header.xml"])
    assert members.where("error is not null").count() == 1
    found = {r.path.rsplit("/", 1)[1]: r for r in archives.read_headers(members.where("error is null")).collect()}
    a, b = found["a.oct"], found["b.oct"]
    assert (a.dim_x, a.dim_y, a.dim_z, a.mm_y, a.n_apo, a.n_scans, a.n_average, a.study, a.wavelength) == (2, 1, 2, 5.4, 48, 400, 2, "Molar_Series", "1310")
    assert (a.resize_x, a.sensitivity, a.acquired, a.pixel_size_z, a.is_3d, a.video_z) == (2.5, "50 kHz", "2024-07-01 12:00:00", 4.8, False, 2)
    assert (b.mm_y, b.n_average, b.acquired, b.n_apo, b.n_scans, b.is_3d, b.dim_x, b.sensitivity) == (None, 1, "Unknown", 32, 256, False, 1, archives.NO_RATE)
    small = {r.path.rsplit("/", 1)[1]: r for r in archives.discover_headers(members.where("error is null")).collect()}
    assert (small["a.oct"].serial, small["a.oct"].dim_z, small["b.oct"].serial, small["b.oct"].dim_y) == ("SN-0817", 2, None, 1)


def test_processed_slices_and_video(spark, folder):
    headers = archives.read_headers(read(spark, folder, ["Header.xml"]).where("error is null"))
    s = archives.processed_slices(read(spark, folder, [archives.INTENSITY]), headers).collect()
    assert len(s) == 1 and set(s[0].pixels) == {127} and (s[0].height, s[0].width) == (2, 2)
    v = archives.video_pixels(read(spark, folder, [archives.VIDEO]), headers).collect()
    assert len(v) == 4 and {(r.r, r.g, r.b) for r in v} == {(10, 20, 30)}


def test_processed_order(spark, tmp_path):
    values = np.arange(2 * 3 * 4).reshape(2, 3, 4)
    archive(tmp_path / "v.oct", {"Header.xml": HEADER.format(kind="Processed", z=4, x=3, y=2), "data/Intensity.data": (1105000000 + values * 500000).astype("<i4").tobytes()})
    headers = archives.read_headers(read(spark, tmp_path, ["Header.xml"]))
    got = {r.slice: np.frombuffer(bytes(r.pixels), np.uint8).reshape(r.height, r.width) for r in archives.processed_slices(read(spark, tmp_path, [archives.INTENSITY]), headers, 20, 80).collect()}
    want = np.trunc(255 * np.clip(values * 500000 / 14000000, 0, 1))
    for s in range(2):
        assert np.array_equal(got[s], want[1 - s].T)


def test_spectral_slices(spark, tmp_path):
    draw = np.random.default_rng(1)
    spectra = draw.integers(500, 1500, (2, 52, 64)).astype("<i2")
    members = {"Header.xml": HEADER.format(kind="RawSpectra", z=32, x=4, y=2), archives.CHIRP: np.arange(64, dtype="<f4").tobytes(), archives.OFFSETS: np.zeros(64, dtype="<f4").tobytes()}
    archive(tmp_path / "r.oct", members | {archives.SPECTRAL % i: spectra[i].tobytes() for i in range(2)})
    headers = archives.read_headers(read(spark, tmp_path, ["Header.xml"]))
    rows = archives.spectral_slices(read(spark, tmp_path, ["data/*.data"]), headers)
    got = reconstruct(rows).collect()
    assert {(r.slice, r.height, r.width) for r in got} == {(0, 32, 2), (1, 32, 2)}
    some = spark.createDataFrame([(got[0].volume_id, 1)], "volume_id string, slice int")
    assert [r.slice for r in reconstruct(archives.spectral_slices(read(spark, tmp_path, ["data/*.data"]), headers, some)).collect()] == [1]


def test_stacks_and_pictures(spark, tmp_path):
    for name in ("s/slice_2.png", "s/slice_10.png", "s/slice_1.png", "s/Annotations/x.png", "t/s/a.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        png(tmp_path / name, np.arange(6, dtype=np.uint8).reshape(2, 3))
    stacks = files.image_stacks(spark, str(tmp_path))
    got = sorted((r.folder.rsplit("/", 1)[1], r.path.rsplit("/", 1)[1], r.slice, r.duplicate) for r in stacks.collect())
    assert got == [("s", "a.png", 0, True), ("s", "slice_1.png", 0, True), ("s", "slice_10.png", 2, True), ("s", "slice_2.png", 1, True)]
    assert [r.path.rsplit("/", 1)[1] for r in files.image_list(spark, str(tmp_path / "s")).orderBy("slice").collect()] == ["slice_1.png", "slice_2.png", "slice_10.png"]
    pictures = files.image_slices(spark, stacks, str(tmp_path)).collect()
    assert len(pictures) == 4 and all(bytes(r.pixels) == bytes(range(6)) and (r.height, r.width) == (2, 3) for r in pictures)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("10-50", {("XZ", 10, 50, 41, 1.0)}), ("1-100", {("XZ", 1, 100, 100, 1.0)}), ("YZ:20-80:15", {("YZ", 20, 80, 15, 1.0)}), ("xy:25-90:30:1.33", {("XY", 25, 90, 30, 1.33)}),
        ("10-50\n\n# note\nYZ:1-4:2", {("XZ", 10, 50, 41, 1.0), ("YZ", 1, 4, 2, 1.0)}), ("5-9:3\n6-9", {("XZ", 6, 9, 4, 1.0)}), ("5-9:1.33", {("XZ", 5, 9, 5, 1.33)}),
        ("1:2:3:4:5:6", None), ("10-50\nbad", None), ("9-5", None), ("33-444\n25", None),
    ],
)
def test_sidecars(spark, tmp_path, text, want):
    (tmp_path / "a.txt").write_text(text)
    got = files.read_sidecars(spark, str(tmp_path / "*.txt")).collect()
    if want is None:
        assert len(got) == 1 and got[0].error.startswith("Unrecognized format") and got[0].view is None
    else:
        assert {(r.view, r.start, r.end, r.n, r["index"]) for r in got} == want and all(r.error is None for r in got)


def test_archives_without_sidecar_take_all_slices(spark):
    headers = spark.createDataFrame([("/d/a.oct", 7), ("/d/b.oct", 9)], "path string, dim_y int")
    sidecars = spark.createDataFrame([("/d/b.txt", "YZ", 2, 5, 3, 1.5, None)], "file_path string, view string, start int, end int, n int, index double, error string")
    got = {r.path: (r.view, r.start, r.end, r.n, r["index"]) for r in files.archives_with_sidecars(headers, sidecars).collect()}
    assert got == {"/d/a.oct": ("XZ", 1, 7, 7, 1.0), "/d/b.oct": ("YZ", 2, 5, 3, 1.5)}


def test_config_round_trip(spark):
    old = {"specimen_id": "a", "regions": {"0": {"start_point": [5, 10], "end_point": [35, 10]}}, "air": {"3": {"point1": [1, 2]}}}
    configs = spark.createDataFrame([("p", json.dumps(old)), ("q", "broken")], "path string, json string")
    r = files.config_regions(configs).collect()
    assert len(r) == 1 and r[0].lesion_start == (5, 10) and r[0].specimen_end == (35, 10) and r[0].buffer == 10 and not r[0].is_keyframe
    regions = files.config_regions(configs).withColumn("specimen_id", F.lit("a"))
    air = files.config_air(configs).withColumn("specimen_id", F.lit("a"))
    results = spark.createDataFrame([("a", 0, float("nan"), 2.0)], "specimen_id string, slice int, mean double, median double")
    document = sinks.config_json(regions, air, results).first().json
    back = json.loads(document)
    assert back["regions"]["0"]["tooth_end"] == [35, 10] and back["air"]["3"]["point1"] == [1, 2] and "mean" not in back["annotations"]["0"]
    again = spark.createDataFrame([("p", document)], "path string, json string")
    assert files.config_regions(again).collect() == r and files.config_air(again).first().slice == 3
    assert files.stored_results(again, full=False).first().has_results and not files.stored_results(configs, full=False).first().has_results
    assert files.stored_results(again).count() == 1


def test_annotation_round_trip(spark):
    rows = spark.createDataFrame([("p", json.dumps({"slice_2": [{"id": "gap_1", "points": [[1, 2], [3.5, 4]]}]}))], "path string, json string")
    a = files.slice_annotations(rows)
    r = a.first()
    assert (r.slice, r.feature, r.mode, r.color, r.locked) == (2, "unknown", "line", "#FFFFFF", False) and r.points[1] == (3.5, 4.0)
    back = sinks.annotations_json(a, ["path"])
    assert files.slice_annotations(back).first().points == r.points


def test_column_config_and_tables(spark, tmp_path):
    columns = spark.createDataFrame([("b", "k", "a", 1, "Text", "#000000"), ("a", None, "SLICE", 0, "Boolean", "#ffffff")], "name string, keybinding string, position_after string, order int, data_type string, color string")
    document = sinks.column_config_json(columns, {"operator": "x"}).withColumn("path", F.lit("p"))
    assert [r.name for r in files.column_config(document).collect()] == ["a", "b"]
    assert files.column_config(spark.createDataFrame([("p", '{"columns": {}}')], "path string, json string")).count() == 0
    sinks.write_csv(spark.createDataFrame([("1", "15", "35", "11"), ("x", "", "", "")], "SLICE string, s string, l string, d string"), str(tmp_path / "t"))
    r = files.read_summary(files.read_results(spark, str(tmp_path / "t")), 1, 1).collect()
    assert [(x.slice, x.sound, x.lesion, x.depth) for x in r] == [(0, [15.0], [35.0], 11.0)]
    sinks.write_results({"summary": spark.createDataFrame([("a", 1)], "specimen_id string, v int")}, str(tmp_path / "r"), "op", "1")
    assert spark.read.parquet(str(tmp_path / "r/summary")).first().operator == "op"
    sinks.write_json(document.withColumn("specimen_id", F.lit("a")), str(tmp_path / "j"), ["specimen_id"])
    assert spark.read.text(str(tmp_path / "j")).count() == 1
    sinks.append_errors(spark.createDataFrame([("f", "m")], "function string, message string").withColumn("at", F.current_timestamp()), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


SPECIMENS = "specimen_id string, v int"


@pytest.mark.parametrize("kind", ["parquet", "csv", "json"])
def test_results_of_several_runs_stay_side_by_side(spark, tmp_path, kind):
    root = str(tmp_path / "results")
    table = lambda *rows: {"summary": spark.createDataFrame(rows, SPECIMENS), "long": spark.createDataFrame(rows, SPECIMENS)}
    held = lambda name: {(r.operator, r.measurement, r.specimen_id, int(r.v)) for r in sinks.read_written(spark, root, name, kind).collect()}
    sinks.write_results(table(("001", 1), ("b/c:d", 2)), root, "ann", "1", kind)
    sinks.write_results(table(("001", 3)), root, "bob", "1", kind)
    sinks.write_results(table(("001", 4)), root, "ann", "2", kind)
    first = {("ann", "1", "001", 1), ("ann", "1", "b/c:d", 2), ("bob", "1", "001", 3), ("ann", "2", "001", 4)}
    assert held("summary") == held("long") == first
    for _ in range(2):  # a run replaces its own specimens, and again gives the same
        sinks.write_results(table(("b/c:d", 5), ("b/c:d", 6), ("e", 7)), root, "ann", "1", kind)
        second = first - {("ann", "1", "b/c:d", 2)} | {("ann", "1", "b/c:d", 5), ("ann", "1", "b/c:d", 6), ("ann", "1", "e", 7)}
        assert held("summary") == held("long") == second
    # the second table fails: neither is touched, nothing is left beside them
    broken = table(("001", 9)) | {"long": spark.createDataFrame([("001", 9)], SPECIMENS).withColumn("v", F.raise_error(F.lit("no")).cast("int"))}
    with pytest.raises(Exception, match="no"):
        sinks.write_results(broken, root, "ann", "1", kind)
    assert held("summary") == held("long") == second and sorted(p.name for p in (tmp_path / "results").iterdir()) == ["long", "summary"]
    # a specimen of the run without rows loses its old ones
    sinks.write_results({"long": spark.createDataFrame([], SPECIMENS)}, root, "ann", "1", kind, spark.createDataFrame([("b/c:d",), ("e",), ("new",)], "specimen_id string"))
    assert held("summary") == second and held("long") == {r for r in second if r[:2] != ("ann", "1") or r[2] == "001"}


def test_documents_of_other_specimens_stay(spark, tmp_path):
    root = str(tmp_path / "configs")
    document = lambda *rows: spark.createDataFrame(rows, "specimen_id string, json string")
    held = lambda: {(r.specimen_id, r.value) for r in sinks.read_written(spark, root, "", "text", ["specimen_id"]).collect()}
    sinks.write_json(document(("01", "{}"), ("b", "{}")), root, ["specimen_id"])
    sinks.write_json(document(("b", '{"x": 1}'), ("c", "{}")), root, ["specimen_id"])
    assert held() == {("01", "{}"), ("b", '{"x": 1}'), ("c", "{}")}
    with pytest.raises(Exception, match="no"):
        sinks.write_json(document(("b", "{}"), ("d", "{}")).withColumn("json", F.when(F.col("specimen_id") == "d", F.raise_error(F.lit("no"))).otherwise("x")), root, ["specimen_id"])
    assert held() == {("01", "{}"), ("b", '{"x": 1}'), ("c", "{}")}


def test_results_of_a_stream_delivered_again(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    write = sinks.results_writer("summary", root, "ann", "1")

    def run(checkpoint):
        stream = spark.readStream.schema(SPECIMENS).json(str(source))
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        query.awaitTermination()

    (source / "1.json").write_text('{"specimen_id": "a", "v": 1}\n{"specimen_id": "b", "v": 2}\n')
    run("one")
    (source / "2.json").write_text('{"specimen_id": "b", "v": 3}\n')
    run("one")
    held = lambda: {(r.specimen_id, r.v) for r in sinks.read_written(spark, root, "summary").collect()}
    assert held() == {("a", 1), ("b", 3)}
    write(spark.createDataFrame([("b", 3)], SPECIMENS), 1)
    assert held() == {("a", 1), ("b", 3)}


def test_export_rows_and_report(spark):
    r = sinks.export_rows(spark.createDataFrame([(3, "tooth", 25, "XZ", "S", ".tiff", 7, 12)], "experiment int, name string, n_slices int, direction string, study string, extension string, export_index int, slice int")).first()
    assert (r.folder, r.file, r.description) == ("03_tooth_25_Slices_XZ", "tooth_3_#13_0008.tiff", "OCT Export - S")
    done = spark.createDataFrame([("a", None), ("a", "boom")], "file_path string, error string")
    plan = spark.createDataFrame([("a", 3), ("b", 2)], "file_path string, num_slices int")
    assert {tuple(x) for x in sinks.export_report(done, plan).collect()} == {("a", 1, 2, "boom"), ("b", 0, 2, None)}


def test_find_file(spark):
    f = spark.createDataFrame([("/a/x_1.json",), ("/a/tooth_2.json",), ("/a/b.csv",)], "path string")
    assert files.find_file(f, r"\.json$", "tooth").first().path == "/a/tooth_2.json"


LOG = "g int, t int, undo boolean"


def test_undo_against_a_stack(spark):
    draw = np.random.default_rng(2)
    rows = [(g, t, bool(draw.random() < 0.45)) for g in range(60) for t in range(12)]
    want = set()
    for g in range(60):
        stack = []
        for _, t, undo in rows[g * 12 : g * 12 + 12]:
            if undo:
                stack = stack[:-1]
            else:
                stack.append(t)
        want |= {(g, t) for t in stack}
    got = surviving(spark.createDataFrame(rows, LOG), ["g"], ["t"], F.col("undo"))
    assert {(r.g, r.t) for r in got.collect()} == want


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", i) for i in range(6)] + [("a", 30), ("b", 3), ("c", 100000)], "specimen string, s int").select("specimen", F.timestamp_seconds(F.col("s") + 1700000000).alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    saves = streamed_saves(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = saves.writeStream.format("memory").queryName("saves").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    want = {tuple(r) for r in save_points(rows, ["specimen"]).where("specimen <> 'c'").collect()}
    assert {tuple(r) for r in spark.table("saves").collect()} == want and len(want) == 3


def test_arrivals(spark, folder, tmp_path):
    query = arriving_archives(spark, str(folder)).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path)).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("arrived").count() == 3


def test_members_by_path(spark, folder):
    by_path = archives.with_members(archives.scan_archives(spark, str(folder)), ["Header.xml", "data/*"])
    by_bytes = read(spark, folder, ["Header.xml", "data/*"])
    rows = lambda df: sorted((r.path.rsplit("/", 1)[1], r.member or "", bytes(r.bytes or b""), r.error is None) for r in df.collect())
    assert rows(by_path) == rows(by_bytes) and len(rows(by_path)) == 5


def test_scan_reported(spark, folder, tmp_path):
    assert {r.error for r in archives.scan_reported(spark, str(folder)).collect()} == {None}
    assert archives.scan_reported(spark, str(tmp_path)).first().error.startswith("No archives found")
    missing = archives.scan_reported(spark, str(tmp_path / "none")).collect()
    assert len(missing) == 1 and missing[0].path is None and missing[0].error.startswith("Directory does not exist")


def test_header_value(spark, folder):
    values = archives.header_value(archives.read_headers(read(spark, folder, ["Header.xml"]).where("bytes is not null")), "study").collect()
    assert {(r.path.rsplit("/", 1)[1], r.value) for r in values} == {("a.oct", "Molar_Series"), ("b.oct", "")}


def test_arriving_items(spark, folder, tmp_path):
    paths = {r.path.rsplit("/", 1)[1]: r.path for r in archives.scan_archives(spark, str(folder)).collect()}
    sidecars = spark.createDataFrame([(paths["a.oct"], v, 1, 1, 1, 1.0) for v in ("XZ", "YZ")], "file_path string, view string, start int, end int, n int, index double")
    query = arriving_items(spark, str(folder), sidecars).writeStream.format("memory").queryName("items").option("checkpointLocation", str(tmp_path)).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.file_path.rsplit("/", 1)[1], r.slice_direction) for r in spark.table("items").collect()) == [("a.oct", "XZ"), ("a.oct", "YZ"), ("b.oct", "XZ")]


def test_undo_history_is_newest_first(spark):
    log = spark.createDataFrame([(1, 0, "len", "", "1.0", "f", "f_1"), (2, 4, "ok", "NO", "YES", "g", "g_2")], "timestamp int, slice int, column string, old_value string, new_value string, feature string, annotation_id string")
    assert [(r.slice, r.old_value) for r in undo_history(log).collect()] == [(5, "NO"), (1, "")]


def test_prior_runs(spark):
    listed = spark.createDataFrame([("/s/a/Data_TM_2/results.csv",), ("/s/a/Data_T_M_1/config.json",), ("/s/a/other/x.csv",)], "path string")
    assert sorted(tuple(r) for r in files.prior_runs(listed).collect()) == [("/s/a", "Data_TM_2", "TM", "2"), ("/s/a", "Data_T_M_1", "T_M", "1")]


def test_streamed_cells_follow_undo(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "specimen string, slice int, column string, ts timestamp, event_id long, data_type string, measured double, entered string, undo boolean"
    at = lambda i: datetime(2024, 1, 1, 0, 0, i)
    first = [("a", 0, "len", at(1), 1, "Continuous", 1.25, None, False), ("a", 0, "len", at(2), 2, "Continuous", 2.5, None, False), ("a", 0, "ok", at(3), 3, "Boolean", None, None, False)]
    second = [("a", 0, "len", at(4), 4, "Continuous", None, None, True), ("a", 0, "ok", at(5), 5, "Boolean", None, None, True), ("a", 0, "ok", at(6), 6, "Boolean", None, None, True)]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    cells = streamed_cells(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = cells.writeStream.outputMode("update").foreachBatch(lambda df, i: seen.append({r.column: r.value for r in df.collect()})).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query.processAllAvailable()
    query.stop()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert seen[0] == {"len": "3.75", "ok": "YES"} and seen[-1] == {"len": "1.25", "ok": None}


def test_fold_and_progress(spark):
    a = spark.createDataFrame([(1, "Continuous", 1.25, None, 1), (1, "Continuous", 2.5, None, 2), (2, "Boolean", None, None, 1), (3, "Ordinal", None, None, 1), (4, "Text", None, "x", 2), (4, "Text", None, "y", 1)], "cell int, data_type string, measured double, entered string, t int")
    assert {r.cell: r.value for r in folded(a, ["cell"], ["t"]).collect()} == {1: "3.75", 2: "YES", 3: "1", 4: "x"}
    s = spark.createDataFrame([("a", None), ("a", "bad")], "specimen_id string, error string")
    assert progress(s, spark.createDataFrame([("a", 4)], "specimen_id string, total long")).first().percent == 25
