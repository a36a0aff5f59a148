"""Slices of archived volumes, read by byte range: a Spark data source, and slices asked for one by one."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from fnmatch import fnmatch
from math import ceil
from typing import Any
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

from lamella.sources.archives import CHIRP, HEADER, INTENSITY, OFFSETS, SPECTRAL, grey_levels, opened

#: Columns of the source, by what is read.
PROCESSED = "path string, slice int, height int, width int, pixels binary, bytes_read long"
SPECTRA = "path string, slice int, spectra binary, chirp binary, offsets binary, bytes_read long"
KINDS = {"pixels": pa.binary(), "spectra": pa.binary(), "chirp": pa.binary(), "offsets": pa.binary(), "path": pa.string(), "slice": pa.int32(), "height": pa.int32(), "width": pa.int32(), "bytes_read": pa.int64(), "error": pa.string()}


class Counted(io.RawIOBase):
    """A file that says how many bytes were read from it."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.count = file, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return self.file.seek(offset, whence)
        except pa.ArrowInvalid as e:  # what readers of files expect
            raise OSError(str(e)) from e

    def tell(self) -> int:
        return self.file.tell()

    def read(self, size: int = -1) -> bytes:
        data = self.file.read(None if size is None or size < 0 else size)
        self.count += len(data)
        return data

    def close(self) -> None:
        self.file.close()
        super().close()


class Volume:
    """An open archive: its size in pixels, and one slice of it at a time.

    Stored members are read where a slice lies; deflated ones are inflated as a stream, forwards, a slice at a time. So
    neither a member's size nor the archive's bounds what can be read, and no checksum over a whole member is tested.
    """

    def __init__(self, path: str) -> None:
        store, name = opened(path)
        self.file = Counted(store.open_input_file(name))
        self.archive = zipfile.ZipFile(self.file)
        sizes = re.findall(r"\S+", (ElementTree.fromstring(self.archive.read(HEADER)).findtext("SizePixel") or ""))  # noqa: S314
        whole = [int(s) if s.isdigit() else 1 for s in sizes] + [1, 1, 1]
        self.z, self.x, self.y = whole[:3]
        self.names = set(self.archive.namelist())
        self.stream: tuple[str, int, Any] | None = None

    @property
    def slices(self) -> int:
        return self.y

    def close(self) -> None:
        self.archive.close()
        self.file.close()

    def range(self, name: str, start: int, size: int) -> bytes:
        """``size`` bytes of a member from ``start``."""
        info = self.archive.getinfo(name)
        if info.compress_type == zipfile.ZIP_STORED and not info.flag_bits & 1:
            self.file.seek(info.header_offset)
            lengths = struct.unpack("<HH", self.file.read(30)[26:])
            self.file.seek(info.header_offset + 30 + sum(lengths) + start)
            return self.file.read(max(0, min(size, info.file_size - start)))
        if self.stream is None or self.stream[0] != name or self.stream[1] > start:
            self.stream = (name, 0, self.archive.open(name))
        _, at, member = self.stream
        while at < start:
            at += len(member.read(min(start - at, 1 << 20))) or start
        data = member.read(size)
        self.stream = (name, at + len(data), member)
        return data

    def intensities(self, number: int) -> np.ndarray | None:
        """Stored intensities of a slice as (x, z), None where the member isn't a volume of the header's size or has no such slice.

        The volume is stored from its last slice to its first, scan by scan.
        """
        one = 4 * self.x * self.z
        if INTENSITY not in self.names or self.archive.getinfo(INTENSITY).file_size != one * self.y or not 0 <= number < self.y:
            return None
        return np.frombuffer(self.range(INTENSITY, one * (self.y - 1 - number), one), dtype="<i4").reshape(self.x, self.z)

    def spectra(self, number: int) -> bytes | None:
        name = SPECTRAL % number
        return self.range(name, 0, self.archive.getinfo(name).file_size) if name in self.names else None

    def whole(self, name: str) -> bytes | None:
        return self.range(name, 0, self.archive.getinfo(name).file_size) if name in self.names else None


def _rows(volume: Volume, path: str, numbers: Sequence[int], kind: str, wanted: Sequence[str], db: tuple[float, float]) -> Iterator[dict]:
    """The rows of slices of one archive; columns that aren't wanted cost nothing."""
    shared = {n: volume.whole(m) for n, m in (("chirp", CHIRP), ("offsets", OFFSETS)) if n in wanted and kind == "spectral"}
    # deflated volumes lie from the last slice to the first
    for number in sorted(numbers, reverse=kind == "processed"):
        before = volume.file.count
        row: dict = {"path": path, "slice": number, "height": volume.z, "width": volume.x, **shared}
        if kind == "processed" and "pixels" in wanted:
            stored = volume.intensities(number)
            if stored is None:
                continue
            row["pixels"] = grey_levels(stored, *db).T.tobytes()
        elif kind == "spectral":
            if SPECTRAL % number not in volume.names:
                continue
            row["spectra"] = volume.spectra(number) if "spectra" in wanted else None
        yield row | {"bytes_read": volume.file.count - before}


def _batch(row: dict, columns: Sequence[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row.get(c)], KINDS[c]) for c in columns], list(columns))


@dataclass
class Part(InputPartition):
    """The ``part``-th of ``parts`` equal ranges of an archive's slices."""

    path: str
    part: int
    parts: int


@dataclass
class Wanted:
    """What filters and options leave of slices and paths."""

    low: int = 0
    high: int = 1 << 31
    only: set[int] | None = None
    paths: set[str] | None = None
    starts: list[str] = field(default_factory=list)

    def narrow(self, f: Filter) -> bool:
        """Take a filter in; False where it must be left to Spark."""
        name = getattr(f, "attribute", None)
        if name in (("slice",), ("path",)) and isinstance(f, IsNotNull):
            return True
        if name == ("slice",):
            if isinstance(f, EqualTo | EqualNullSafe) and f.value is not None:
                self.only = {f.value} if self.only is None else self.only & {f.value}
            elif isinstance(f, In) and None not in f.value:
                self.only = set(f.value) if self.only is None else self.only & set(f.value)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            else:
                return False
            return True
        if name == ("path",) and isinstance(f, EqualTo | In):
            values = set(f.value) if isinstance(f, In) else {f.value}
            self.paths = values if self.paths is None else self.paths & values
            return True
        if name == ("path",) and isinstance(f, StringStartsWith):
            self.starts.append(f.value)
            return True
        return False

    def has_path(self, path: str) -> bool:
        return (self.paths is None or path in self.paths) and all(path.startswith(s) for s in self.starts)

    def numbers(self, first: int, last: int) -> list[int]:
        first, last = max(first, self.low), min(last, self.high)
        return sorted(n for n in self.only if first <= n < last) if self.only is not None else list(range(first, last))


def parse_ranges(text: str) -> set[int]:
    """Numbers of a list such as ``3,7,10-20``."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        first, _, last = part.partition("-")
        out |= set(range(int(first), int(last or first) + 1))
    return out


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.root, self.pattern = options["path"], options.get("pattern", "*.oct")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.kind, self.columns = options.get("kind", "processed"), schema.names
        self.db = float(options.get("db_min", 20)), float(options.get("db_max", 80))
        self.bytes = int(options.get("range_bytes", 128 << 20))
        self.wanted = Wanted(only=parse_ranges(options["slices"]) if "slices" in options else None)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        return (f for f in filters if not self.wanted.narrow(f))

    def partitions(self) -> Sequence[InputPartition]:
        """Ranges of about ``range_bytes`` of each archive's file. Archives are listed, not opened: their slices are counted by the tasks."""
        store, root = opened(self.root)
        scheme = self.root[: len(self.root) - len(root)] if self.root.endswith(root) else ""
        info = store.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"Directory does not exist: {self.root}")
        found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(root, recursive=self.recursive))
        named = [(scheme + i.path, i.size) for i in found if i.type == pafs.FileType.File and fnmatch(i.base_name, self.pattern)]
        sized = [(p, max(1, ceil(size / self.bytes))) for p, size in sorted(named) if self.wanted.has_path(p)]
        return [Part(p, i, n) for p, n in sized for i in range(n)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        try:
            volume = Volume(partition.path)
        except Exception:  # what is no archive has no slices, as for the other readers
            return
        try:
            n = volume.slices
            numbers = self.wanted.numbers(n * partition.part // partition.parts, n * (partition.part + 1) // partition.parts)
            for row in _rows(volume, partition.path, numbers, self.kind, self.columns, self.db):
                yield _batch(row, self.columns)
        finally:
            volume.close()


class ArchiveSource(DataSource):
    """``format("oct_archive")``: the slices of all archives under a folder, a row each.

    Options: ``kind`` processed (grey slices) or spectral (raw spectra with chirp and offsets), ``pattern``, ``recursive``, ``slices`` (as
    ``3,7,10-20``), ``db_min``, ``db_max``, ``range_bytes``. A task has a range of slices of one archive and reads these alone. Give the columns
    that are wanted as ``schema``: pixels and spectra that aren't are not read. Filters on ``slice`` and ``path`` choose what is
    opened and read. ``bytes_read`` counts a slice's bytes. Files that aren't
    archives and volumes of the wrong size have no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "oct_archive"

    def schema(self) -> str:
        kind = self.options.get("kind", "processed")
        if kind not in ("processed", "spectral"):
            raise ValueError(f"kind is processed or spectral, not {kind}")
        return PROCESSED if kind == "processed" else SPECTRA

    def reader(self, schema: StructType) -> DataSourceReader:
        unknown = set(schema.names) - {c.split()[0] for c in self.schema().split(", ")}
        if unknown:
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
        return ArchiveReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make ``format("oct_archive")`` known to the session, and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)


def volume_slices(spark: SparkSession, root: str, kind: str = "processed", columns: Sequence[str] | None = None, **options: Any) -> DataFrame:
    """The slices under a folder by ``format("oct_archive")``, only ``columns`` of them, with the source's options."""
    register(spark)
    types = dict(c.split() for c in (PROCESSED if kind == "processed" else SPECTRA).split(", "))
    reader = spark.read.format("oct_archive").option("kind", kind)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.schema(", ".join(f"{c} {types[c]}" for c in columns or types)).load(root)


def asked_slices(asked: DataFrame, kind: str = "processed", db_min: float = 20, db_max: float = 80) -> DataFrame:
    """The slices that a table of ``path, slice`` asks for, a row each, with ``error`` where one can't be had.

    Rows of one archive that a task holds are read with the archive open once; only the slices' bytes are read. Repeated
    rows are answered each; null paths and slices are errors.
    """
    schema = (PROCESSED if kind == "processed" else SPECTRA) + ", error string"
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        volume, held, why = None, None, None
        for batch in batches:
            for path, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path != held:
                    if volume is not None:
                        volume.close()
                    volume, held, why = None, path, None
                    try:
                        volume = Volume(path)
                    except Exception as e:  # a bad archive is a row, not an end
                        why = f"{type(e).__name__}: {e}"
                row = None
                if volume is not None and number is not None:
                    try:
                        row = next(_rows(volume, path, [number], kind, columns, (db_min, db_max)), None)
                    except Exception as e:
                        why = f"{type(e).__name__}: {e}"
                yield _batch(row or {"path": path, "slice": number, "error": why or "no such slice"}, columns)
                why = None if volume is not None else why
        if volume is not None:
            volume.close()

    order = ["path", "slice"]
    return asked.select("path", "slice").sortWithinPartitions(order[0], asked["slice"].desc()).mapInArrow(run, schema)
