"""Defaults and validation of exports: every rule is a message or null, so rules add up to arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Decibel windows by data type, dispersion by serial, defaults of the settings, messages.
DB_WINDOWS = {"Processed": (20, 80), "Raw": (30, 100), "RawSpectra": (30, 100), "RawSpectraAndProcessedIntensity": (30, 100)}
DISPERSION_BY_SERIAL = {"M00427924": -100}
DEFAULT_DISPERSION = 20
DISPERSION_TYPES = ("Quadratic", "None")
DEFAULTS = {
    "resize_enabled": True, "prefer_raw": True, "advanced_filter": False, "export_format": ".tiff", "averaging": "coherent", "tukey_window_size": 0.9,
    "show_error": False, "scale_enabled": True, "scale_length_um": 500, "scale_font_size": 30, "num_equidistant_slices": 25, "db_min": 30, "db_max": 100,
    "dispersion_type": "Quadratic", "dispersion_coefficient": -100, "slice_direction": "XZ", "refractive_index": 1.0,
}
MESSAGES = {
    "db_range": "db_min (%d) must be less than db_max (%d)",
    "slice_order": "first_slice (%d) must be <= last_slice (%d)",
    "num_slices": "num_slices (%d) exceeds available range (%d)",
    "direction": "Invalid slice_direction: %s",
    "index": "refractive_index (%s) must be between 0.1 and 5.0",
    "no_path": "file_path cannot be empty",
    "one_slice": "Only 1 slice will be exported",
    "not_positive": "num_slices must be positive",
    "too_many": "The input value for 'NumSlices' [%d] is larger than the chosen export range [%d]! Please consider adapting the export range (First & Last) or the number of slices!",
    "first_low": "first_slice (%d) must be >= 1",
    "last_low": "last_slice (%d) must be >= 1",
    "last_high": "last_slice (%d) exceeds total_slices (%d)",
    "first_high": "first_slice (%d) exceeds total_slices (%d)",
    "db_min": "db_min (%d) must be between 0 and 50",
    "db_max": "db_max (%d) must be between 50 and 120",
    "narrow": "Narrow dynamic range may result in low contrast images",
    "wide": "Wide dynamic range may result in washed out images",
    "scale_length": "scale_length_um must be positive when scale is enabled",
    "scale_font": "scale_font_size must be positive when scale is enabled",
    "dispersion": "dispersion_coefficient (%d) must be between -100 and 100",
    "filter": "Advanced filter may not be effective without averaging",
    "ignored": "Dispersion coefficient is ignored when dispersion type is 'None'",
    "no_items": "No items to update",
    "without_path": "%d item(s) have no valid path",
    "missing_file": "File does not exist: %s",
    "not_a_file": "Path is not a file: %s",
    "extension": "File does not have .oct extension: %s",
    "empty_file": "File is empty",
    "small_file": "File is very small, may be corrupted",
}
DIRECTIONS = ("XZ", "YZ", "XY")


def result(errors: list[Column], warnings: list[Column] = ()) -> Column:
    """``struct(is_valid, errors, warnings)`` of message-or-null columns, in their order."""
    kept = lambda rules: F.array_compact(F.array(*rules)) if rules else F.array().cast("array<string>")
    found = kept(list(errors))
    return F.struct((F.size(found) == 0).alias("is_valid"), found.alias("errors"), kept(list(warnings)).alias("warnings"))


def when_bad(bad: Column, message: str, *values: Column) -> Column:
    """The named message, filled in, where ``bad`` is true; null counts as fine."""
    return F.when(F.coalesce(bad, F.lit(False)), F.format_string(MESSAGES[message], *values) if values else F.lit(MESSAGES[message]))


def db_window(data_type: Column) -> Column:
    """Default ``struct(db_min, db_max)`` of a data type; unknown ones count as raw."""
    low, high = (F.coalesce(*[F.when(data_type == k, F.lit(v[i])) for k, v in DB_WINDOWS.items()], F.lit(DB_WINDOWS["RawSpectra"][i])) for i in (0, 1))
    return F.struct(low.alias("db_min"), high.alias("db_max"))


def dispersion_of_serial(serial: Column) -> Column:
    return F.coalesce(*[F.when(serial == k, F.lit(v)) for k, v in DISPERSION_BY_SERIAL.items()], F.lit(DEFAULT_DISPERSION))


def dispersion_of_wavelength(nm: Column) -> Column:
    return F.when(nm >= 1400, -100).when(nm >= 1200, 20).otherwise(0)


def data_type_to_read(data_type: Column, prefer_raw: Column) -> Column:
    """Raw where there is nothing else, or both and raw is preferred; else processed."""
    return F.when((data_type == "RawSpectra") | ((data_type == "RawSpectraAndProcessedIntensity") & prefer_raw), F.lit("Raw")).otherwise(F.lit("Processed"))


def db_range_error(low: Column, high: Column) -> Column:
    return when_bad(low >= high, "db_range", low, high)


def slice_order_error(first: Column, last: Column) -> Column:
    return when_bad(first > last, "slice_order", first, last)


def num_slices_error(first: Column, last: Column, n: Column) -> Column:
    return when_bad(n > last - first + 1, "num_slices", n, last - first + 1)


def _index_error(index: Column) -> Column:
    return when_bad(~index.between(0.1, 5.0), "index", index.cast("string"))


def _without_path(path: Column) -> Column:
    return F.length(F.coalesce(path, F.lit(""))) == 0


def queue_item(first: Column, last: Column, n: Column, low: Column, high: Column, direction: Column, index: Column, path: Column) -> Column:
    """Whether an item may be exported; a single slice is a warning."""
    errors = [
        slice_order_error(first, last), db_range_error(low, high), num_slices_error(first, last, n),
        when_bad(~F.coalesce(direction, F.lit("")).isin(*DIRECTIONS), "direction", F.coalesce(direction, F.lit("None"))), _index_error(index), when_bad(_without_path(path), "no_path"),
    ]
    return result(errors, [when_bad(n == 1, "one_slice")])


def equidistant(n: Column, first: Column, last: Column) -> Column:
    """Whether so many slices fit into a range."""
    count = last - first + 1
    return result([when_bad(n <= 0, "not_positive"), when_bad((n > 0) & (n > count), "too_many", n, count)])


def slice_range(first: Column, last: Column, total: Column) -> Column:
    """Whether a range lies inside a volume."""
    return result([
        when_bad(first < 1, "first_low", first), when_bad(last < 1, "last_low", last), slice_order_error(first, last),
        when_bad(last > total, "last_high", last, total), when_bad(first > total, "first_high", first, total),
    ])


def db_limits(low: Column, high: Column) -> Column:
    """Whether a decibel window is allowed; a very narrow or wide one is a warning."""
    return result(
        [when_bad(~low.between(0, 50), "db_min", low), when_bad(~high.between(50, 120), "db_max", high), db_range_error(low, high)],
        [when_bad(high - low < 20, "narrow"), when_bad(high - low > 80, "wide")],
    )


def settings(c: dict[str, Column]) -> Column:
    """Whether the settings in ``c`` (named as in ``DEFAULTS``, and first_slice and last_slice) agree with each other."""
    scaled, quadratic = c["scale_enabled"], c["dispersion_type"] == "Quadratic"
    return result(
        [
            db_range_error(c["db_min"], c["db_max"]), slice_order_error(c["first_slice"], c["last_slice"]),
            when_bad(scaled & (c["scale_length_um"] <= 0), "scale_length"), when_bad(scaled & (c["scale_font_size"] <= 0), "scale_font"),
            when_bad(quadratic & ~c["dispersion_coefficient"].between(-100, 100), "dispersion", c["dispersion_coefficient"]), _index_error(c["refractive_index"]),
        ],
        [
            when_bad(c["advanced_filter"] & (c["averaging"] == "none"), "filter"),
            when_bad((c["dispersion_type"] == "None") & (c["dispersion_coefficient"] != 0), "ignored"),
        ],
    )


def batch_update(path: Column) -> Column:
    """Aggregate: whether all rows can be updated; no rows and rows without a path are warnings."""
    bare = F.coalesce(F.count_if(_without_path(path)), F.lit(0))
    return result([], [when_bad(F.count(F.lit(1)) == 0, "no_items"), when_bad(bare > 0, "without_path", bare)])


def file_check(path: Column, length: Column, is_file: Column) -> Column:
    """Whether a listed file is an archive; a null length means that there is no such file."""
    name = F.element_at(F.split(path, "/"), -1)
    there = length.isNotNull()
    named = F.coalesce(name.endswith(".oct"), F.lit(False))
    return result(
        [
            when_bad(~there, "missing_file", path), when_bad(there & ~is_file, "not_a_file", path), when_bad(there & is_file & ~named, "extension", name),
            when_bad(there & is_file & named & (length == 0), "empty_file"),
        ],
        [when_bad(there & is_file & named & length.between(1, 999), "small_file")],
    )


def dispersion(kind: Column, value: Column) -> Column:
    """``struct(kind, coefficient, error)``: a known kind with a whole number within 100."""
    number = value.try_cast("int")
    error = F.when(~F.coalesce(kind.isin(*DISPERSION_TYPES), F.lit(False)), F.lit("type")).when(number.isNull(), "not an integer").when(~number.between(-100, 100), "out of range")
    return F.struct(kind.alias("kind"), F.when(error.isNull(), number).alias("coefficient"), error.alias("error"))


def slice_count(first: Column, last: Column, inclusive: bool = True) -> Column:
    return last - first + (1 if inclusive else 0)


def dimension(direction: Column, x: Column, y: Column, z: Column) -> Column:
    """How many slices a volume has along a direction."""
    return F.when(direction == "XZ", y).when(direction == "YZ", x).when(direction == "XY", z)


def dpi(pixels: Column, millimetres: Column) -> Column:
    """Pixels a millimetre as a whole number, half to even; 72 where the size is missing."""
    return F.when(millimetres > 0, F.bround(pixels / millimetres)).otherwise(F.lit(72.0)).cast("int")


def scale_bar(length_um: Column, width: Column, height: Column, direction: Column, mm_x: Column, mm_y: Column, margin: int = 90) -> Column:
    """``struct(length, x, y)`` of a scale bar in pixels, at the lower right."""
    mm = F.when(direction == "YZ", mm_y).otherwise(mm_x)
    length = F.bround(length_um / (mm * 1000 / width)).cast("int")
    return F.struct(length.alias("length"), (width - length - margin).cast("int").alias("x"), (height - margin).cast("int").alias("y"))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, done / total * 100).otherwise(F.lit(0.0))


def clamped(index: Column, step: Column, total: Column) -> Column:
    """The slice reached by a step, inside the stack."""
    return F.greatest(F.lit(0), F.least(index + step, total - 1))


def middle(total: Column) -> Column:
    return F.floor(total / 2).cast("int")


def with_defaults(row: dict[str, Column]) -> dict[str, Column]:
    """Settings with their defaults where they are missing."""
    unknown = set(row) - set(DEFAULTS)
    if unknown:
        raise KeyError(f"unknown settings: {sorted(unknown)}")
    return {k: F.coalesce(row[k], F.lit(v)) if k in row else F.lit(v) for k, v in DEFAULTS.items()}


def buffered(lesion_start: Column, lesion_end: Column, buffer: Column) -> dict[str, Column]:
    """Bounds of the lesion and of the sound parts beside it, a buffer apart."""
    return {"lesion_from": lesion_start + buffer, "lesion_to": lesion_end - buffer, "sound_left_to": lesion_start - buffer, "sound_right_from": lesion_end + buffer}


def ordered_points(points: Column) -> Column:
    """Four clicked points by x, of equal ones the earlier click first, as a struct of the four places."""
    staged = F.transform(points, lambda p, i: F.struct(p["x"].alias("x"), i.alias("i"), p["y"].alias("y")))
    placed = F.transform(F.array_sort(staged), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return F.struct(*[F.get(placed, F.lit(i)).alias(n) for i, n in enumerate(("specimen_start", "lesion_start", "lesion_end", "specimen_end"))])


def rectangle(a: Column, b: Column) -> Column:
    """Two corners as top left and bottom right."""
    corner = lambda f: F.struct(f(a["x"], b["x"]).alias("x"), f(a["y"], b["y"]).alias("y"))
    return F.struct(corner(F.least).alias("top_left"), corner(F.greatest).alias("bottom_right"))
