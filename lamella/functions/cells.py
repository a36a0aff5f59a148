"""Cells of a measurement table: how each data type changes, and how values are shown."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Data types, the step of a percentage, the fallback colour, keys that stay reserved.
DATA_TYPES = ("Continuous", "Boolean", "Percentage", "Categorical", "Ordinal", "Integer", "Float", "Text")
LABEL_TYPES = ("Boolean", "Categorical", "Ordinal", "Text")
PERCENTAGE_STEP = 5
FALLBACK_RGB = (255, 255, 178)
RESERVED_KEYS = ("f", "h")


def continuous(current: Column, measured: Column) -> Column:
    """Current value (a bad one counts as 0) plus the measured one, to two decimals; a missing or bad one changes nothing."""
    new = F.coalesce(current.try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")) + F.bround(measured.try_cast("double"), 2).try_cast("decimal(18,2)")
    return F.when(measured.try_cast("double").isNull(), current).otherwise(new.cast("decimal(18,2)").cast("string"))


def toggled(current: Column) -> Column:
    """NO, 0, FALSE and nothing become YES; anything else becomes NO."""
    return F.when(F.upper(F.trim(F.coalesce(current, F.lit("")))).isin("", "NO", "0", "FALSE"), F.lit("YES")).otherwise(F.lit("NO"))


def percentage(current: Column) -> Column:
    """Five more, at most 100; a value that isn't a whole number counts as 0."""
    now = F.coalesce(F.regexp_replace(F.trim(current), "%$", "").try_cast("int"), F.lit(0))
    return F.concat(F.least(now + PERCENTAGE_STEP, F.lit(100)).cast("string"), F.lit("%"))


def counted(current: Column, first: int) -> Column:
    """One more; what isn't a whole number becomes ``first`` (0 for categories, 1 for ranks)."""
    return F.coalesce((F.trim(current).try_cast("int") + 1), F.lit(first)).cast("string")


def parsed_integer(raw: Column) -> Column:
    """A whole number, or null; a decimal point is refused."""
    return F.when(~F.trim(raw).rlike(r"\."), F.trim(raw).try_cast("long"))


def parsed_float(raw: Column) -> Column:
    """A number, with a point or a comma, or null."""
    return F.replace(F.trim(raw), F.lit(","), F.lit(".")).try_cast("double")


def parsed_text(raw: Column) -> Column:
    return F.trim(raw)


def annotation_id(label: Column, count: Column) -> Column:
    return F.concat_ws("_", label, count.cast("string"))


def feature_of(annotation: Column) -> Column:
    """What stands before the first underscore; nothing gives null."""
    return F.when(F.length(annotation) > 0, F.split_part(annotation, F.lit("_"), F.lit(1)))


def rgb(colour: Column) -> Column:
    """``[r, g, b]`` of ``#rrggbb``; anything else gives the fallback colour."""
    part = lambda i: F.conv(F.substring(colour, i, 2), 16, 10).cast("int")
    return F.when(colour.rlike("^#[0-9A-Fa-f]{6}$"), F.array(part(2), part(4), part(6))).otherwise(F.array(*[F.lit(v) for v in FALLBACK_RGB]))


def rgba(colour: Column, alpha: int = 255) -> Column:
    return F.concat(rgb(colour), F.array(F.lit(alpha)))


def hex_of(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r.cast("int"), g.cast("int"), b.cast("int"))


def luminance(colour: Column) -> Column:
    """Relative luminance by the web accessibility formula."""
    linear = F.transform(rgb(colour), lambda v: F.when(v / 255 <= 0.03928, v / 255 / 12.92).otherwise(F.pow((v / 255 + 0.055) / 1.055, F.lit(2.4))))
    return 0.2126 * F.get(linear, F.lit(0)) + 0.7152 * F.get(linear, F.lit(1)) + 0.0722 * F.get(linear, F.lit(2))


def font_colour(background: Column) -> Column:
    return F.when(luminance(background) < 0.5, F.lit("white")).otherwise(F.lit("black"))


def column_width(header: Column) -> Column:
    return F.least(F.greatest(F.lit(40), F.length(header) * 7 + 20), F.lit(250))


def natural_key(name: Column) -> Column:
    """Lower case with every run of digits padded, so that ``slice_2`` comes before ``slice_10``."""
    runs = F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(F.regexp_replace(r, "^0+(?=.)", ""), 20, "0")).otherwise(r)), "")


def run_folder(operator: Column, measurement: Column) -> Column:
    return F.concat_ws("_", F.lit("Data"), operator, measurement)


def free_keys(used: Column) -> Column:
    """Letters that are neither used nor reserved."""
    letters = F.array(*[F.lit(chr(c)) for c in range(ord("a"), ord("z") + 1)])
    return F.array_except(F.array_except(letters, used), F.array(*[F.lit(k) for k in RESERVED_KEYS]))
