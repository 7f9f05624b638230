"""Physical units, resolutions, sizes and rounding, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Micrometers in a unit.
MICROMETERS = {"nm": 1e-3, "µm": 1.0, "um": 1.0, "micrometer": 1.0, "mm": 1e3, "millimeter": 1e3, "cm": 1e4, "centimeter": 1e4, "m": 1e6, "meter": 1e6}


def micrometers(value: Column, unit: Column) -> Column:
    """Unknown units count as micrometers; a null value stays null."""
    table = F.create_map(*[F.lit(x) for pair in MICROMETERS.items() for x in pair])
    return value * F.coalesce(F.try_element_at(table, unit), F.lit(1.0))


def unit_name(unit: Column) -> Column:
    low = F.lower(unit)
    return F.when(low.startswith("nano"), "nm").when(low.startswith("micro"), "µm").when(low.startswith("milli"), "mm").when(low.startswith("centi"), "cm").otherwise(unit)


def round_significant(v: Column, digits: int = 6) -> Column:
    """Half-even to so many significant digits; zero stays zero."""
    scale = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(v))))
    return F.when(v == 0, v).otherwise(F.rint(v * scale) / scale)


def snap_significant(v: Column, digits: int = 6) -> Column:
    """The rounded value, if it is off by less than 10 ** -digits of the value."""
    rounded = round_significant(v, digits)
    return F.when((v != 0) & (F.abs(rounded - v) < F.abs(v) * 10.0**-digits), rounded).otherwise(v)


def rational(numerator: Column, denominator: Column) -> Column:
    return F.when(numerator == denominator, numerator).otherwise(F.try_divide(numerator, denominator))


def resolution(size: Column, unit: Column) -> tuple[Column, Column]:
    """Pixels per unit, null for sizes 0 and 1, and the unit's long name (nanometers become micrometers)."""
    known = size.isNotNull() & (size != 0) & (size != 1)
    nm = unit == "nm"
    value = F.when(known, F.when(nm, 1000.0 / size).otherwise(1.0 / size))
    name = F.when(unit == "cm", "centimeter").when(unit == "mm", "millimeter").when(unit.isin("µm", "um", "nm"), "micrometer").otherwise(unit)
    return value, name


def human_bytes(n: Column) -> Column:
    """One decimal, half-even, and B, KB, MB, GB or TB; 1024 itself stays in the smaller unit."""
    out = None
    for k, suffix in enumerate(("", "K", "M", "G")):
        text = F.format_string(f"%.1f{suffix}B", F.bround(n / float(1024**k), 1))
        out = F.when(n <= 1024.0 ** (k + 1), text) if out is None else out.when(n <= 1024.0 ** (k + 1), text)
    return out.otherwise(F.format_string("%.1fTB", F.bround(n / float(1024**4), 1)))


def level_scale(size_um: Column, scale: Column, axis: str) -> Column:
    """A level's pixel size: x and y grow with 1 / scale, other axes don't; 0 counts as 1."""
    value = size_um / scale if axis in "xy" else size_um
    return F.when(value == 0, 1.0).otherwise(value)


def level_translation(translation_um: Column, size_um: Column, scale: Column, axis: str) -> Column:
    """A level's origin: coarser pixels have their centre further in."""
    return translation_um + (1.0 / scale - 1.0) * size_um / 2.0 if axis in "xy" else translation_um


def degrees(value: Column, unit: Column) -> Column:
    return F.when(F.lower(unit).startswith("rad"), F.degrees(value)).otherwise(value)


def rotation(text: Column) -> Column:
    """Degrees out of "angle: v unit", "angle=v unit" or "angle v unit"."""
    pattern = r"(?i)angle\s*[:=]?\s*(-?[0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)"
    return degrees(F.regexp_extract(text, pattern, 1).try_cast("double"), F.regexp_extract(text, pattern, 2))


def physical_size(size: Column, pixel_size: Column) -> Column:
    """Sizes in pixels times pixel sizes, axis by axis, as far as both go."""
    n = F.least(F.size(size), F.size(pixel_size))
    return F.zip_with(F.slice(size, F.lit(1), n), F.slice(pixel_size, F.lit(1), n), lambda s, p: s * p)


def chosen_pixel_size(given: Column, found: Column) -> Column:
    """The pixel size that counts: one that is given and positive, else the file's, else 1."""
    return F.coalesce(F.when(given > 0, given), F.when(found > 0, found), F.lit(1.0))
