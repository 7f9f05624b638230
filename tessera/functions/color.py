"""Colours: packed signed 32-bit RGBA, lists of floats, hexadecimal RGB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_to_rgba(packed: Column) -> Column:
    """Four values from 0 to 1; alpha 0 counts as 1."""
    byte = lambda shift: F.shiftrightunsigned(packed.cast("int"), shift).bitwiseAND(F.lit(255)) / 255.0
    return F.array(byte(24), byte(16), byte(8), F.when(byte(0) == 0, 1.0).otherwise(byte(0)))


def rgba_to_int(rgba: Column) -> Column:
    byte = lambda k: (rgba[k] * 255).cast("long")
    value = byte(0) * (1 << 24) + byte(1) * (1 << 16) + byte(2) * (1 << 8) + byte(3)
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value).cast("int")


def rgba_to_hex(rgba: Column) -> Column:
    return F.concat(*[F.lpad(F.hex((rgba[k] * 255).cast("int")), 2, "0") for k in range(3)])


def hex_to_rgba(text: Column) -> Column:
    clean = F.regexp_replace(text, "^#", "")
    return F.array(*[F.conv(F.substring(clean, 2 * k + 1, 2), 16, 10).cast("double") / 255.0 for k in range(3)], F.lit(1.0))
