"""Pixel values: element types, normalisation and conversion, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits and kind of the element types, and the Spark type that holds each (Spark has no unsigned types).
TYPES = {
    "uint8": (8, "u", "short"), "uint16": (16, "u", "int"), "uint32": (32, "u", "long"),
    "int8": (8, "i", "byte"), "int16": (16, "i", "short"), "int32": (32, "i", "int"),
    "float32": (32, "f", "float"), "float64": (64, "f", "double"),
}


def type_max(dtype: str) -> int:
    """The top of the integer range; signed types count as unsigned ones of the same width."""
    bits, kind, _ = TYPES[dtype]
    if kind == "f":
        raise ValueError(f"{dtype} has no integer range")
    return (1 << bits) - 1


def nbytes(dtype: str) -> int:
    return TYPES[dtype][0] // 8


def unsigned_type(dtype: str) -> str:
    return f"u{dtype}" if TYPES[dtype][1] == "i" else dtype


def int_to_float(v: Column, dtype: str) -> Column:
    return v.cast("double") if TYPES[dtype][1] == "f" else v / F.lit(float(type_max(dtype)))


def float_to_int(v: Column, dtype: str, source: str = "float64") -> Column:
    """Truncates; integers stay as they are."""
    return v if TYPES[source][1] != "f" else (v * F.lit(float(type_max(dtype)))).cast(TYPES[dtype][2] if dtype != "int8" else "short")


def to_unsigned(v: Column, dtype: str) -> Column:
    bits, kind, _ = TYPES[dtype]
    return F.pmod(v.cast("long") + F.lit(1 << bits - 1), F.lit(1 << bits)) if kind == "i" else v


def to_signed(v: Column, dtype: str) -> Column:
    """dtype is the unsigned source type."""
    bits, kind, _ = TYPES[dtype]
    return v.cast("long") - F.lit(1 << bits - 1) if kind == "u" else v


def convert_sign(v: Column, source: str, target: str) -> Column:
    a, b = TYPES[source][1], TYPES[target][1]
    return v if a == b or "f" in (a, b) else to_unsigned(v, source) if a == "i" else to_signed(v, source)


def normalise(v: Column, low: Column | float, high: Column | float) -> Column:
    """0 to 1 between low and high; null where both are equal."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.when(high != low, F.greatest(F.least(F.try_divide(v - low, high - low), F.lit(1.0)), F.lit(0.0)))


def flatfield(v: Column, dark: Column, bright: Column, mean: Column) -> Column:
    """Correction by a dark and a bright image; mean is that of bright - dark over the image. Null where both are equal."""
    return F.when(bright != dark, F.greatest(F.least(F.try_divide((v - dark) * mean, bright - dark), F.lit(1.0)), F.lit(0.0)))
