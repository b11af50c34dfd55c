"""Column functions: vectors of three, rounding, interpolation, redaction.

A vector is a tuple of three columns (x, y, z); results stay inside whole-stage code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(x, y, z) -> Vec:
    return tuple(v if isinstance(v, Column) else F.lit(float(v)) for v in (x, y, z))


def struct_vec(column: Column) -> Vec:
    return column["x"], column["y"], column["z"]


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def scale(a: Vec, s) -> Vec:
    return tuple(p * s for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Vec) -> Vec:
    """Fails on vectors shorter than 1e-9 and on components that are not finite."""
    size = length(a)
    checked = F.when((size >= 1e-9) & (size < float("inf")), size).otherwise(F.raise_error(F.lit("cannot normalize this vector")).cast("double"))
    return tuple(p / checked for p in a)


def distance(a: Vec, b: Vec) -> Column:
    return length(sub(a, b))


def angle_between(a: Vec, b: Vec) -> Column:
    """Radians; opposite directions are pi apart."""
    c = dot(a, b) / (length(a) * length(b))
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)))


def round_half_up(x: Column) -> Column:
    """Halves go towards plus infinity."""
    return F.floor(x + 0.5)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def redact(message: Column) -> Column:
    """Unique identifiers of DICOM objects masked."""
    return F.regexp_replace(message, r"\b\d+(?:\.\d+){2,}\b", "[redacted-uid]")


def redact_details(details: Column) -> Column:
    return F.transform_values(details, lambda _, v: redact(v))


def numbers(text: Column) -> Column:
    """Backslash-separated decimal strings as doubles; what is no number is null."""
    return F.transform(F.split(text, r"\\"), lambda s: F.trim(s).try_cast("double"))


def points(flat: Column) -> Column:
    """x, y, z triples of a flat array; other lengths fail."""
    n = F.size(flat)
    good = F.when(n % 3 == 0, (n / 3).cast("int")).otherwise(F.raise_error(F.lit("contour data is not a list of triples")).cast("int"))
    at = lambda i, j: F.element_at(flat, (i * 3 + (j + 1)).cast("int"))
    every = F.when(good > 0, F.sequence(F.lit(0), good - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(every, lambda i: F.struct(at(i, 0).alias("x"), at(i, 1).alias("y"), at(i, 2).alias("z")))


def fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)


def quantised(value: Column, maximum: int, unit: bool = True) -> Column:
    """Stored value of a fraction (``unit``) or of a raw value, rounded half up and clamped."""
    return F.least(F.greatest(round_half_up(value * maximum if unit else value), F.lit(0)), F.lit(maximum)).cast("int")
