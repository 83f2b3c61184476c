"""Value functions: states, strict parsing, token lists, fixed code tables, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values of the document format ------------------------------------
UNIT_SYSTEM = {1: "cgs", 2: "mks", 3: "ips", 4: "mmgs", 5: "custom"}
LENGTH_UNIT = {0: "millimeter", 1: "centimeter", 2: "meter", 3: "inch", 4: "foot", 5: "feet_inches", 6: "angstrom", 7: "nanometer", 8: "micron", 9: "mil", 10: "microinch"}
ANGLE_UNIT = {0: "degrees", 1: "degrees_minutes", 2: "degrees_minutes_seconds", 3: "radians"}
MASS_UNIT = {0: "milligram", 1: "gram", 2: "kilogram", 3: "pound"}
VOLUME_UNIT = {
    0: "cubic_angstrom", 1: "cubic_nanometer", 2: "cubic_micron", 3: "cubic_millimeter", 4: "cubic_centimeter", 5: "cubic_meter", 6: "cubic_microinch", 7: "cubic_mil",
    8: "cubic_inch", 9: "cubic_foot",
}
PAPER_SIZE = {
    0: "a_size", 1: "a_size_vertical", 2: "b_size", 3: "c_size", 4: "d_size", 5: "e_size", 6: "a4", 7: "a4_vertical", 8: "a3", 9: "a2", 10: "a1", 11: "a0", 12: "user_defined",
}
TRUE_SPELLINGS = ("yes", "true", "1")
FALSE_SPELLINGS = ("no", "false", "0")
# ------------------------------------------------------------------------------


def enum_name(code: Column, table: dict[int, str]) -> Column:
    """Name of a code; unknown codes have none."""
    out = F.lit(None).cast("string")
    for value, name in table.items():
        out = F.when(code == value, name).otherwise(out)
    return out


def paper_size(code: Column) -> Column:
    return enum_name(code, PAPER_SIZE)


def tristate(text: Column) -> Column:
    """true, false, or null for any other spelling."""
    low = F.lower(F.trim(text))
    return F.when(low.isin(*TRUE_SPELLINGS), True).when(low.isin(*FALSE_SPELLINGS), False)


def strict_integer(text: Column) -> Column:
    """A whole signed decimal number in 64 bits; no blanks."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def trimmed_integer(text: Column) -> Column:
    return strict_integer(F.trim(text))


def decimal_token(text: Column) -> Column:
    """Is a finite number; the token itself is kept as text."""
    number = text.try_cast("double")
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))


def tokens(text: Column, size: int) -> Column:
    """``size`` finite decimals between blanks, or null."""
    found = F.split(F.trim(text), r"\s+")
    return F.when((F.size(found) == size) & F.forall(found, decimal_token), found)


def mass_properties(text: Column) -> Column:
    """At least 12 decimals: centre 3, volume, area, mass, moments 3 and 3, and the rest."""
    found = F.transform(F.split(text, ","), lambda x: F.trim(x))
    fields = F.struct(
        F.slice(found, 1, 3).alias("center_of_mass"), F.element_at(found, 4).alias("volume"), F.element_at(found, 5).alias("area"), F.element_at(found, 6).alias("mass"),
        F.slice(found, 7, 3).alias("moments"), F.slice(found, 10, 3).alias("products"), F.slice(found, 13, F.greatest(F.size(found) - 12, F.lit(0))).alias("rest"),
    )
    return F.when((F.size(found) >= 12) & F.forall(found, decimal_token), fields)


def value_state(value: Column, kind: Column, supported: tuple[str, ...]) -> Column:
    """missing, unsupported_type, empty or present."""
    return F.when(value.isNull() | kind.isNull(), "missing").when(~kind.isin(*supported), "unsupported_type").when(value == "", "empty").otherwise("present")


def packed_rgba(packed: Column) -> Column:
    """Red, green, blue and alpha (0 to 1) of a packed colour, red lowest; saved colours are opaque."""
    byte = lambda k: F.shiftrightunsigned(packed.cast("long"), k).bitwiseAND(F.lit(255))
    return F.array(*(byte(8 * k) / 255.0 for k in range(3)), F.lit(1.0).cast("double"))


def color(face: Column, feature: Column, body: Column) -> Column:
    """The most specific colour."""
    return F.coalesce(face, feature, body)


def occurrence_leaf(path: Column) -> Column:
    """``name-n`` of an occurrence ``name-n@owner``; null where there is no number."""
    leaf = F.regexp_extract(path, r"^([^@]*-[0-9]+)@", 1)
    return F.when(leaf != "", leaf)


def chord_segments(radius: Column, sweep: Column, tolerance: float, most: int = 512) -> Column:
    """Segments that keep an arc's chords within ``tolerance``."""
    step = F.least(2 * F.acos(F.greatest(F.lit(-1.0), 1 - F.lit(tolerance) / radius)), F.lit(3.141592653589793 / 2))
    return F.least(F.greatest(F.ceil(F.abs(sweep) / step), F.lit(1)), F.lit(most)).cast("int")


def within(actual: Column, expected: Column, absolute: float, relative: float) -> Column:
    return F.abs(actual - expected) <= F.greatest(F.lit(absolute), F.lit(relative) * F.abs(expected))


def vector_within(actual: Column, expected: Column, absolute: float) -> Column:
    """No component is further off than ``absolute``; null if the lengths differ."""
    apart = F.zip_with(actual, expected, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.when(F.size(actual) == F.size(expected), F.array_max(apart) <= absolute)
