"""Numbers in binary columns, checked sums, and checks of labels and schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unsigned(data: Column, offset: int, size: int, little: bool = True) -> Column:
    """Unsigned number of 1 to 7 bytes at an offset; null if the bytes aren't there."""
    if not 1 <= size <= 7:
        raise ValueError("size must be 1 to 7 bytes; keep 8-byte values as text")
    total = F.lit(0).cast("long")
    for i in range(size):
        place = offset + (i if little else size - 1 - i)
        total = total + F.shiftleft(F.conv(F.hex(F.substring(data, place + 1, 1)), 16, 10).cast("long"), 8 * i)
    return F.when(F.octet_length(data) >= offset + size, total)


def unsigned_text(data: Column, offset: int) -> Column:
    """8-byte little-endian number as decimal text, as it may pass 2 ** 63."""
    digits = F.concat(*(F.hex(F.substring(data, offset + 8 - i, 1)) for i in range(8)))
    return F.when(F.octet_length(data) >= offset + 8, F.conv(digits, 16, 10))


def checked_end(*lengths: Column) -> Column:
    """Sum of lengths; null where it doesn't fit."""
    out = lengths[0].cast("long")
    for x in lengths[1:]:
        out = F.try_add(out, x.cast("long"))
    return out


def label_fault(label: Column) -> Column:
    """Why a label cannot name a file of a closure: blank, absolute, or leaving its folder; null if it can."""
    slashed = F.translate(label, "\\", "/")
    return (
        F.when(label.isNull() | (F.trim(label) == ""), "blank").when(slashed.rlike("^(/|[A-Za-z]:)"), "absolute")
        .when(F.exists(F.split(slashed, "/"), lambda p: p == ".."), "leaves_folder").when(F.exists(F.split(slashed, "/"), lambda p: p.isin("", ".")), "not_normal")
    )


def path_fields(df: DataFrame, words: tuple[str, ...] = ("host_path", "absolute_path")) -> list[str]:
    """Columns, at any depth, that would tell paths of the host."""
    found: list[str] = []

    def walk(kind: T.DataType, name: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                inner = f"{name}.{f.name}" if name else f.name
                if f.name.lower() in words:
                    found.append(inner)
                walk(f.dataType, inner)
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, f"{name}[]")
        elif isinstance(kind, T.MapType):
            walk(kind.valueType, f"{name}{{}}")

    walk(df.schema, "")
    return found
