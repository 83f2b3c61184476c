"""Stored-path functions as column expressions. Paths come from Windows documents; the engine compares them folded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    """Components without empty ones and ``.``; both slashes separate."""
    return F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))


def normalize(path: Column) -> Column:
    """Components joined by ``/``; leading slashes vanish."""
    return F.array_join(parts(path), "/")


def lexical(path: Column) -> Column:
    """As ``normalize``, with ``..`` taking back the component before it (none is left: dropped)."""
    folded = F.aggregate(parts(path), F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))))
    return F.when(F.contains(path, F.lit("..")), F.array_join(folded, "/")).otherwise(normalize(path))


def host(path: Column) -> Column:
    """A host path without a ``file:`` scheme."""
    return F.regexp_replace(path, r"^file:/*", "/")


def above(path: Column) -> Column:
    """Text up to the last slash of a host path: cheap, and not normalised."""
    text = F.translate(path, "\\", "/")
    return F.substr(text, F.lit(1), F.length(text) - F.length(F.substring_index(text, "/", -1)))


def host_key(path: Column) -> Column:
    """Key under which absolute host paths compare: no scheme, lexical, folded."""
    return fold(lexical(host(path)))


def normalized(path: str) -> str:
    """``normalize`` of a plain string."""
    return "/".join(p for p in path.replace("\\", "/").split("/") if p not in ("", "."))


def host_text(path: str) -> str:
    """``host_key`` of a plain string: a folder from the configuration."""
    kept: list[str] = []
    for part in normalized(path.removeprefix("file:")).split("/"):
        if part == "..":
            kept = kept[:-1]
        elif part:
            kept.append(part)
    return "/".join(kept).lower()


def trim_drive(path: Column) -> Column:
    """Without a leading drive letter and slashes."""
    return F.ltrim(F.regexp_replace(path, r"^[A-Za-z]:", ""), F.lit("/\\"))


def join(base: Column, path: Column) -> Column:
    """Path below a folder, drive removed and ``..`` resolved."""
    return lexical(F.concat(base, F.lit("/"), trim_drive(path)))


def basename(path: Column) -> Column:
    """Last non-empty component."""
    return F.element_at(F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: p != ""), -1)


def source_basename(path: Column) -> Column:
    """Last component that is a name: neither ``.`` nor ``..``."""
    return F.try_element_at(F.filter(parts(path), lambda p: p != ".."), F.lit(-1))


def folder(path: Column) -> Column:
    """Normalised path without its last component."""
    p = parts(path)
    return F.array_join(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), "/")


def is_windows_absolute(path: Column) -> Column:
    """``X:\\``, ``X:/``, ``\\\\...`` or ``//...``."""
    return path.rlike(r"^([A-Za-z]:[\\/]|\\\\|//)")


def is_host_absolute(path: Column) -> Column:
    return path.startswith("/") & ~path.startswith("//")


def has_prefix(path: Column, prefix: Column) -> Column:
    """Prefix that ends at a component border."""
    return F.startswith(path, prefix) & ((F.length(path) == F.length(prefix)) | (F.substr(path, F.length(prefix) + 1, F.lit(1)) == "/") | prefix.endswith("/"))


def fold(path: Column) -> Column:
    """Key under which names compare."""
    return F.lower(path)


def has_suffix(path: Column, suffixes: tuple[str, ...]) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1)).isin(*suffixes)
