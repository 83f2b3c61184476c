"""Binary streams: property sets, previews, sheet names, configuration headers."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame

# ---- fixed values of the formats ----------------------------------------------
SUMMARY = bytes.fromhex("e0859ff2f94f6810ab9108002b27b3d9")
DOCUMENT_SUMMARY = bytes.fromhex("02d5cdd59c2e1b10939708002b2cf9ae")
USER_DEFINED = bytes.fromhex("05d5cdd59c2e1b10939708002b2cf9ae")
FORMATS = {SUMMARY: "summary_information", DOCUMENT_SUMMARY: "document_summary_information", USER_DEFINED: "user_defined_properties"}
SUMMARY_NAMES = {
    1: "CodePage", 2: "Title", 3: "Subject", 4: "Author", 5: "Keywords", 6: "Comments", 7: "Template", 8: "LastAuthor", 9: "RevisionNumber", 10: "EditTime", 11: "LastPrintedTime", 12: "CreatedTime", 13: "LastSavedTime",
    14: "PageCount", 15: "WordCount", 16: "CharacterCount", 17: "Thumbnail", 18: "ApplicationName", 19: "DocumentSecurity",
}
DOCUMENT_NAMES = {
    1: "CodePage", 2: "Category", 3: "PresentationTarget", 4: "ByteCount", 5: "LineCount", 6: "ParagraphCount", 7: "SlideCount", 8: "NoteCount", 9: "HiddenSlideCount", 10: "MultimediaClipCount", 11: "ScaleCrop", 14: "Manager", 15: "Company",
    16: "LinksDirty", 17: "CharacterCountWithSpaces", 19: "SharedDocument", 20: "LinkBase", 22: "HyperlinksChanged", 23: "ApplicationVersion", 26: "ContentType", 27: "ContentStatus", 28: "Language", 29: "DocumentVersion",
}
TYPES = {
    0: "VT_EMPTY", 1: "VT_NULL", 2: "VT_I2", 3: "VT_I4", 4: "VT_R4", 5: "VT_R8", 8: "VT_BSTR", 11: "VT_BOOL", 16: "VT_I1", 17: "VT_UI1", 18: "VT_UI2", 19: "VT_UI4", 20: "VT_I8", 21: "VT_UI8", 22: "VT_INT", 23: "VT_UINT", 30: "VT_LPSTR",
    31: "VT_LPWSTR", 64: "VT_FILETIME", 65: "VT_BLOB", 71: "VT_CF",
}
NUMBERS = {2: "<h", 3: "<i", 4: "<f", 5: "<d", 16: "<b", 17: "<B", 18: "<H", 19: "<I", 20: "<q", 21: "<Q", 22: "<i", 23: "<I", 64: "<Q"}
CODE_PAGES = {65001: "utf-8", 1200: "utf-16-le", 1250: "cp1250", 1251: "cp1251", 1252: "cp1252", 1253: "cp1253", 1254: "cp1254", 932: "cp932", 936: "cp936", 949: "cp949", 950: "cp950", 10000: "mac_roman"}
PNG_SIGNATURE = bytes.fromhex("89504e470d0a1a0a")
# ---------------------------------------------------------------------------------


def _text(raw: bytes, page: int) -> str | None:
    codec = CODE_PAGES.get(page)
    if codec is None:
        return None
    try:
        return raw.decode(codec).rstrip("\0")
    except UnicodeDecodeError:
        return None


def typed_value(raw: bytes, at: int, end: int, page: int) -> tuple[str, str | None, str]:
    """(type name, value as text, state); values of other types are kept as hex."""
    kind = struct.unpack_from("<I", raw, at)[0]
    name, body = TYPES.get(kind & 0xFFFF, f"0x{kind & 0xFFFF:04x}"), raw[at + 4 : end]
    if kind in (0, 1):
        return name, None, "missing"
    if kind == 11 and len(body) >= 2:
        return name, "true" if struct.unpack_from("<H", body)[0] else "false", "present"
    if kind in NUMBERS and len(body) >= struct.calcsize(NUMBERS[kind]):
        return name, str(struct.unpack_from(NUMBERS[kind], body)[0]), "present"
    if kind in (8, 30, 31) and len(body) >= 4:
        size = struct.unpack_from("<I", body)[0] * (2 if kind == 31 else 1)
        if 4 + size > len(body):
            return name, body.hex(), "malformed"
        value = _text(body[4 : 4 + size], 1200 if kind == 31 else page)
        return (name, value, "present" if value else "empty") if value is not None else (name, body[4 : 4 + size].hex(), "unsupported_type")
    return name, body.hex(), "unsupported_type" if kind not in NUMBERS else "malformed"


def property_set(raw: bytes) -> list[tuple[str, int, str, str, str | None, str]]:
    """(set, id, name, type, value, state) of all sections; raises ValueError on a broken frame."""
    if len(raw) < 28 or raw[:2] != b"\xfe\xff":
        raise ValueError("property_set_header")
    if struct.unpack_from("<H", raw, 2)[0] > 1:
        raise ValueError("property_set_version")
    count = struct.unpack_from("<I", raw, 24)[0]
    if 28 + 20 * count > len(raw):
        raise ValueError("property_set_header")
    out = []
    for s in range(count):
        kind = raw[28 + 20 * s : 44 + 20 * s]
        start = struct.unpack_from("<I", raw, 44 + 20 * s)[0]
        if start + 8 > len(raw):
            raise ValueError("property_set_section")
        size, n = struct.unpack_from("<2I", raw, start)
        if start + size > len(raw) or 8 + 8 * n > size:
            raise ValueError("property_set_section")
        table = [struct.unpack_from("<2I", raw, start + 8 + 8 * i) for i in range(n)]
        ends = sorted({o for _, o in table} | {size})
        nxt = dict(zip(ends, ends[1:], strict=False))
        if any(o + 4 > size for _, o in table):
            raise ValueError("property_set_offset")
        page = next((struct.unpack_from("<H", raw, start + o + 4)[0] for i, o in table if i == 1 and o + 6 <= size), 1252)
        names = next((_dictionary(raw, start + o, start + size, page) for i, o in table if i == 0), {})
        known = {SUMMARY: SUMMARY_NAMES, DOCUMENT_SUMMARY: DOCUMENT_NAMES, USER_DEFINED: {1: "CodePage"}}.get(kind, {})
        for i, o in table:
            if i:
                shown = known.get(i) or names.get(i) or f"PID_{i}"
                out.append((FORMATS.get(kind, "unknown"), i, shown, *typed_value(raw, start + o, start + nxt.get(o, size), page)))
    return out


def _dictionary(raw: bytes, at: int, end: int, page: int) -> dict[int, str]:
    """Names by id; two-byte names are padded to four bytes."""
    n, at, out = struct.unpack_from("<I", raw, at)[0], at + 4, {}
    for _ in range(n):
        if at + 8 > end:
            raise ValueError("property_set_dictionary")
        key, size = struct.unpack_from("<2I", raw, at)
        width = size * (2 if page == 1200 else 1)
        if at + 8 + width > end:
            raise ValueError("property_set_dictionary")
        name = _text(raw[at + 8 : at + 8 + width], page)
        if name:
            out[key] = name
        at += 8 + width
        if page == 1200:
            at += -width % 4
    return out


def property_sets(streams: DataFrame) -> DataFrame:
    """Rows of all property-set streams (doc_id, path, decoded); a broken stream gives one row with its fault as state."""

    def run(batches):
        for frame in batches:
            out = []
            for doc, path, raw in zip(frame["doc_id"], frame["path"], frame["decoded"], strict=True):
                try:
                    out += [(doc, path, *row) for row in property_set(bytes(raw))]
                except (ValueError, struct.error) as fault:
                    out.append((doc, path, None, None, None, None, None, str(fault)))
            yield pd.DataFrame(out, columns=["doc_id", "path", "set", "pid", "name", "value_type", "raw_value", "value_state"]).astype({"pid": "Int64"})

    return streams.select("doc_id", "path", "decoded").mapInPandas(run, "doc_id string, path string, set string, pid long, name string, value_type string, raw_value string, value_state string")


def check_png(raw: bytes) -> tuple[str, int | None, int | None]:
    """(state, width, height): signature, header first, each checksum, and an end chunk that is last."""
    if not raw.startswith(PNG_SIGNATURE):
        return "signature", None, None
    at, first, size = 8, True, (None, None)
    while at + 12 <= len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        if at + 12 + n > len(raw):
            return "truncated", *size
        if zlib.crc32(raw[at + 4 : at + 8 + n]) != struct.unpack_from(">I", raw, at + 8 + n)[0]:
            return "crc", *size
        if first:
            if kind != b"IHDR" or n != 13:
                return "header", None, None
            size = struct.unpack_from(">2I", raw, at + 8)
            if not all(size):
                return "header", *size
        first = False
        at += 12 + n
        if kind == b"IEND":
            return ("valid" if at == len(raw) else "trailing"), *size
    return "truncated", *size


def check_dib(raw: bytes) -> tuple[str, int | None, int | None]:
    """(state, width, height) of a device-independent bitmap without compression."""
    if len(raw) < 40:
        return "truncated", None, None
    head, width, height, planes, bits, packing, _size, _x, _y, colors, _used = struct.unpack_from("<I2i2H6I", raw, 0)
    if head < 40 or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return "header", None, None
    if packing not in (0, 3):
        return "unsupported", width, abs(height)
    table = 4 * (colors or (1 << bits if bits <= 8 else 0)) + (12 if packing == 3 and head == 40 else 0)
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    return ("valid" if head + table + rows <= len(raw) else "truncated"), width, abs(height)


def previews(streams: DataFrame) -> DataFrame:
    """State and size of preview images; the best of a document is the first valid by rank (PNG before bitmap)."""

    def run(batches):
        for frame in batches:
            out = []
            for doc, path, raw in zip(frame["doc_id"], frame["path"], frame["decoded"], strict=True):
                raw = bytes(raw)
                png = raw.startswith(PNG_SIGNATURE) or "PNG" in path
                out.append((doc, path, "png" if png else "dib", *(check_png(raw) if png else check_dib(raw)), 1 if png else 0))
            yield pd.DataFrame(out, columns=["doc_id", "path", "form", "state", "width", "height", "rank"]).astype({"width": "Int64", "height": "Int64"})

    return streams.select("doc_id", "path", "decoded").mapInPandas(run, "doc_id string, path string, form string, state string, width long, height long, rank int")


def best_preview(checked: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return checked.filter("state = 'valid'").groupBy("doc_id").agg(F.max_by("path", F.struct("rank", "path")).alias("path"))


def sheet_names(raw: bytes) -> list[str]:
    """Names of a sheet-name stream: a count, then FF FE FF, a length and UTF-16 text each; only zeros may follow."""
    if len(raw) < 2:
        raise ValueError("sheet_names_truncated")
    count, at, out = struct.unpack_from("<H", raw)[0], 2, []
    for _ in range(count):
        if raw[at : at + 3] != b"\xff\xfe\xff":
            raise ValueError("sheet_names_marker")
        if at + 4 > len(raw) or at + 4 + 2 * raw[at + 3] > len(raw):
            raise ValueError("sheet_names_truncated")
        end = at + 4 + 2 * raw[at + 3]
        out.append(raw[at + 4 : end].decode("utf-16-le"))
        at = end
    return out


def sheet_name_rows(streams: DataFrame) -> DataFrame:
    """(doc_id, ordinal, name) of sheet-name streams; a broken stream gives no rows."""

    def run(batches):
        for frame in batches:
            out = []
            for doc, raw in zip(frame["doc_id"], frame["decoded"], strict=True):
                try:
                    out += [(doc, i, name) for i, name in enumerate(sheet_names(bytes(raw)))]
                except ValueError:
                    continue
            yield pd.DataFrame(out, columns=["doc_id", "ordinal", "name"])

    return streams.select("doc_id", "decoded").mapInPandas(run, "doc_id string, ordinal int, name string")


class Archive:
    """Cursor over a serialised object stream."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise ValueError("archive_truncated")
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self, form: str) -> int:
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def begin(self, name: str) -> None:
        """A class: declared by name after FFFF, or a tag of one declared before."""
        tag = self.number("<H")
        if tag == 0xFFFF:
            self.number("<H")
            if self.take(self.number("<H")) != name.encode():
                raise ValueError("archive_class")
        elif not tag & 0x8000:
            raise ValueError("archive_class")

    def count(self) -> int:
        n = self.number("<H")
        return self.number("<I") if n == 0xFFFF else n

    def text(self) -> str:
        """Short text of one byte a sign, or UTF-16 behind FF FE FF."""
        n = self.number("<B")
        if n != 0xFF:
            return self.take(n).decode("utf-8")
        if self.take(2) != b"\xfe\xff" or (n := self.number("<B")) >= 0xFE:
            raise ValueError("archive_string")
        return self.take(2 * n).decode("utf-16-le")


def configuration_header(raw: bytes, version: int) -> list[tuple[int, str, int | None]]:
    """(index, name, parent) of a configuration header; versions 2200 and 7000 hold one record, 19000 several."""
    if version not in (2200, 7000, 19000):
        raise ValueError("archive_version")
    a, out = Archive(raw), []
    a.begin("dmConfigMgrHeader_c")
    n = a.count()
    if version != 19000 and n != 1:
        raise ValueError("archive_count")
    for _ in range(n):
        a.begin("dmConfigHeader_c")
        a.number("<I")
        name, index = a.text(), a.number("<I")
        a.number("<I")
        if a.text() != name:
            raise ValueError("archive_names_differ")
        parent = a.number("<I")
        out.append((index, name, None if parent == 0xFFFFFFFF else parent))
        if version == 19000:
            a.number("<I")
            a.text()
            a.text()
            a.take(16)
    return out


def configuration_rows(streams: DataFrame) -> DataFrame:
    """Configurations of header streams (doc_id, version, decoded); a stream outside the known layouts gives a row with its fault."""

    def run(batches):
        for frame in batches:
            out = []
            for doc, version, raw in zip(frame["doc_id"], frame["version"], frame["decoded"], strict=True):
                try:
                    out += [(doc, i, name, parent, None) for i, name, parent in configuration_header(bytes(raw), int(version))]
                except ValueError as fault:
                    out.append((doc, None, None, None, str(fault)))
            yield pd.DataFrame(out, columns=["doc_id", "configuration_index", "name", "parent_index", "fault"]).astype({"configuration_index": "Int64", "parent_index": "Int64"})

    return streams.select("doc_id", "version", "decoded").mapInPandas(run, "doc_id string, configuration_index long, name string, parent_index long, fault string")
