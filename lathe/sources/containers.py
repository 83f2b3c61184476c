"""Readers of the three container forms: bytes of a file to entries.

Pure Python on one file's bytes; ``entries`` runs them over a table of files,
one Arrow batch of few files at a time. Each reader collects into a ``Scan``:
entries with exact ranges, diagnostics, and the ranges it accounted for.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

from .limits import SERVICE, Limits

# ---- fixed values of the container formats -----------------------------------
CHUNK_MARKER = bytes.fromhex("140006000800")
CHUNK_OUTER, CHUNK_HEADER, DIRECTORY_PREFIX, DIRECTORY_TRAILER = 8, 26, 40, 6
COMPOUND_SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
ZLB_MAGIC = bytes.fromhex("231dd571da8148a2a85898b21b89ef99")
ZIP_LOCAL, ZIP_CENTRAL, ZIP_END, ZIP_DESCRIPTOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x07\x08"
FREE_SECTOR, END_OF_CHAIN, FAT_SECTOR, DIFAT_SECTOR = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC
# --------------------------------------------------------------------------------


class Stop(Exception):
    """A bound is passed: the scan ends with what it has."""


@dataclass
class Scan:
    data: bytes
    limits: Limits
    wanted: object = None
    entries: list[dict] = field(default_factory=list)
    notes: list[tuple[str, str, int]] = field(default_factory=list)
    used: list[tuple[int, int]] = field(default_factory=list)
    decoded: int = 0
    version: int | None = None
    fatal: bool = False
    digests: bool = True

    def note(self, code: str, severity: str, at: int) -> None:
        self.notes.append((code, severity, at))

    def add(self, kind: str, at: int, end: int, name: str | None, **more) -> None:
        stored, plain = more.pop("stored_bytes", None), more.pop("plain_bytes", None)
        entry = {
            "entry_id": f"{kind}:{at:016x}", "path": name, "kind": kind, "state": "metadata_only", "source_offset": at, "source_length": end - at, "payload_offset": None, "payload_length": None, "stored_size": 0, "decoded_size": None,
            "compression": "none", "checksum": "not_present", "expected_crc32": None, "stored_sha256": None, "decoded_sha256": None, "attributes": {}, "stored": None, "decoded": None,
        } | more
        if stored is not None and self.digests:
            entry["stored_sha256"] = hashlib.sha256(stored).hexdigest()
        if plain is not None:
            if self.digests:
                entry["decoded_sha256"] = hashlib.sha256(plain).hexdigest()
            entry["state"], self.decoded = "decoded", self.decoded + len(plain)
        if self.wanted is not None and self.wanted(entry["path"], entry["entry_id"]):
            entry["stored"], entry["decoded"] = stored, plain
        self.entries.append(entry)
        self.used.append((at, end))
        if len(self.entries) > self.limits.streams:
            self.note("limit_streams", "error", at)
            raise Stop

    def inflate(self, raw: bytes, size: int, bits: int) -> bytes | str:
        """Decoded bytes of exactly ``size``, or what is wrong; never holds more than size + 1 bytes."""
        if self.decoded + size > self.limits.decoded_bytes:
            return "limit_decoded_bytes"
        if size > self.limits.compression_ratio * max(1, len(raw)):
            return "limit_compression_ratio"
        engine = zlib.decompressobj(bits)
        try:
            out = engine.decompress(raw, size + 1)
        except zlib.error:
            return "inflate_invalid"
        return out if len(out) == size and engine.eof else "inflate_size_differs"

    def unexplained(self) -> list[tuple[int, int]]:
        """Ranges that no entry or header accounts for."""
        out, at = [], 0
        for start, end in sorted(self.used):
            if start > at:
                out.append((at, start))
            at = max(at, end)
        if at < len(self.data):
            out.append((at, len(self.data)))
        return out


def swapped_name(raw: bytes) -> str | None:
    """Names are stored with the halves of each byte exchanged; only printable ASCII counts."""
    plain = bytes((b >> 4 | b << 4) & 0xFF for b in raw)
    return plain.decode("ascii") if plain and all(32 <= b < 127 for b in plain) else None


def scan_chunks(scan: Scan) -> None:
    """Frames behind markers: a compressed block, a cache cell or a directory entry; else one byte on."""
    data, size = scan.data, len(scan.data)
    if size < CHUNK_OUTER:
        scan.note("chunk_outer_header_truncated", "error", size)
        scan.used.append((0, size))
        return
    scan.used.append((0, CHUNK_OUTER))
    scan.version = struct.unpack_from(">I", data, 4)[0]
    at, markers = CHUNK_OUTER, 0
    while (at := data.find(CHUNK_MARKER, at)) >= 0:
        markers += 1
        if markers > scan.limits.streams:
            scan.note("limit_streams", "error", at)
            raise Stop
        if at + CHUNK_HEADER > size:
            scan.note("chunk_frame_header_truncated", "error", at)
            scan.used.append((at, size))
            return
        fields = struct.unpack_from("<5I", data, at + 6)
        if fields[4] > scan.limits.string_bytes:
            scan.note("limit_string_bytes", "error", at + 22)
            raise Stop
        problem = _chunk_block(scan, at, *fields)
        if problem is None or _chunk_cell(scan, at, *fields) or _chunk_directory(scan, at, *fields):
            at = max(at + 1, scan.used[-1][1])
            continue
        if problem:
            scan.note(problem, "error", at)
            if problem.startswith("limit_"):
                raise Stop
        at += 1
    if not scan.entries:
        scan.note("chunk_no_frames", "error", CHUNK_OUTER)
    scan.entries.sort(key=lambda e: e["source_offset"])


def _chunk_block(scan: Scan, at: int, kind: int, crc: int, packed: int, plain: int, name_len: int) -> str | None:
    """None where the frame is a sound block; "" where it cannot be one; else what is wrong."""
    begin = at + CHUNK_HEADER + name_len
    if begin > len(scan.data):
        return "chunk_name_truncated"
    name = swapped_name(scan.data[at + CHUNK_HEADER : begin])
    if (name_len and name is None) or not packed:
        return ""
    if begin + packed > len(scan.data):
        return "chunk_block_truncated"
    raw = scan.data[begin : begin + packed]
    out = scan.inflate(raw, plain, -15)
    if isinstance(out, str):
        return out
    if zlib.crc32(out) != crc:
        return "chunk_crc_differs"
    scan.add(
        "block", at, begin + packed, name, payload_offset=begin, payload_length=packed, stored_size=packed, decoded_size=plain, compression="deflate_raw", checksum="verified", expected_crc32=crc,
        attributes={"type_id": str(kind)}, stored_bytes=raw, plain_bytes=out,
    )
    return None


def _chunk_cell(scan: Scan, at: int, kind: int, double: int, half: int, length: int, name_len: int) -> bool:
    end = at + CHUNK_HEADER + name_len
    if not (length and name_len and double == 2 * length and half == length // 2 and end <= len(scan.data)):
        return False
    if (name := swapped_name(scan.data[at + CHUNK_HEADER : end])) is None:
        return False
    scan.add("cache_cell", at, end, name, attributes={"type_id": str(kind), "logical_length": str(length)})
    return True


def _chunk_directory(scan: Scan, at: int, kind: int, zero: int, size: int, other: int, name_len: int) -> bool:
    start = at + DIRECTORY_PREFIX
    stop = start + name_len
    if zero or other or not name_len or stop + DIRECTORY_TRAILER > len(scan.data):
        return False
    trailer = scan.data[stop : stop + DIRECTORY_TRAILER]
    name = swapped_name(scan.data[start:stop])
    if name is None or trailer[4:] != b"\0\0":
        return False
    about = {"type_id": str(kind), "section_size": str(size), "descriptor_sha256": hashlib.sha256(scan.data[at + CHUNK_HEADER : start]).hexdigest(), "trailer_hex": trailer.hex()}
    scan.add("directory_entry", at, stop + DIRECTORY_TRAILER, name, stored_size=size, attributes=about)
    return True


def scan_zip(scan: Scan) -> None:
    """Central directory of a ZIP file without 64-bit fields or several disks, each entry checked against its local header."""
    data = scan.data
    end = data.rfind(ZIP_END, max(0, len(data) - 65_557))
    while end >= 0 and (end + 22 > len(data) or end + 22 + struct.unpack_from("<H", data, end + 20)[0] != len(data)):
        end = data.rfind(ZIP_END, max(0, len(data) - 65_557), end)
    if end < 0:
        scan.note("zip_end_record_missing", "error", len(data))
        return
    disk, start_disk, here, total, size, start, comment = struct.unpack_from("<4H2IH", data, end + 4)
    if disk or start_disk or here != total:
        scan.note("zip_several_disks", "error", end)
        return
    if 0xFFFF in (here, total) or 0xFFFFFFFF in (size, start):
        scan.note("zip_64_unsupported", "error", end)
        return
    if start + size > end:
        scan.note("zip_directory_range", "error", end)
        return
    scan.used += [(end, end + 22 + comment), (start, start + size)]
    at = start
    for _ in range(total):
        if at + 46 > end or data[at : at + 4] != ZIP_CENTRAL:
            scan.note("zip_directory_entry_invalid", "error", at)
            return
        made, need, flags, method, _time, _date, crc, packed, plain, n, extra, remark, _disk, _int, _ext, local = struct.unpack_from("<6H3I5H2I", data, at + 4)
        raw_name = data[at + 46 : at + 46 + n]
        _zip_entry(scan, at, raw_name, flags, method, crc, packed, plain, local)
        at += 46 + n + extra + remark


def _zip_entry(scan: Scan, at: int, raw_name: bytes, flags: int, method: int, crc: int, packed: int, plain: int, local: int) -> None:
    data = scan.data
    try:
        name = raw_name.decode("utf-8" if flags & 0x800 else "ascii")
        about = {}
    except UnicodeDecodeError:
        name, about = None, {"raw_name_hex": raw_name.hex()}
    if name is not None and (name.startswith(("/", "\\")) or ":" in name or ".." in name.replace("\\", "/").split("/")):
        scan.note("zip_path_unsafe", "warning", at)
        about["unsafe_path"] = "true"
    kind = {"stored_size": packed, "decoded_size": plain, "compression": {0: "stored", 8: "deflate_raw"}.get(method, f"method_{method}"), "expected_crc32": crc, "attributes": about}
    if local + 30 > len(data) or data[local : local + 4] != ZIP_LOCAL:
        scan.note("zip_local_header_invalid", "error", local)
        scan.add("zip_entry", local, local, name, state="malformed", **kind)
        return
    l_flags, l_method, n, extra = struct.unpack_from("<2H", data, local + 6) + struct.unpack_from("<2H", data, local + 26)
    begin = local + 30 + n + extra
    end = begin + packed
    problem = None
    if end > len(data):
        problem = "zip_payload_truncated"
    elif l_method != method or data[local + 30 : local + 30 + n] != raw_name or (l_flags ^ flags) & 1:
        problem = "zip_headers_disagree"
    elif flags & 1:
        problem = "zip_encrypted"
    elif method not in (0, 8):
        problem = "zip_method_unsupported"
    if problem:
        scan.note(problem, "error", local)
        scan.add("zip_entry", local, min(max(end, local), len(data)), name, state="malformed", **kind)
        return
    raw = data[begin:end]
    out = scan.inflate(raw, plain, -15) if method == 8 else raw if len(raw) == plain else "inflate_size_differs"
    if isinstance(out, str) or zlib.crc32(out) != crc:
        scan.note(out if isinstance(out, str) else "zip_crc_differs", "error", begin)
        scan.add("zip_entry", local, end, name, state="malformed", payload_offset=begin, payload_length=packed, stored_bytes=raw, **kind)
        return
    after = end
    if flags & 8:  # a descriptor may or may not start with its signature
        after += 16 if data[end : end + 4] == ZIP_DESCRIPTOR else 12
    scan.add("zip_entry", local, min(after, len(data)), name, payload_offset=begin, payload_length=packed, checksum="verified", stored_bytes=raw, plain_bytes=out, **kind)


class Compound:
    """Sectors, allocation tables and directory of a compound file."""

    def __init__(self, data: bytes, limits: Limits):
        if len(data) < 512 or not data.startswith(COMPOUND_SIGNATURE):
            raise ValueError("compound_header_truncated")
        minor, self.major, order, shift, mini = struct.unpack_from("<5H", data, 24)
        if order != 0xFFFE or (self.major, shift) not in ((3, 9), (4, 12)) or mini != 6:
            raise ValueError("compound_header_invalid")
        self.data, self.limits, self.sector = data, limits, 1 << shift
        _dirs, fats, first_dir, _tx, cutoff, first_mini, minis, first_difat, difats = struct.unpack_from("<9I", data, 40)
        if cutoff != 4096:
            raise ValueError("compound_cutoff_invalid")
        if fats > len(data) // self.sector + 1 or difats > len(data) // self.sector + 1:
            raise ValueError("compound_table_range")
        table = [x for x in struct.unpack_from("<109I", data, 76) if x < DIFAT_SECTOR]
        seen, at = set(), first_difat
        while at < DIFAT_SECTOR:
            if at in seen:
                raise ValueError("compound_chain_cycle")
            seen.add(at)
            words = struct.unpack(f"<{self.sector // 4}I", self._sector(at))
            table += [x for x in words[:-1] if x < DIFAT_SECTOR]
            at = words[-1]
        self.fat = [w for s in table for w in struct.unpack(f"<{self.sector // 4}I", self._sector(s))]
        directory = self.chain(first_dir)
        self.nodes = [self._node(directory, i) for i in range(0, len(directory) - 127, 128)]
        if not self.nodes or self.nodes[0]["kind"] != 5:
            raise ValueError("compound_root_missing")
        raw_mini = self.chain(first_mini) if minis else b""
        self.mini_fat = struct.unpack(f"<{len(raw_mini) // 4}I", raw_mini)
        self.mini = self.chain(self.nodes[0]["start"]) if self.nodes[0]["start"] < DIFAT_SECTOR else b""

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self.sector
        if at >= len(self.data):
            raise ValueError("compound_sector_range")
        return self.data[at : at + self.sector].ljust(self.sector, b"\0")

    def _walk(self, start: int, table) -> list[int]:
        out, seen, at = [], set(), start
        while at < DIFAT_SECTOR:
            if at in seen or at >= len(table):
                raise ValueError("compound_chain_cycle" if at in seen else "compound_sector_range")
            seen.add(at)
            out.append(at)
            at = table[at]
        return out

    def chain(self, start: int) -> bytes:
        return b"".join(map(self._sector, self._walk(start, self.fat)))

    def _node(self, raw: bytes, at: int) -> dict:
        n = struct.unpack_from("<H", raw, at + 64)[0]
        kind, _color, left, right, child = struct.unpack_from("<2B3I", raw, at + 66)
        start, size = struct.unpack_from("<IQ", raw, at + 116)
        if self.major == 3:
            size &= 0xFFFFFFFF
        return {"name": raw[at : at + max(0, n - 2)].decode("utf-16-le", "replace"), "kind": kind, "left": left, "right": right, "child": child, "start": start, "size": size}

    def streams(self):
        """(path, node) of all storages and streams, sorted by path."""
        out, stack, seen = [], [(self.nodes[0]["child"], "", 0)], set()
        while stack:
            n, folder, depth = stack.pop()
            if n >= FAT_SECTOR or n == FREE_SECTOR:
                continue
            if n >= len(self.nodes) or n in seen or depth > self.limits.depth:
                raise ValueError("compound_tree_invalid")
            seen.add(n)
            node = self.nodes[n]
            path = f"{folder}/{node['name']}"
            if node["kind"] in (1, 2):
                out.append((path, node))
            stack += [(node["left"], folder, depth), (node["right"], folder, depth)]
            if node["kind"] == 1:
                stack.append((node["child"], path, depth + 1))
        return sorted(out, key=lambda x: x[0])

    def read(self, node: dict) -> bytes:
        if node["size"] >= 4096:
            out = self.chain(node["start"])
        else:
            out = b"".join(self.mini[64 * n : 64 * n + 64] for n in self._walk(node["start"], self.mini_fat)) if node["size"] else b""
        if len(out) < node["size"]:
            raise ValueError("compound_stream_truncated")
        return out[: node["size"]]


def unwrap(scan: Scan, raw: bytes) -> bytes | str:
    """Contents of a zlib wrapper of one or more members, or what is wrong."""
    if len(raw) < 24 or not raw.startswith(ZLB_MAGIC):
        return "wrapper_invalid"
    if len(raw) == 24:
        return b"" if raw[16:24] == bytes(8) else "wrapper_invalid"
    out, at = [], 16
    while True:
        if at + 8 > len(raw):
            return "wrapper_invalid"
        plain, packed = struct.unpack_from("<2I", raw, at)
        begin, end = at + 8, at + 8 + packed
        if end > len(raw):
            return "wrapper_invalid"
        part = scan.inflate(raw[begin:end], plain, 15)
        if isinstance(part, str):
            return part
        out.append(part)
        left = len(raw) - end
        if left == 8:
            return b"".join(out)
        if left < 16:
            return "wrapper_invalid"
        at = end


def scan_compound(scan: Scan) -> None:
    """Streams of a compound file by path; names ending in ``__ZLB`` are unwrapped."""
    try:
        file = Compound(scan.data, scan.limits)
        found = file.streams()
    except (ValueError, struct.error) as fault:
        scan.note(str(fault) if isinstance(fault, ValueError) else "compound_header_invalid", "error", 0)
        return
    scan.used.append((0, len(scan.data)))
    scan.version = file.major
    for n, (path, node) in enumerate(found):
        if node["kind"] == 1:
            scan.add("storage", n, n, path)
            continue
        try:
            raw = file.read(node)
        except ValueError as fault:
            scan.note(str(fault), "error", 0)
            scan.add("stream", n, n, path, state="malformed", stored_size=node["size"])
            continue
        wrapped = path.endswith("__ZLB")
        out = unwrap(scan, raw) if wrapped else raw
        if isinstance(out, str):
            scan.note(out, "error", 0)
            scan.add("stream", n, n, path, state="malformed", stored_size=len(raw), stored_bytes=raw, compression="zlib_wrapper")
            continue
        shown = path.removesuffix("__ZLB")
        scan.add("stream", n, n, shown, stored_size=len(raw), decoded_size=len(out), compression="zlib_wrapper" if wrapped else "stored", stored_bytes=raw, plain_bytes=out, attributes={"stored_path": path} if wrapped else {})


def envelope(data: bytes) -> str:
    if data.startswith(COMPOUND_SIGNATURE):
        return "ole2_cfb"
    if data[:4] in (ZIP_LOCAL, ZIP_END, ZIP_DESCRIPTOR):
        return "zip_opc"
    return "modern_chunk" if CHUNK_MARKER in data[:64] else "unknown"


def scan_bytes(data: bytes, limits: Limits = SERVICE, wanted=None, digests: bool = True) -> Scan:
    """Entries of a file of any of the three forms; ``wanted(path, id)`` says whose bytes to keep. Without ``digests`` entries have no SHA-256."""
    scan = Scan(data, limits, wanted, digests=digests)
    if len(data) > limits.input_bytes:
        scan.note("limit_input_bytes", "error", 0)
        scan.fatal = True
        return scan
    kind = envelope(data)
    reader = {"ole2_cfb": scan_compound, "zip_opc": scan_zip, "modern_chunk": scan_chunks}.get(kind)
    if reader is None:
        scan.note("container_unknown", "warning", 0)
        return scan
    try:
        reader(scan)
    except Stop:
        scan.fatal = True
    return scan
