"""Bounds under which files are read; two profiles."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    input_bytes: int = 2 << 30
    decoded_bytes: int = 8 << 30
    compression_ratio: int = 1000
    streams: int = 1_000_000
    string_bytes: int = 64 << 20
    xml_bytes: int = 64 << 20
    xml_nodes: int = 2_000_000
    depth: int = 256
    reference_depth: int = 256
    roots: int = 256
    directory_entries: int = 1_000_000
    files: int = 100_000
    edges: int = 1_000_000
    candidates: int = 1024


DESKTOP = Limits()
SERVICE = Limits(256 << 20, 1 << 30, 200, 100_000, 8 << 20, 8 << 20, 250_000, 64, 64, 32, 100_000, 10_000, 100_000, 128)
PROFILES = {"desktop": DESKTOP, "service": SERVICE}
