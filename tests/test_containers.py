"""Container readers and fact tables on synthetic files."""

from __future__ import annotations

import os
import random
import struct
import zlib

import pytest

from lathe import engine
from lathe.facts import binary, display, resolve, streams, xmltree
from lathe.sources import containers, files, probe
from lathe.sources.limits import SERVICE, Limits

from . import fixtures as fx


def table(spark, **content):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in content.items()], "path string, content binary")


def test_probe(spark):
    rows = probe.probe(
        table(spark, cfb=containers.COMPOUND_SIGNATURE + b"x", zip=b"PK\x05\x06..", chunk=b"abc" + containers.CHUNK_MARKER, odd=b"\x01\x40\x00\x60\x00\x80" + b"\x14\x00\x06\x00\x08\x00", part=b"\xd0\xcf", empty=b"", text=b"hello", late=b"x" * 60 + containers.CHUNK_MARKER, big=b"y" * 500), max_bytes=400
    ).collect()
    got = {r["path"]: (r["status"], r["envelope"], r["confidence"], r["marker_offset"]) for r in rows}
    assert got == {
        "cfb": ("recognized", "ole2_cfb", "high", None), "zip": ("recognized", "zip_opc", "high", None), "chunk": ("recognized", "modern_chunk", "medium", 3), "odd": ("recognized", "modern_chunk", "medium", 6),
        "part": ("malformed", "unknown", "none", None), "empty": ("malformed", "unknown", "none", None), "text": ("unrecognized", "unknown", "none", None), "late": ("unrecognized", "unknown", "none", None), "big": ("rejected", "unknown", "none", None),
    }


def test_chunk_frames():
    data = fx.document()
    scan = containers.scan_bytes(data, SERVICE, lambda path, _: path == "docProps/custom.xml")
    assert [e["kind"] for e in scan.entries].count("block") == 6 and {e["kind"] for e in scan.entries} == {"block", "cache_cell", "directory_entry"}
    assert scan.version == 19000 and not scan.notes
    assert [data[a:b] for a, b in scan.unexplained()] == [b"\x14\x00gap"]
    held = [e for e in scan.entries if e["decoded"] is not None]
    assert [e["decoded"] for e in held] == [fx.CUSTOM_XML]


@pytest.mark.parametrize(
    ("frame", "code"),
    [
        (fx.block("a", b"data", crc=1), "chunk_crc_differs"), (fx.block("a", b"data" * 9)[:-3], "chunk_block_truncated"), (fx.block("a", b"data", size=3), "inflate_size_differs"), (fx.block("a", b"\0" * 500_000), "limit_compression_ratio"),
        (containers.CHUNK_MARKER + b"123", "chunk_frame_header_truncated"),
    ],
)
def test_chunk_faults(frame, code):
    scan = containers.scan_bytes(fx.chunk_file(frame))
    assert code in [n[0] for n in scan.notes] and not scan.entries


def test_zip():
    data = fx.zip_file({"docProps/custom.xml": fx.CUSTOM_XML, "../evil": b"x", "empty": b""})
    scan = containers.scan_bytes(data)
    assert [(e["path"], e["state"]) for e in scan.entries] == [("docProps/custom.xml", "decoded"), ("../evil", "decoded"), ("empty", "decoded")]
    assert [n[0] for n in scan.notes] == ["zip_path_unsafe"] and not scan.unexplained()
    broken = bytearray(data)
    broken[60] ^= 255
    assert any(n[0] in ("zip_crc_differs", "inflate_invalid", "inflate_size_differs") for n in containers.scan_bytes(bytes(broken)).notes)
    assert containers.scan_bytes(data[:-5]).notes[0][0] == "zip_end_record_missing"


def test_compound():
    big = os.urandom(70_000)
    data = fx.compound_file({"Header2": b"small", "big": big, "Contents/Config-0": b"c" * 100, "packed__ZLB": fx.wrapper(b"one", b"two" * 50), "empty": b""})
    scan = containers.scan_bytes(data, SERVICE, lambda *_: True)
    assert not scan.notes
    assert {e["path"]: e["decoded"] for e in scan.entries if e["kind"] == "stream"} == {"/Header2": b"small", "/big": big, "/Contents/Config-0": b"c" * 100, "/packed": b"one" + b"two" * 50, "/empty": b""}
    assert containers.scan_bytes(data[:600]).notes and containers.scan_bytes(containers.COMPOUND_SIGNATURE).notes


def test_random_bytes_never_raise():
    rng = random.Random(5)
    seeds = [fx.document(), fx.zip_file({"a": b"b" * 100}), fx.compound_file({"x": b"y" * 5000})]
    for n in range(400):
        data = bytearray(seeds[n % 3])
        for _ in range(rng.randrange(1, 30)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        scan = containers.scan_bytes(bytes(data[: rng.randrange(len(data) + 1)]), Limits(streams=50))
        assert all(0 <= a <= b for a, b in scan.unexplained())


def test_xml_ranges():
    data = fx.KEYWORDS_XML
    root = xmltree.parse(data, 10**6, 1000)
    for node in root.walk():
        raw = data[node.start : node.end]
        assert raw.startswith(b"<" + node.tag.encode()) and (raw.endswith(b"/>") or raw.endswith(b"</" + node.tag.encode() + b">"))
    for bad, code in ((b"<a><b></a>", "xml_malformed"), (b"none", "xml_missing"), (b"<!DOCTYPE a><a/>", "xml_document_type"), (b"<a>\xff</a>", "xml_not_utf8"), (b"<a>" + b"<b/>" * 2000 + b"</a>", "limit_xml_nodes")):
        with pytest.raises(xmltree.XmlFault, match=code):
            xmltree.parse(bad, 10**6, 1000)


@pytest.fixture(scope="module")
def parsed(spark):
    return engine.parse(table(spark, top=fx.document(), bad=b"PK\x03\x04", two=fx.chunk_file(fx.block("docProps/ISolidWorksInformation.xml", fx.SYSTEM_XML), fx.block("docProps/Config-2-Properties.xml", fx.CUSTOM_XML), fx.block("swXmlContents/KeyWords", b"<broken"))))


def test_properties(parsed):
    rows = parsed["properties"].filter("doc_id = 'top' AND kind = 'custom'").orderBy("ordinal").collect()
    assert [(r["name"], r["raw_value"], r["value_state"]) for r in rows] == [("Title", "Bracket", "present"), ("Empty", "", "empty"), ("Gone", None, "missing"), ("Odd", "ff", "unsupported_type")]
    assert {r["configuration_index"] for r in parsed["properties"].filter("scope = 'configuration'").collect()} == {2}


def test_components(parsed):
    rows = parsed["components"].filter("doc_id = 'top'").orderBy("configuration_index", "ordinal").collect()
    assert [(r["configuration_index"], r["instance_name"], r["stored_path"], r["document_kind"], r["referenced_configuration"], r["is_suppressed"], r["is_hidden"], r["instance_number"]) for r in rows] == [
        (0, "Bolt-1", "C:\\p\\Bolt.SLDPRT", "part", "Short", False, None, 1), (0, "sub-1", "C:\\p\\sub.sldasm", "assembly", "Long", True, None, None),
    ]
    assert len(rows[0]["raw_transform"]) == 16 and rows[1]["raw_transform"] is None
    kinds = {r["kind"]: r["n"] for r in parsed["references"].filter("doc_id = 'top'").groupBy("kind").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert kinds == {"assembly_component": 2, "external_feature": 1, "drawing_view": 2}


def test_conflicts_are_withheld(parsed):
    base = parsed["configurations"].filter("doc_id = 'top' AND configuration_index = 0").first()
    assert (base["name"], base["alternate_names"], base["material"], base["material_withheld"]) == ("Default", ["Base"], None, True)
    kinds = {r["doc_id"]: (r["document_kind"], r["withheld"]) for r in parsed["document_kinds"].collect()}
    assert kinds["top"] == (None, True)
    assert parsed["versions"].first()["internal_version"] == 19000


def test_units(parsed):
    rows = {r["doc_id"]: (r["length"], r["angle"], r["unit_system"], r["mass"]) for r in parsed["units"].collect()}
    assert rows == dict.fromkeys(("top", "two"), ("inch", "degrees", "mmgs", "gram"))


def test_sheets_and_formats(parsed):
    rows = parsed["sheets"].orderBy("ordinal").collect()
    assert [(r["name"], r["declared"], r["paper_size_name"]) for r in rows] == [("S1", True, "a3"), ("S1", False, None)]
    formats = resolve.sheet_formats(parsed["properties"].filter("doc_id = 'top'"), parsed["sheets"], "Fmt").orderBy("ordinal").collect()
    assert [r["fields"][1] for r in formats] == ["1", "a"]
    assert [(r["name"], r["children"], r["dimensions"][0]["raw_value"]) for r in parsed["features"].collect()] == [("Boss1", ["a", "b"], "10")]


def test_drawing_records(parsed):
    rows = {r["source_id"] or r["source_tag"]: r for r in parsed["drawing_records"].collect()}
    assert rows["v1"]["parent_id"] == rows["s1"]["id"] and rows["s1"]["parent_id"] == rows["Keywords"]["id"]
    assert rows["PaperSize"]["class"] == "field" and rows["Note"]["direct_text"] == "hi & ho" and rows["v1"]["class"] == "view"
    r = rows["v1"]
    assert fx.KEYWORDS_XML[r["decoded_offset"] : r["decoded_offset"] + r["byte_len"]].startswith(b"<View")


def test_coverage_and_faults(parsed):
    assert [(r["doc_id"], r["code"]) for r in parsed["faults"].collect()] == [("two", "xml_malformed")]
    rows = {r["doc_id"]: r for r in parsed["coverage"].collect()}
    assert rows["two"]["malformed_streams"] == 1 and rows["top"]["partially_streams"] == 5 and rows["top"]["uninterpreted_streams"] == 1
    assert {r["code"] for r in parsed.diagnostics.filter("doc_id = 'bad'").collect()} == {"zip_end_record_missing"}


def test_embedded_documents(spark):
    scanned = files.embedded_closure(table(spark, top=fx.document()), wanted=["custom.xml"])
    docs = {r["doc_id"] for r in scanned.select("doc_id").distinct().collect()}
    assert docs == {"top", "top#VirtualComp/Inner^top.sldprt"}
    keys = files.virtual_keys(files.embedded(files.entries(table(spark, top=fx.document()), wanted=["^VirtualComp/"]))).collect()
    assert {r["key"] for r in keys} == {"inner^top", "inner"}


def test_extract(spark, tmp_path):
    docs = table(spark, top=fx.document())
    entry = engine.inventory(docs).filter("path = 'docProps/custom.xml'").first()
    out = engine.extract(docs, entry["entry_id"])
    row = out.first()
    assert bytes(row["bytes"]) == fx.CUSTOM_XML and row["verified"]
    files.write_bytes(out, f"file://{tmp_path}/x.xml")
    assert (tmp_path / "x.xml").read_bytes() == fx.CUSTOM_XML
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_bytes(out, f"file://{tmp_path}/x.xml")
    with pytest.raises(engine.StrictError) as caught:
        engine.inventory(table(spark, bad=fx.chunk_file(fx.block("a", b"x", crc=0))), strict=True)
    assert caught.value.result.count() == 0


def test_listing_and_ingest(spark, tmp_path):
    from lathe.streaming.ingest import ingest

    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.SLDPRT").write_bytes(fx.document())
    (tmp_path / "in" / "sub" / "b.sldasm").write_bytes(fx.chunk_file(fx.block("n", b"m")))
    (tmp_path / "in" / "note.txt").write_bytes(b"no")
    rows = {r["label"]: r["root_ids"] for r in engine.index(spark, [f"{tmp_path}/in", f"{tmp_path}/in/sub"]).collect()}
    assert rows == {"a.SLDPRT": [0], "sub/b.sldasm": [0, 1]}
    args = (spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark")
    ingest(*args).awaitTermination()
    (tmp_path / "in" / "copy.sldprt").write_bytes(fx.document())
    (tmp_path / "in" / "new.sldprt").write_bytes(fx.chunk_file(fx.block("p", b"q")))
    ingest(*args).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/files").count() == 4


def property_set(kind: bytes, values: list[tuple[int, bytes]]) -> bytes:
    at, table_, body = 8 + 8 * len(values), b"", b""
    for pid, raw in values:
        table_ += struct.pack("<2I", pid, at + len(body))
        body += raw + bytes(-len(raw) % 4)
    section = struct.pack("<2I", 8 + len(table_) + len(body), len(values)) + table_ + body
    return b"\xfe\xff\0\0" + bytes(20) + struct.pack("<I", 1) + kind + struct.pack("<I", 48) + section


def test_property_sets(spark):
    text = lambda s: struct.pack("<2I", 30, len(s) + 1) + s + b"\0"
    raw = property_set(binary.SUMMARY, [(1, struct.pack("<IHH", 2, 1252, 0)), (2, text(b"T\xe4st")), (14, struct.pack("<Ii", 3, -5)), (99, struct.pack("<I", 65) + b"\1\0\0\0z"), (12, struct.pack("<IQ", 64, 2**63 + 1))])
    rows = binary.property_sets(spark.createDataFrame([("d", "\x05SummaryInformation", bytearray(raw)), ("e", "x", bytearray(b"no"))], "doc_id string, path string, decoded binary")).collect()
    got = {r["name"]: (r["value_type"], r["raw_value"], r["value_state"]) for r in rows}
    assert got["Title"] == ("VT_LPSTR", "Täst", "present") and got["PageCount"] == ("VT_I4", "-5", "present") and got["CreatedTime"][1] == str(2**63 + 1)
    assert got["PID_99"][2] == "unsupported_type" and got[None][2] == "property_set_header"


def png(width: int, height: int) -> bytes:
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return binary.PNG_SIGNATURE + part(b"IHDR", struct.pack(">2I5B", width, height, 8, 0, 0, 0, 0)) + part(b"IDAT", b"x") + part(b"IEND", b"")


def test_previews(spark):
    good, dib = png(3, 4), struct.pack("<I2i2H6I", 40, 2, -2, 1, 24, 0, 0, 0, 0, 0, 0) + bytes(16)
    assert binary.check_png(good) == ("valid", 3, 4) and binary.check_png(good[:-1])[0] == "truncated" and binary.check_png(good + b"x")[0] == "trailing"
    assert binary.check_dib(dib) == ("valid", 2, 2) and binary.check_dib(dib[:-1])[0] == "truncated"
    rows = binary.previews(spark.createDataFrame([("d", "Preview", bytearray(dib)), ("d", "PreviewPNG", bytearray(good))], "doc_id string, path string, decoded binary"))
    assert binary.best_preview(rows).first()["path"] == "PreviewPNG"


def channel(form: tuple[int, int, int], count: int, data: bytes) -> bytes:
    return struct.pack("<4I", *form, count) + data


def face_table(x: float = 0.0) -> bytes:
    points, normals = struct.pack("<12f", x, 0, 0, 1, 0, 0, 0, 1, 0, 1, 1, 0), struct.pack("<12f", *[0, 0, 1] * 4)
    return (
        channel(display.STRIPS, 1, struct.pack("<I", 4)) + channel(display.VECTORS, 4, points) + channel(display.VECTORS, 4, normals) + channel((4, 8, 2), 6, struct.pack("<6f", *range(6))) + channel((4, 8, 2), 1, struct.pack("<I", 6)) + channel((1, 8, 2), 6, bytes(6))
    )


def text16(text: str) -> bytes:
    return display.TEXT_MARK + bytes([len(text)]) + text.encode("utf-16-le")


def declared(name: str) -> bytes:
    return display.CLASS_MARK + struct.pack("<H", len(name)) + name.encode()


def test_display_faces(spark):
    counts = struct.pack("<2I", 2, 1)
    face = declared(display.FACE_CLASS) + counts + face_table() + text16("moPlaneSurfIdRep_c,7,3")
    own = declared(display.FACE_CLASS) + counts + face_table(5.0) + text16("moPlaneSurfIdRep_c,8,1") + display.INLINE_MARK + struct.pack("<I", 0x00FF00) + bytes(12) + text16("green")
    body = declared(display.BODY_CLASS) + display.INLINE_MARK + struct.pack("<I", 0x0000FF) + bytes(12) + text16("red")
    raw = b"head" + face + own + declared(display.FACE_CLASS) + counts + face_table(9.0) + body
    record = struct.pack("<6I", display.FEATURE_VERSION, 7, 99, *display.FEATURE_SELECTORS) + display.FEATURE_PREFIX + display.FEATURE_MARK + struct.pack("<I", 0xFF0000)
    states = declared(display.FEATURE_CLASS) + record
    assert display.feature_colors(states) == {7: 0xFF0000} and display.feature_colors(states + record[:32] + b"\1\0\0\0") == {}
    assert [(n, raw[a : a + 4]) for n, a, _, _ in display.classes(raw)] == [(n, display.CLASS_MARK) for n in [display.FACE_CLASS] * 3 + [display.BODY_CLASS]]
    columns = "doc_id string, path string, decoded binary"
    rows = display.meshes(spark.createDataFrame([("d", "DisplayLists", bytearray(raw)), ("e", "DisplayLists", bytearray(raw[:60]))], columns), spark.createDataFrame([("d", "VisualStates", bytearray(states))], columns)).orderBy("face").collect()
    assert [(r["color_source"], r["packed_color"], r["positions"][0], r["surfaces"]) for r in rows] == [
        ("feature", 0xFF0000, 0.0, ["moPlaneSurfIdRep_c,7,3"]), ("face", 0x00FF00, 5000.0, ["moPlaneSurfIdRep_c,8,1"]), ("body", 0x0000FF, 9000.0, []),
    ]
    assert rows[0]["triangles"] == [0, 1, 2, 1, 3, 2]
    assert display.table(face_table()[:-1], 0) is None and display.table(face_table().replace(struct.pack("<I", 6) + channel((1, 8, 2), 6, b""), struct.pack("<I", 5) + channel((1, 8, 2), 6, b"")), 0) is None
    whole = engine.display_mesh(table(spark, top=fx.chunk_file(fx.block("Contents/DisplayLists", raw), fx.block("ThirdPtyStore/VisualStates", states))))
    assert whole.count() == 3


def test_tagged_faces():
    counts, tag = struct.pack("<2I", 2, 1), b"\x05\x80"
    first = declared(display.FACE_CLASS) + counts + face_table() + tag + counts + face_table(1.0)
    raw = first + declared("other_c") + b"pad" + tag + counts + face_table(2.0)
    assert [float(f.positions[0, 0]) for f in display.faces(raw)] == [0.0, 1.0, 2.0]
    rng = random.Random(2)
    for _ in range(200):
        data = bytearray(raw)
        for _ in range(rng.randrange(1, 9)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        for f in display.faces(bytes(data)):
            t = display.strip_triangles(f.strips)
            assert len(f.normals) in (0, len(f.positions)) and (not t.size or t.max() < len(f.positions))


def test_configuration_headers(spark):
    string = lambda s: bytes([len(s)]) + s.encode()
    wide = lambda s: b"\xff\xfe\xff" + bytes([len(s)]) + s.encode("utf-16-le")
    begin = lambda n: b"\xff\xff\1\0" + struct.pack("<H", len(n)) + n.encode()

    def record(head, name, index, parent, tail):
        return head + bytes(4) + name + struct.pack("<2I", index, 5) + name + struct.pack("<I", parent) + (bytes(4) + string("") + string("x") + bytes(16) if tail else b"")

    new = begin("dmConfigMgrHeader_c") + struct.pack("<H", 2) + record(begin("dmConfigHeader_c"), string("Default"), 0, 0xFFFFFFFF, True) + record(b"\3\x80", wide("Größe"), 4, 0, True)
    assert binary.configuration_header(new, 19000) == [(0, "Default", None), (4, "Größe", 0)]
    old = begin("dmConfigMgrHeader_c") + struct.pack("<H", 1) + record(begin("dmConfigHeader_c"), string("A"), 2, 1, False)
    assert binary.configuration_header(old, 7000) == [(2, "A", 1)]
    rows = binary.configuration_rows(spark.createDataFrame([("d", 19000, bytearray(new)), ("e", 19000, bytearray(new[:-3])), ("f", 7000, bytearray(new)), ("g", 5, bytearray(old))], "doc_id string, version long, decoded binary")).collect()
    assert {r["doc_id"]: r["fault"] for r in rows} == {"d": None, "e": "archive_truncated", "f": "archive_count", "g": "archive_version"}


def test_streams_rows_need_no_other_table(parsed):
    assert set(streams.TABLES) <= set(parsed.tables)


def test_command_line(spark, tmp_path, capsys):
    import json

    from lathe.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sldprt").write_bytes(fx.document())
    folder = f"file://{tmp_path}/in"

    def lines(*arguments, code=0):
        assert main([*arguments]) == code
        return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    assert [r["envelope"] for r in lines("probe", folder)] == ["modern_chunk"]
    entries = lines("inspect", folder)
    assert len(entries) == 8
    assert {r["name"] for r in lines("parse", folder, "--table", "properties")} >= {"Title", "Empty", "Gone", "Odd"}
    wanted = next(e["entry_id"] for e in entries if e["path"] == "docProps/custom.xml")
    assert main(["extract", folder, "--entry", wanted, "--output", f"file://{tmp_path}/out.xml"]) == 0
    assert (tmp_path / "out.xml").read_bytes() == fx.CUSTOM_XML
    assert lines("drawing", folder) and lines("index", folder, "--summary", code=1) and lines("display", folder) == []
    (tmp_path / "in" / "bad.sldprt").write_bytes(fx.chunk_file(fx.block("x", b"y", crc=0)))
    assert main(["inspect", folder, "--strict"]) == 2
