"""Writers of small synthetic containers."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

from lathe.sources import containers as c


def swapped(name: str) -> bytes:
    return bytes((b >> 4 | b << 4) & 0xFF for b in name.encode())


def deflate(data: bytes) -> bytes:
    engine = zlib.compressobj(9, zlib.DEFLATED, -15)
    return engine.compress(data) + engine.flush()


def block(name: str, data: bytes, crc: int | None = None, size: int | None = None) -> bytes:
    packed, raw = deflate(data), swapped(name)
    return c.CHUNK_MARKER + struct.pack("<5I", 7, zlib.crc32(data) if crc is None else crc, len(packed), len(data) if size is None else size, len(raw)) + raw + packed


def cell(name: str, length: int) -> bytes:
    raw = swapped(name)
    return c.CHUNK_MARKER + struct.pack("<5I", 3, 2 * length, length // 2, length, len(raw)) + raw


def directory(name: str, size: int) -> bytes:
    raw = swapped(name)
    return c.CHUNK_MARKER + struct.pack("<5I", 9, 0, size, 0, len(raw)) + bytes(14) + raw + b"abcd\0\0"


def chunk_file(*frames: bytes) -> bytes:
    return b"\0\0\0\0" + struct.pack(">I", 19000) + b"".join(frames)


def zip_file(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def wrapper(*parts: bytes) -> bytes:
    out = c.ZLB_MAGIC
    for p in parts:
        packed = zlib.compress(p)
        out += struct.pack("<2I", len(p), len(packed)) + packed
    return out + bytes(8)


def compound_file(streams: dict[str, bytes]) -> bytes:
    """Version 3, one folder level at most ("a/b"), large streams in sectors and small ones in the mini stream."""
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        n = -(-len(data) // 512)
        if not n:
            return c.END_OF_CHAIN
        first = len(sectors)
        for i in range(n):
            sectors.append(data[512 * i : 512 * i + 512].ljust(512, b"\0"))
            fat.append(first + i + 1 if i + 1 < n else c.END_OF_CHAIN)
        return first

    mini, mini_fat = b"", []

    def put_mini(data: bytes) -> int:
        nonlocal mini
        n = -(-len(data) // 64)
        if not n:
            return c.END_OF_CHAIN
        first = len(mini_fat)
        mini_fat.extend(first + i + 1 if i + 1 < n else c.END_OF_CHAIN for i in range(n))
        mini += data.ljust(64 * n, b"\0")
        return first

    nodes = [["Root Entry", 5, c.FREE_SECTOR, c.FREE_SECTOR, c.END_OF_CHAIN, 0]]
    folders: dict[str, list[int]] = {"": []}
    for path, data in streams.items():
        folder, _, leaf = path.rpartition("/")
        if folder and folder not in folders:
            folders[folder] = []
            folders[""].append(len(nodes))
            nodes.append([folder, 1, c.FREE_SECTOR, c.FREE_SECTOR, 0, 0])
        folders[folder].append(len(nodes))
        nodes.append([leaf, 2, c.FREE_SECTOR, c.FREE_SECTOR, put(data) if len(data) >= 4096 else put_mini(data), len(data)])
    by_name = {n[0]: i for i, n in enumerate(nodes) if n[1] == 1}
    for folder, members in folders.items():
        for a, b in zip(members, members[1:], strict=False):
            nodes[a].append(b)
        owner = nodes[by_name[folder]] if folder else nodes[0]
        owner[3] = members[0] if members else c.FREE_SECTOR
    nodes[0][4], nodes[0][5] = put(mini), len(mini)
    raw_mini = b"".join(struct.pack("<I", x) for x in mini_fat)
    first_mini = put(raw_mini.ljust(-(-len(raw_mini) // 512) * 512, b"\xff"))
    directory_ = b""
    for node in nodes:
        name, kind, left, child, start, size, *right = node
        raw = name.encode("utf-16-le") + b"\0\0"
        directory_ += raw.ljust(64, b"\0") + struct.pack("<H2B3I", len(raw), kind, 1, left, right[0] if right else c.FREE_SECTOR, child) + bytes(36) + struct.pack("<IQ", start, size)
    first_dir = put(directory_.ljust(-(-len(directory_) // 512) * 512, b"\0"))
    n_fat = 1
    while n_fat * 128 < len(fat) + n_fat:
        n_fat += 1
    fat_at = len(sectors)
    fat += [c.FAT_SECTOR] * n_fat
    raw_fat = b"".join(struct.pack("<I", x) for x in fat).ljust(512 * n_fat, b"\xff")
    sectors += [raw_fat[512 * i : 512 * i + 512] for i in range(n_fat)]
    head = c.COMPOUND_SIGNATURE + bytes(16) + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6)
    head += struct.pack("<9I", 0, n_fat, first_dir, 0, 4096, first_mini, len(raw_mini) > 0, c.END_OF_CHAIN, 0)
    head += struct.pack("<109I", *[fat_at + i for i in range(n_fat)], *[c.FREE_SECTOR] * (109 - n_fat))
    return head + b"".join(sectors)


CUSTOM_XML = b"""junk<?xml version="1.0"?><Properties><propertySection name="Other"><property name="no"/></propertySection><propertySection name="UserDefinedProperties">
<property name="Title" pid="2"><lpstr>Bracket</lpstr></property><property name="Empty" pid="3"><lpstr></lpstr></property><property name="Gone" pid="4"/><property name="Odd" pid="5"><blob>ff</blob></property></propertySection></Properties>"""
SYSTEM_XML = b"""<P><propertySection name="x"><property name="SW_UnitsLinear"><i4>3</i4></property><property name="SW_UnitsAngular"><i4>0</i4></property><property name="SW_UnitSystem"><i4>4</i4></property>
<property name="SW_UnitsMassPropMass"><i4>1</i4></property><property name="Fmt"><lpstr>S1@1@2@3@4@5@6@7@8@9@S1@a@b@c@d@e@f@g@h@i@@</lpstr></property></propertySection></P>"""
OTHER_SYSTEM_XML = b'<P><propertySection name="x"><property name="SW_UnitSystem"><i4>5</i4></property></propertySection></P>'
TREE_XML = b"""<swDoc><swHeader><swFile id="f0" swPath="C:\\p\\top.sldasm" swDocType="ASSEMBLY"/><swFile id="f1" swPath="C:\\p\\Bolt.SLDPRT" swDocType="Part"/><swFile id="f2" swPath="C:\\p\\sub.sldasm" swDocType="ASSEMBLY"/></swHeader>
<swConfigurationList><swConfiguration swID="0" swName="Default" swModelRef="m0"/><swConfiguration swID="1" swName="Alt" swModelRef="m1"/><swConfiguration swID="1" swName="Alt" swModelRef="m0"/></swConfigurationList>
<swModelList><swModel id="m0" swFileRef="f0" swConfigurationId="0"><swReference swModelRef="m2" swName="Bolt-1" swSuppressed="no" swReferenceNumber=" 1 " swTransform="1 0 0 0 0 1 0 0 0 0 1 0 0 0 0 1"/><swReference swModelRef="m3" swName="sub-1" swSuppressed="YES" swHidden="maybe" swConfigurationName="Long"/></swModel>
<swModel id="m1" swFileRef="f0" swConfigurationId="1"><swReference swModelRef="m2" swName="x"/></swModel><swModel id="m2" swFileRef="f1" swConfigurationName="Short"/><swModel id="m3" swFileRef="f2" swConfigurationName="Std"/></swModelList></swDoc>"""
FEATURES_XML = b"""<swDoc><swHeader><swFile id="a" swPath="self" swDocType="PART"/><swFile id="b" swPath="D:\\lib\\ext.sldprt" swDocType="PART"/></swHeader></swDoc>"""
KEYWORDS_XML = b"""<Keywords><Configuration Type="ConfigurationManager" id="0" Name="Base" Material="Steel"/><Configuration Type="ConfigurationManager" id="0" Name="Base" Material="Brass"/>
<Boss id="f1" Name="Boss1" Type="Extrude" Dissectable="true" DissectableChildren="a, b,"><Dimension Name="D1">10</Dimension></Boss><Sheet id="s1" Name="S1" Type="Sheet"><View id="v1" Name="V1" Description="Default">top.sldasm</View><PaperSize>8</PaperSize><Note>hi &amp; ho</Note></Sheet>
<Sheet id="s2" Name="S1"><View id="v2" Name="V2"/></Sheet><Layer id="l"/></Keywords>"""


def document() -> bytes:
    return chunk_file(
        block("docProps/custom.xml", CUSTOM_XML), block("docProps/ISolidWorksInformation.xml", SYSTEM_XML), b"\x14\x00gap", block("swXmlContents/COMPINSTANCETREE", TREE_XML), block("swXmlContents/Features", FEATURES_XML),
        block("swXmlContents/KeyWords", KEYWORDS_XML), cell("Contents/Cell", 40), directory("Contents/_MO_VERSION_19000/x", 5), block("VirtualComp/Inner^top.sldprt", chunk_file(block("docProps/custom.xml", CUSTOM_XML))),
    )
