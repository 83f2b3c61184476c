"""What kind of container a file is, from its first bytes; JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values of the container formats -----------------------------------
COMPOUND = "D0CF11E0A1B11AE1"
ZIPS = ("504B0304", "504B0506", "504B0708")
CHUNK = "140006000800"
WINDOW = 64
SUFFIXES = {"sldprt": "part", "sldasm": "assembly", "slddrw": "drawing"}
# Identifiers of root storages (part, assembly), and streams that only such documents hold.
ROOT_CLASSES = ("83a33d30-27c5-11ce-bfd4-00400513bb57", "83a33d36-27c5-11ce-bfd4-00400513bb57")
APPLICATION_STREAMS = ("/ISolidWorksInformation", "/Contents/CMgr", "/Contents/CMgrHdr2")
# --------------------------------------------------------------------------------


def probe(files: DataFrame, content: str = "content", max_bytes: int = 2 << 30) -> DataFrame:
    """status, envelope, confidence, marker_offset and byte_len of each file.

    Empty input and a proper prefix of a signature are malformed, files above the
    size limit rejected, anything else without a signature unrecognized.
    """
    raw = F.col(content)
    size = F.octet_length(raw).cast("bigint")
    head = F.hex(F.substring(raw, 1, WINDOW))
    place = F.instr(head, CHUNK)
    # Hex digits are two a byte: only odd places are bytes. A later, even-placed hit is found by stepping over nibbles.
    at = F.when(place % 2 == 1, (place - 1) / 2).otherwise(F.length(F.regexp_extract(head, f"^((?:..)*?){CHUNK}", 1)) / 2)
    chunk = F.when(head.rlike(f"^(?:..)*?{CHUNK}"), at.cast("int"))
    compound = head.startswith(COMPOUND)
    zipped = head.startswith(ZIPS[0]) | head.startswith(ZIPS[1]) | head.startswith(ZIPS[2])
    prefix = F.lit(False)
    for signature in (COMPOUND, *ZIPS, CHUNK):
        prefix = prefix | (F.lit(signature).startswith(head) & (F.length(head) < len(signature)))
    known = compound | zipped | chunk.isNotNull()
    status = F.when(size > max_bytes, "rejected").when(size == 0, "malformed").when(known, "recognized").when(prefix, "malformed").otherwise("unrecognized")
    ok = status == "recognized"
    envelope = F.when(ok & compound, "ole2_cfb").when(ok & zipped, "zip_opc").when(ok, "modern_chunk").otherwise("unknown")
    confidence = F.when(envelope == "unknown", "none").when(envelope == "modern_chunk", "medium").otherwise("high")
    return files.select(*(c for c in files.columns if c != content), status.alias("status"), envelope.alias("envelope"), confidence.alias("confidence"), F.when(envelope == "modern_chunk", chunk).alias("marker_offset"), size.alias("byte_len"))


def kind_hint(path: Column) -> Column:
    """Document kind that a file's name announces."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.lit(None).cast("string")
    for s, kind in SUFFIXES.items():
        out = F.when(suffix == s, kind).otherwise(out)
    return out


def stream_family(path: Column) -> Column:
    """Family of a stream of a compound document."""
    leaf = F.element_at(F.split(path, "/"), -1)
    return (
        F.when(leaf.isin("\x05SummaryInformation", "\x05DocumentSummaryInformation", "ISolidWorksInformation") | leaf.endswith("-Properties"), "property_set")
        .when(leaf.isin("Preview", "PreviewPNG") | leaf.contains("-Preview"), "preview")
        .when(leaf.isin("CMgr", "CMgrHdr2", "CnfgObjs") | leaf.startswith("Config-"), "configuration")
        .when(leaf.isin("Header", "Header2", "ModelStamps"), "document_header")
        .when(path.contains("/_MO_VERSION_") | path.contains("/_DL_VERSION_"), "versioned_model")
        .when(path.startswith("/swXmlContents/"), "xml_cache")
        .when(path.startswith("/ThirdPty/") | path.startswith("/ThirdPtyStore/"), "third_party")
        .when(leaf.startswith("DisplayList"), "display_cache")
        .otherwise("other")
    )


def legacy_candidates(entries: DataFrame) -> DataFrame:
    """(doc_id, is_candidate): does any entry (path, attributes) of a compound document show that it is one of ours?"""
    path = F.coalesce("path", F.lit(""))
    versioned = F.exists(F.split(path, "/"), lambda c: c.startswith("_MO_VERSION_") | c.startswith("_DL_VERSION_"))
    root = (path == "/") & F.coalesce(F.element_at("attributes", "clsid").isin(*ROOT_CLASSES), F.lit(False))
    return entries.groupBy("doc_id").agg(F.bool_or(versioned | root | path.isin(*APPLICATION_STREAMS)).alias("is_candidate"))
