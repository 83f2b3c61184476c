"""Files as tables: listing, entries, extraction, embedded documents, plain sinks."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.functions import paths

from . import containers
from .limits import SERVICE, Limits

SUFFIXES = ("sldprt", "sldasm", "slddrw")

ENTRY_SCHEMA = (
    "doc_id string, entry_id string, path string, kind string, state string, source_offset long, source_length long, payload_offset long, payload_length long, stored_size long, decoded_size long, compression string, checksum string, "
    "expected_crc32 long, stored_sha256 string, decoded_sha256 string, attributes map<string,string>, stored binary, decoded binary, format_version long, diagnostics array<struct<code:string,severity:string,offset:long>>, unexplained array<struct<start:long,end:long>>"
)
_COLUMNS = [c.strip().split(" ")[0] for c in re.sub(r"<[^>]*(<[^>]*>)*[^>]*>", "", ENTRY_SCHEMA).split(",")]


def list_files(spark: SparkSession, roots: list[str], limits: Limits = SERVICE) -> DataFrame:
    """Document files below the roots: path, length, modificationTime, root_ids, label; ``content`` is read only where used.

    Files above the size limit are left to ``oversize``; a file below several roots appears once.
    """
    if len(roots) > limits.roots:
        raise ValueError(f"{len(roots)} roots, at most {limits.roots}")
    found = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(r).withColumn("root_id", F.lit(i)).withColumn("root", F.lit(r.rstrip("/"))) for i, r in enumerate(roots)]
    every = reduce(DataFrame.unionByName, found).filter(paths.has_suffix(F.col("path"), SUFFIXES))
    inside = F.expr("ltrim('/', substring(path, locate(root, path) + length(root)))")
    return every.withColumn("label", inside)


def index(files: DataFrame, limits: Limits = SERVICE) -> DataFrame:
    """One row for each file: its roots and the label below the first of them, by folded path."""
    listed = files.filter(F.col("length") <= limits.input_bytes)
    return listed.groupBy("path").agg(F.array_sort(F.collect_set("root_id")).alias("root_ids"), F.min_by("label", "root_id").alias("label"), F.max("length").alias("length")).withColumn("folded", paths.fold(paths.normalize(F.col("path"))))


def oversize(files: DataFrame, limits: Limits = SERVICE) -> DataFrame:
    """Diagnostics for files above the limit; their content is never read."""
    return files.filter(F.col("length") > limits.input_bytes).select(F.col("path").alias("doc_id"), F.lit("limit_input_bytes").alias("code"), F.col("length"))


def entries(files: DataFrame, doc_id: str = "path", content: str = "content", limits: Limits = SERVICE, wanted: list[str] | None = None) -> DataFrame:
    """Container entries of each file. ``wanted``: patterns of paths or ids whose bytes come along; others stay in the worker."""
    patterns = [re.compile(p) for p in wanted or []]

    def keep(path, entry_id):
        return any(p.search(path or "") or p.fullmatch(entry_id) for p in patterns)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ENTRY_SCHEMA))

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("doc_id"), batch.column("content"), strict=True):
                scan = containers.scan_bytes(data.as_py() or b"", limits, keep if patterns else None)
                about = {"doc_id": name.as_py(), "format_version": scan.version}
                extra = {"diagnostics": [{"code": c, "severity": s, "offset": o} for c, s, o in scan.notes], "unexplained": [{"start": a, "end": b} for a, b in scan.unexplained()]}
                rows = [about | e | {"attributes": list(e["attributes"].items()), "diagnostics": [], "unexplained": []} for e in scan.entries]
                # What concerns the file as a whole stands on a row of its own, without an entry.
                rows.append(about | dict.fromkeys(_COLUMNS[1:19]) | extra)
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select(F.col(doc_id).alias("doc_id"), F.col(content).cast("binary").alias("content")).mapInArrow(run, ENTRY_SCHEMA)


def inventory(scanned: DataFrame) -> DataFrame:
    return scanned.filter("entry_id IS NOT NULL").drop("diagnostics", "unexplained")


def in_source_order(entries_: DataFrame) -> DataFrame:
    """Entries of each document by their place in the file, those without one last."""
    return entries_.orderBy("doc_id", F.asc_nulls_last("source_offset"), "entry_id")


def diagnostics(scanned: DataFrame) -> DataFrame:
    return scanned.filter("entry_id IS NULL").select("doc_id", F.explode("diagnostics").alias("d")).select("doc_id", "d.*")


def extract(scanned: DataFrame, entry_id: str, decoded: bool = True) -> DataFrame:
    """Bytes of one entry, checked against the inventory's digest."""
    column, digest = ("decoded", "decoded_sha256") if decoded else ("stored", "stored_sha256")
    row = scanned.filter(F.col("entry_id") == entry_id)
    return row.select("doc_id", "entry_id", F.col(column).alias("bytes"), (F.sha2(column, 256) == F.col(digest)).alias("verified"))


def extract_resource(scanned: DataFrame, entry_id: str, path: str, offset: int, length: int, sha256: str) -> DataFrame:
    """A range of an entry, given only if path, range and digest all hold."""
    part = F.substring("decoded", offset + 1, length)
    row = scanned.filter((F.col("entry_id") == entry_id) & (F.col("path") == path) & (F.octet_length("decoded") >= offset + length))
    return row.select("doc_id", "entry_id", part.alias("bytes")).filter(F.sha2("bytes", 256) == sha256)


def embedded(scanned: DataFrame) -> DataFrame:
    """Documents inside documents (``VirtualComp/<name>``): path and content, ready for another scan."""
    inner = scanned.filter(F.col("path").rlike("^VirtualComp/[^/]+$") & F.col("decoded").isNotNull())
    name = F.element_at(F.split("path", "/"), -1)
    return inner.select(F.concat("doc_id", F.lit("#"), "path").alias("path"), F.col("doc_id").alias("container"), name.alias("embedded_name"), F.col("decoded").alias("content"))


def embedded_closure(files: DataFrame, most: int = 8, **options) -> DataFrame:
    """Entries of files and of all documents embedded in them, to any depth up to ``most``."""
    from lathe.operators.numbering import cut

    wanted = [*(options.pop("wanted", None) or []), "^VirtualComp/[^/]+$"]
    out = level = cut(entries(files, wanted=wanted, **options))
    for _ in range(most):
        inner = embedded(level)
        if inner.isEmpty():
            break
        level = cut(entries(inner, wanted=wanted, **options))
        out = out.unionByName(level)
    return out


def virtual_keys(inner: DataFrame) -> DataFrame:
    """Folded names under which an embedded document answers inside its container: its stem, and the stem before ``^``."""
    stem = F.regexp_replace("embedded_name", r"\.[^.]*$", "")
    keys = F.array_distinct(F.array(F.lower(stem), F.lower(F.element_at(F.split(stem, r"\^"), 1))))
    return inner.select("container", "path", F.explode(keys).alias("key"))


def write_json(df: DataFrame, path: str, force: bool = False) -> None:
    df.write.mode("overwrite" if force else "errorifexists").json(path)


def write_bytes(df: DataFrame, path: str, force: bool = False) -> None:
    """The one extracted row to one new file, through the store's own file system."""
    row = df.first()
    if row is None:
        raise LookupError("there is no such entry")
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = store.create(hadoop, force)
    out.write(bytearray(row["bytes"]))
    out.close()
