"""Exact dedup by skew-safe combining.

1. *Local*: each task groups the rows it holds by whole normalised text (a
   dictionary keyed by the text itself), writing one row for each local group.
   The dictionary is flushed when it holds ``flush_bytes``, so memory is bounded.
2. *Salted*: local groups meet by (digest, salt, content). One text that makes
   up a third of the corpus is spread over ``salts`` tasks and each receives a
   row for each local group, not for each document.
3. *Global*: at most ``salts`` winners for each text meet by (digest, content).

Content travels losslessly compressed. Compression is a deterministic function
with an inverse, so equal payloads are equal texts and the group keys compare
full content at each stage; the digest only routes. If two texts ever share a
digest, members are attached by content instead of by digest.

Defined cases: null text counts as empty; null doc_id never wins against
another; of rows that repeat both doc_id and text exactly one is kept; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, gathered, lean, read, row_number_base, tidied

SALTS = 32
FLUSH_BYTES = 48 << 20

_LOCAL = "uid long, digest binary, payload binary, ids array<long>, top long, n long"


def local_groups(flush_bytes: int = FLUSH_BYTES, digest_bytes: int = 32):
    """mapInArrow function: rows (id, text) to local groups."""

    @tidied
    def run(batches):
        uid, held, size, squeeze = row_number_base(), {}, 0, zstandard.ZstdCompressor(level=1)

        def flush():
            nonlocal uid, size
            rows = [[], [], [], [], [], []]
            for text, ids in held.items():
                known = [x for x in ids if x is not None]
                values = (uid, hashlib.sha256(text).digest()[:digest_bytes], squeeze.compress(text), ids, max(known) if known else None, len(ids))
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
                uid += 1
            held.clear()
            size = 0
            types = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, types, strict=True)], names=["uid", "digest", "payload", "ids", "top", "n"])

        for batch in batches:
            texts = pc.ascii_lower(pc.fill_null(batch.column(1), "")).cast(pa.large_binary())
            for key, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                text = text.as_py()
                if (ids := held.get(text)) is None:
                    held[text] = [key]
                    size += len(text) + 200
                else:
                    ids.append(key)
                    size += 40
                if size >= flush_bytes:
                    yield flush()
        if held:
            yield flush()

    return run


def assignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, flush_bytes: int = FLUSH_BYTES, digest_bytes: int = 32) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, digest."""
    narrow = lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    local = cut(narrow.mapInArrow(local_groups(flush_bytes, digest_bytes), _LOCAL), "dedup-local")
    salted = local.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts))).groupBy("digest", "salt", "payload").agg(F.max(F.struct("top", "uid")).alias("win"), F.sum("n").alias("n"))
    whole = salted.groupBy("digest", "payload").agg(F.max("win").alias("win"), F.sum("n").alias("n"))
    by_digest = cut(whole.groupBy("digest").agg(F.max("win").alias("win"), F.sum("n").alias("size"), F.count("*").alias("texts")), "dedup-groups", narrow=True)
    members = local.select("digest", "uid", "ids", "top")
    clashing = by_digest.filter("texts > 1").select("digest")
    if clashing.isEmpty():
        found = members.join(by_digest.drop("texts"), "digest")
    else:
        clear = members.join(by_digest.filter("texts = 1").drop("texts"), "digest")
        mixed = whole.join(clashing, "digest", "left_semi").withColumnRenamed("n", "size")
        by_content = local.select("digest", "payload", "uid", "ids", "top").join(mixed, ["digest", "payload"])
        found = clear.unionByName(by_content.select(clear.columns))
    first = F.when(F.col("top").isNull(), F.lit(0)).otherwise(F.array_position("ids", F.col("top")) - 1)
    rows = found.select("digest", "uid", "win", "size", first.alias("at"), F.posexplode("ids").alias("pos", "doc_id"))
    return rows.select(
        "doc_id",
        F.col("win.top").alias("keep_id"),
        F.col("size").alias("group_size"),
        ((F.col("uid") == F.col("win.uid")) & (F.col("pos") == F.col("at"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    own_id, own_digest, place = fresh(docs, "own_id"), fresh(docs, "own_digest"), fresh(docs, "own_place")
    kept = assignments(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_digest"))
    digest = F.sha2(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase), 256)
    keyed = docs.withColumns({own_id: F.col(id_col).cast("long"), own_digest: digest})
    # Rows that repeat id and text are alike up to case and other columns; the first by its own text stays.
    one = Window.partitionBy(own_id, own_digest).orderBy(F.col(text_col).cast("string"))
    same = keyed[own_id].eqNullSafe(kept["kept_id"]) & (keyed[own_digest] == kept["kept_digest"])
    return keyed.join(kept, same, "left_semi").withColumn(place, F.row_number().over(one)).filter(F.col(place) == 1).select(docs.columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gathered(assignments(read(spark, sf_dir, "documents")))


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(t) AS h, t FROM (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents))
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
