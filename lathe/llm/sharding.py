"""Uniform shuffle into shards by a hypergeometric communication matrix.

Law ``rows``: shard sizes differ by at most one. The rows of task p that go to
shard s are drawn before anything moves: a matrix with the tasks' row counts and
the exact shard sizes as margins, distributed as in a uniform permutation
(multivariate hypergeometric, row by row). Each task permutes its own rows and
deals them out by its row of the matrix; after the exchange, rows are permuted
again within their shard. The result is a uniform shuffle with exact sizes.

Only (id, size, crc, two numbers) move, not texts. The first permutation and
the second one's keys are drawn while reading and written with the table, so a
repeated task finds the same numbers. Slots are dealt in ``buckets`` of each
shard by key, so no task holds a whole shard.

The driver holds the matrix: tasks x shards integers. Defined cases: null text
has size 8 and crc 0; null and repeated doc_ids are rows like others; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, gathered, lean, read, tidied

SHARDS = 24
SEED = 20250
#: Rows of a shard that one task orders, about.
BUCKET_ROWS = 200_000
LEAST_BUCKETS = 16


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return np.full(shards, rows // shards) + (np.arange(shards) < rows % shards)


def matrix(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Rows of each task (axis 0) for each shard (axis 1)."""
    left = shard_sizes(int(counts.sum()), shards)
    rng = np.random.default_rng(seed)
    out = np.zeros((len(counts), shards), np.int64)
    for p, n in enumerate(counts):
        out[p] = rng.multivariate_hypergeometric(left, int(n), method="marginals") if left.sum() < 10**9 else _large_draw(rng, left, int(n))
        left = left - out[p]
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One draw by inversion, for urns above the generator's limit.

    Chances are taken relative to that of the mode, from the ratios of
    neighbours, whose errors stay near 1e-16 however large the urn; the sum over
    14 standard deviations on both sides stands for the whole, as what lies beyond
    is far below the resolution of a random number.
    """
    low, high = max(0, n - bad), min(n, good)
    whole = good + bad
    mode = min(max((n + 1) * (good + 1) // (whole + 2), low), high)
    share = good / whole
    reach = 40 + int(14 * math.sqrt(max(0.0, n * share * (1 - share) * (whole - n) / max(1, whole - 1))))
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    above = np.cumprod(((good - up) / (up + 1)) * ((n - up) / (bad - n + up + 1)))
    below = np.cumprod((down / (good - down + 1)) * ((bad - n + down) / (n - down + 1)))
    upto = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    return mode - len(below) + int(np.searchsorted(upto, rng.random() * upto[-1], "right"))


def _large_draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """Multivariate draw, shard by shard."""
    out, rest = np.zeros_like(left), int(left.sum())
    for s, good in enumerate(left):
        rest -= int(good)
        out[s] = hypergeometric(rng, int(good), rest, n) if rest else n
        n -= int(out[s])
    return out


def _local(seed: int):
    """Read a task's rows, and permute them."""

    @tidied
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held = [b for b in batches if b.num_rows]
        rows = sum(b.num_rows for b in held)
        if not rows:
            return
        rng = np.random.default_rng([seed, task])
        place = rng.permutation(rows)
        key = rng.integers(-(2**63), 2**63 - 1, rows, dtype=np.int64)
        at = 0
        for b in held:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, task, np.int64)), pa.array(place[at : at + n].astype(np.int64)), pa.array(key[at : at + n])], names=[*b.schema.names, "task", "place", "key"])
            at += n

    return run


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = cut(narrow.mapInArrow(_local(seed), "doc_id long, size long, text_crc32 long, task long, place long, key long"), "shard-rows")
    counts = sorted((r["task"], r["n"]) for r in dealt.groupBy("task").agg(F.count("*").alias("n")).collect())
    plan = matrix(np.array([n for _, n in counts], np.int64), shards, seed)
    total = int(plan.sum())
    ends = [(task, [int(x) for x in np.cumsum(row)]) for (task, _), row in zip(counts, plan, strict=True)]
    ends = spark.createDataFrame(ends, T.StructType([T.StructField("task", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType()))]))
    buckets = max(LEAST_BUCKETS, -(-total // (shards * BUCKET_ROWS)))
    shard = F.size(F.filter("ends", lambda e: e <= F.col("place"))).cast("int")
    bucket = F.pmod(F.shiftrightunsigned("key", 20), F.lit(buckets))
    sent = dealt.join(ends, "task").select("doc_id", "size", "text_crc32", shard.alias("shard"), bucket.alias("bucket"), "key", "task", "place")
    filled = sent.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = filled.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "bucket").orderBy("key", "task", "place")
    placed = sent.withColumn("n", F.row_number().over(inside)).join(base, ["shard", "bucket"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("n") - 1).cast("long").alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shuffle_into_shards(read(spark, sf_dir, "documents"))
    return gathered(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
