"""Incremental ingest: new files become entries once, however often they arrive.

An extension: the batch operators run unchanged on each micro-batch. State is
the table of digests already taken in; a file whose bytes are known is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.sources import files
from lathe.sources.limits import SERVICE, Limits


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, limits: Limits = SERVICE, wanted: list[str] | None = None):
    """A query that ends when all files now below ``source`` are taken in; start it again to go on."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(source).filter(F.col("length") <= limits.input_bytes)

    def take(batch: DataFrame, _n: int) -> None:
        hashed = batch.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"])
        try:
            known = spark.read.parquet(f"{target}/files").select("sha256")
            hashed = hashed.join(known, "sha256", "left_anti")
        except Exception as fault:  # the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(fault):
                raise
        hashed = hashed.persist()
        files.entries(hashed, limits=limits, wanted=wanted).write.mode("append").parquet(f"{target}/entries")
        hashed.drop("content").write.mode("append").parquet(f"{target}/files")
        hashed.unpersist()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
