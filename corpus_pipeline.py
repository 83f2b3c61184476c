"""Corpus pipeline: quality rules, exact dedup, SimHash near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and gives it to the next stage.
Mixing repeats and drops rows by their number of copies. The last stage adds
n_tokens, ids and the digests of ids and decoded text to the documents' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import bpe, exact_dedup, mixing, near, quality, simhash
from lathe.llm.common import cut, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.passing(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, more=near.merged)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode(docs, whole=True)
    n_tokens, decoded = (F.octet_length("ids") / 4).cast("long"), F.sha2(F.col("decoded").cast("binary"), 256)
    return coded.select("row.*", n_tokens.alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), decoded.alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The field of rates and the library's encoding have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
