"""Differences of two versions: keyed rows and multisets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiset(before: DataFrame, after: DataFrame, signature: list[str]) -> DataFrame:
    """Counts kept, removed and added of each signature."""
    count = lambda df, name: df.groupBy(*signature).agg(F.count("*").alias(name))
    both = count(before, "n_before").unionByName(count(after, "n_after"), allowMissingColumns=True)
    summed = both.groupBy(*signature).agg(F.coalesce(F.sum("n_before"), F.lit(0)).alias("n_before"), F.coalesce(F.sum("n_after"), F.lit(0)).alias("n_after"))
    return summed.select(
        *signature, F.least("n_before", "n_after").alias("kept"), F.greatest(F.col("n_before") - F.col("n_after"), F.lit(0)).alias("removed"), F.greatest(F.col("n_after") - F.col("n_before"), F.lit(0)).alias("added")
    )


def exemplified(before: DataFrame, after: DataFrame, signature: list[str], order: list[str]) -> DataFrame:
    """``multiset``, with the first row (by ``order``) of each signature as an exemplar struct: of the side that has it, the earlier version's first."""
    sides = before.withColumn("_b", F.lit(1)).unionByName(after.withColumn("_b", F.lit(0)))
    rows = sides.groupBy(*signature).agg(
        F.sum("_b").alias("b"), F.sum(1 - F.col("_b")).alias("a"), F.min(F.when(F.col("_b") == 1, _first(before, signature, order))).alias("was"), F.min(F.when(F.col("_b") == 0, _first(before, signature, order))).alias("now")
    )
    return rows.select(
        *signature, F.least("a", "b").alias("kept"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("removed"), F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("added"), F.coalesce("was", "now").alias("exemplar")
    )


def _first(df: DataFrame, signature: list[str], order: list[str]):
    return F.struct(*order, *(c for c in df.columns if c not in (*signature, *order)))


def counted(statuses: DataFrame) -> DataFrame:
    """(status, n): how many keys of ``carriers`` were preserved, changed, removed and added."""
    return statuses.groupBy("status").agg(F.count("*").alias("n"))


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand more than once, which a keyed comparison doesn't allow."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, measure, n): sums of the counts of each part of a comparison, in one table.

    Parts are results of ``multiset``, ``records``, ``exemplified`` (columns of
    counts) or ``carriers`` (a column status).
    """
    measures = ("kept", "preserved", "changed", "removed", "added")
    out = None
    for name, df in parts.items():
        if "status" in df.columns:
            rows = df.groupBy(F.col("status").alias("measure")).agg(F.count("*").alias("n"))
        else:
            own = [m for m in measures if m in df.columns]
            entries = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("long").alias("n")) for m in own)))
            rows = df.select(entries.alias("e")).groupBy(F.when(F.col("e.measure") == "kept", "preserved").otherwise(F.col("e.measure")).alias("measure")).agg(F.sum("e.n").alias("n"))
        rows = rows.select(F.lit(name).alias("part"), "measure", "n")
        out = rows if out is None else out.unionByName(rows)
    return out.filter("n > 0")


def records(before: DataFrame, after: DataFrame, key: list[str], content: str) -> DataFrame:
    """preserved, changed, removed and added rows.

    A key that occurs once on both sides compares by content; rows of any other
    key compare as a multiset of (key, content).
    """
    rows = before.select(*key, content, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(*key, content, F.lit(0).alias("b"), F.lit(1).alias("a")))
    counted = rows.groupBy(*key, content).agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    keyed = counted.groupBy(*key).agg(
        F.sum("b").alias("nb"), F.sum("a").alias("na"), F.sum(F.least("a", "b")).alias("same"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("gone"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("new")
    )
    single = (F.col("nb") == 1) & (F.col("na") == 1)
    return keyed.select(
        *key, F.col("same").alias("preserved"), F.when(single & (F.col("same") == 0), 1).otherwise(0).alias("changed"), F.when(single, 0).otherwise(F.col("gone")).alias("removed"), F.when(single, 0).otherwise(F.col("new")).alias("added")
    )


def carriers(before: DataFrame, after: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """One row for each key of either side: preserved, changed, removed or added."""
    b = before.select(*key, F.struct(*content).alias("was"))
    a = after.select(*key, F.struct(*content).alias("now"))
    joined = b.join(a, key, "full_outer")
    status = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.col("was") == F.col("now"), "preserved").otherwise("changed")
    return joined.select(*key, status.alias("status"))


def hierarchy(records_: DataFrame, id_col: str, parent_col: str, shown: str) -> DataFrame:
    """Each record with its parent's shown column."""
    parent = records_.select(F.col(id_col).alias("_parent"), F.col(shown).alias("parent_shown"))
    return records_.join(parent, records_[parent_col] == parent["_parent"], "left").drop("_parent")
