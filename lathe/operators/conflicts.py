"""Facts from several pieces of evidence: agreement, ranking, accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Classes of interpretation, least first; a stream's class is its greatest.
CLASSES = ("uninterpreted", "fully", "partially", "malformed")


def agreed(value: Column) -> Column:
    """The value if all rows agree, else null; for use in an aggregation."""
    return F.when(F.count_distinct(value) == 1, F.max(value))


def withheld(rows: DataFrame, keys: list[str], value: str, evidence: str | None = None) -> DataFrame:
    """One row for each key: the agreed value, how many differ, and whether it is withheld."""
    aggs = [agreed(F.col(value)).alias("value"), F.count_distinct(value).alias("distinct_values"), (F.count_distinct(value) > 1).alias("withheld")]
    if evidence:
        aggs.append(F.array_sort(F.collect_set(evidence)).alias("evidence"))
    return rows.groupBy(*keys).agg(*aggs)


def ranked(rows: DataFrame, keys: list[str], value: str, priority: str, arrival: str) -> DataFrame:
    """Equal values merged at their best priority; place 1 is the name, others are alternates."""
    merged = rows.groupBy(*keys, value).agg(F.min(priority).alias("priority"), F.min(arrival).alias("arrival"))
    return merged.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("priority", "arrival")))


def upgraded(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The greatest class that any interpreter gave."""
    rank = F.array_position(F.array(*(F.lit(c) for c in CLASSES)), F.col(column))
    return rows.groupBy(*keys).agg(F.max(rank).alias("rank")).withColumn(column, F.element_at(F.array(*(F.lit(c) for c in CLASSES)), F.col("rank").cast("int"))).drop("rank")


def coverage(streams: DataFrame, keys: list[str], column: str, size: str) -> DataFrame:
    """Streams and bytes of each class by key."""
    aggs = []
    for c in CLASSES:
        aggs += [F.count_if(F.col(column) == c).alias(f"{c}_streams"), F.coalesce(F.sum(F.when(F.col(column) == c, F.col(size))), F.lit(0)).alias(f"{c}_bytes")]
    return streams.groupBy(*keys).agg(*aggs)


def consistent(covered: DataFrame, keys: list[str], totals: DataFrame) -> DataFrame:
    """Do the classes of ``coverage`` add up to the totals (keys, streams, bytes) of each key? A key without coverage doesn't."""
    total = lambda what: sum((F.col(f"{c}_{what}") for c in CLASSES[1:]), F.col(f"{CLASSES[0]}_{what}"))
    sums = covered.select(*keys, total("streams").alias("_streams"), total("bytes").alias("_bytes"))
    same = (F.col("streams") == F.col("_streams")) & (F.col("bytes") == F.col("_bytes"))
    return totals.join(sums, keys, "left").select(*keys, F.coalesce(same, F.lit(False)).alias("consistent"))


def loss_book(losses: DataFrame) -> DataFrame:
    """One row for each code: how often, and its severity."""
    return losses.groupBy("code").agg(F.count("*").alias("n"), F.min("severity").alias("severity"))


def paired(left: DataFrame, right: DataFrame, name: str, left_order: str, right_order: str) -> DataFrame:
    """The k-th row of each name on the left with the k-th on the right."""
    k = lambda df, order: df.withColumn("k", F.row_number().over(Window.partitionBy(name).orderBy(order)))
    return k(left, left_order).join(k(right, right_order), [name, "k"])
