"""Interval algebra on half-open ranges [start, end), by key.

Union is gaps and islands: a row opens an island where it starts after every
earlier end of its key; touching ranges merge. The whole extent is cut into slices
and ranges at their borders, so a key that holds a third of all rows is merged
slice by slice; across slices only islands that touch a border meet, at most two
for each slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _islands(df: DataFrame, keys: list[str]) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.when(F.col("start") <= F.max("end").over(before), 0).otherwise(1)
    marked = df.withColumn("opens", opens).withColumn("island", F.sum("opens").over(upto))
    return marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def union(df: DataFrame, keys: list[str], slices: int = 64) -> DataFrame:
    """Disjoint, non-touching ranges that cover the same points; empty ranges vanish.

    Slices need ends of an integral type; others are merged by key alone.
    """
    rows = df.select(*keys, "start", "end").filter(F.col("end") > F.col("start"))
    if slices <= 1 or {rows.schema[c].dataType.typeName() for c in ("start", "end")} - {"byte", "short", "integer", "long"}:
        return _islands(rows, keys)
    extent = rows.agg(F.min("start").alias("low"), F.max("end").alias("high")).first()
    if extent["low"] is None:
        return rows
    low, width = extent["low"], max(1, -(-(extent["high"] - extent["low"]) // slices))
    number = F.explode(F.expr(f"sequence((start - {low}L) div {width}L, (end - 1 - {low}L) div {width}L)"))
    begin = F.lit(low) + F.col("slice") * F.lit(width)
    cut = rows.withColumn("slice", number).select(*keys, "slice", F.greatest("start", begin).alias("start"), F.least("end", begin + F.lit(width)).alias("end"))
    merged = _islands(cut, [*keys, "slice"])
    at_border = (F.col("start") == begin) | (F.col("end") == begin + F.lit(width))
    whole = _islands(merged.filter(at_border).drop("slice"), keys)
    return merged.filter(~at_border).drop("slice").unionByName(whole).select(*keys, *(F.col(c).cast(rows.schema[c].dataType).alias(c) for c in ("start", "end")))


def complement(islands: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """What the islands leave of each key's bounds (columns lower, upper)."""
    rows = bounds.join(islands, keys, "left")
    order = Window.partitionBy(*keys).orderBy("start")
    gaps = rows.select(
        *keys, "lower", "upper", "start", "end", F.lag("end").over(order).alias("before"), F.lead("start").over(order).alias("after")
    )
    head = F.struct(F.when(F.col("before").isNull(), F.col("lower")).alias("start"), F.when(F.col("before").isNull(), F.coalesce("start", "upper")).alias("end"))
    tail = F.struct(F.col("end").alias("start"), F.coalesce("after", "upper").alias("end"))
    return gaps.select(*keys, F.explode(F.array(head, tail)).alias("gap")).select(*keys, "gap.*").filter(F.col("end") > F.col("start"))


def partition(spans: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Typed islands and uninterpreted gaps that together fill the bounds."""
    typed = union(spans, keys)
    gaps = complement(typed, bounds, keys)
    return typed.withColumn("classification", F.lit("typed")).unionByName(gaps.withColumn("classification", F.lit("uninterpreted")))


def faulty(spans: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that are empty or reach outside their bounds, with a reason."""
    joined = spans.join(bounds, keys, "left")
    reason = (
        F.when(F.col("upper").isNull(), "unknown_domain")
        .when(F.col("end") <= F.col("start"), "empty")
        .when((F.col("start") < F.col("lower")) | (F.col("end") > F.col("upper")), "outside")
    )
    return joined.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(*keys, "start", "end", "reason")


def audit(stored: DataFrame, spans: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the stored partition and of the one recomputed that the other lacks."""
    columns = [*keys, "start", "end", "classification"]
    fresh = partition(spans, bounds, keys).select(columns)
    stored = stored.select(columns)
    return stored.exceptAll(fresh).withColumn("side", F.lit("stored")).unionByName(fresh.exceptAll(stored).withColumn("side", F.lit("recomputed")))
