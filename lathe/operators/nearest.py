"""Nearest segments by grid cells, distances, exact quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_segment(p: list[Column], a: list[Column], b: list[Column]) -> Column:
    """Distance of a point to a segment; a segment of no length is a point."""
    d = [y - x for x, y in zip(a, b, strict=True)]
    w = [y - x for x, y in zip(a, p, strict=True)]
    size = sum((x * x for x in d[1:]), d[0] * d[0])
    along = sum((x * y for x, y in zip(d[1:], w[1:], strict=True)), d[0] * w[0])
    t = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), along / size))).otherwise(0.0)
    miss = [q - (x + t * y) for q, x, y in zip(p, a, d, strict=True)]
    return F.sqrt(sum((x * x for x in miss[1:]), miss[0] * miss[0]))


def grid_nearest(points: DataFrame, segments: DataFrame, cell: float, rings: int = 2, axes: str = "xyz") -> DataFrame:
    """Distance of each point (id, x, y, z) to the nearest segment (segment, ax..bz) within ``rings`` cells; null if none is there.

    Segments are cut into pieces no longer than a cell and put down in the cells
    of their pieces, points look into the cells around theirs: an equi-join.
    """
    a, b = [F.col(f"a{x}") for x in axes], [F.col(f"b{x}") for x in axes]
    size = F.sqrt(sum(((q - p) * (q - p) for p, q in zip(a, b, strict=True)), F.lit(0.0)))
    pieces = F.greatest(F.lit(1), F.ceil(size / cell)).cast("int")
    steps = F.explode(F.sequence(F.lit(0), pieces))
    at = lambda x: F.floor((F.col(f"a{x}") + (F.col(f"b{x}") - F.col(f"a{x}")) * F.col("step") / F.col("pieces")) / cell)
    laid = segments.withColumn("pieces", pieces).select("*", steps.alias("step")).select(*segments.columns, *(at(x).alias(f"c{x}") for x in axes)).distinct()
    looks = points
    for x in axes:
        looks = looks.withColumn(f"c{x}", F.explode(F.sequence(F.floor(F.col(x) / cell) - rings, F.floor(F.col(x) / cell) + rings)))
    met = looks.join(laid, [f"c{x}" for x in axes])
    best = met.groupBy("id").agg(F.min(to_segment([F.col(x) for x in axes], a, b)).alias("distance"))
    return points.select("id").join(best, "id", "left")


def distribution(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Exact minimum, median, 95th percentile (nearest rank) and maximum.

    Values are counted first, so a group costs its distinct values.
    """
    keys = keys or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    upto = F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("n").over(w)
    placed = counts.withColumns({"upto": upto, "total": total})
    rank = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), F.col("v")))
    return placed.groupBy(*keys).agg(F.min("v").alias("minimum"), rank(F.lit(0.5)).alias("median"), rank(F.lit(0.95)).alias("p95"), F.max("v").alias("maximum"), F.max("total").alias("n"))


def fraction_within(df: DataFrame, value: str, limit: float, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(value) <= limit).cast("double")).alias("fraction"), F.count(value).alias("n"))


def index_quantile(df: DataFrame, value: str, fraction: float, keys: list[str]) -> DataFrame:
    """The value at place floor(fraction * n) of the sorted values, from 0 and at most the last; values are counted first."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    upto = F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumns({"upto": upto, "total": F.sum("n").over(w)})
    place = F.least(F.col("total") - 1, F.floor(F.lit(fraction) * F.col("total")))
    return placed.groupBy(*keys).agg(F.min(F.when(F.col("upto") > place, F.col("v"))).alias("quantile"))


def sample(df: DataFrame, id_col: str, limit: int, seed: int, keys: list[str]) -> DataFrame:
    """At most ``limit`` rows of each key: those with the smallest digests of seed and id, whatever the partitions."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    salted = df.withColumns({"_draw": draw, "_part": F.pmod(F.xxhash64(id_col), F.lit(64))})
    for by in ([*keys, "_part"], keys):  # a key of very many rows is ranked in parts first
        salted = salted.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy("_draw", id_col))).filter(F.col("_place") <= limit)
    return salted.select(df.columns)
