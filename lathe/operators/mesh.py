"""Triangle meshes as long tables.

vertices: mesh_id, vertex, x, y, z. triangles: mesh_id, triangle, a, b, c.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def dot(u: list[Column], v: list[Column]) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def minus(u: list[Column], v: list[Column]) -> list[Column]:
    return [a - b for a, b in zip(u, v, strict=True)]


def norm(u: list[Column]) -> Column:
    return F.sqrt(dot(u, u))


def corners(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Triangles with nine coordinates; those that name a vertex that isn't there drop out."""
    out = triangles
    for corner in "abc":
        v = vertices.select("mesh_id", F.col("vertex").alias(corner), *(F.col(x).alias(f"{corner}{x}") for x in "xyz"))
        out = out.join(v, ["mesh_id", corner])
    return out


def measured(with_corners: DataFrame) -> DataFrame:
    """Area, signed volume share and unit normal (null if degenerate) of each triangle."""
    p = {c: [F.col(f"{c}{x}") for x in "xyz"] for c in "abc"}
    n = cross(minus(p["b"], p["a"]), minus(p["c"], p["a"]))
    size = norm(n)
    unit = F.when(size > 0, F.array(*(x / size for x in n)))
    return with_corners.select("mesh_id", "triangle", "a", "b", "c", (size / 2).alias("area"), (dot(p["a"], cross(p["b"], p["c"])) / 6).alias("volume"), unit.alias("normal"))


def edge_uses(measured_triangles: DataFrame) -> DataFrame:
    """Edges (lo < hi) with their uses: direction and triangle normal."""
    sides = F.explode(F.array(*(F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi"), (F.col(p) < F.col(q)).alias("forward")) for p, q in (("a", "b"), ("b", "c"), ("c", "a")))))
    rows = measured_triangles.select("mesh_id", "normal", sides.alias("s")).select("mesh_id", "s.*", "normal").filter("lo <> hi")
    # The first three uses decide everything; a count says whether there are more.
    place = F.row_number().over(Window.partitionBy("mesh_id", "lo", "hi").orderBy("forward"))
    some = F.collect_list(F.when(F.col("place") <= 2, F.struct("forward", "normal")))
    return rows.withColumn("place", place).groupBy("mesh_id", "lo", "hi").agg(F.count("*").alias("uses"), some.alias("u"))


def edge_kinds(uses: DataFrame, feature_degrees: float = 30.0) -> DataFrame:
    """boundary, closed (two opposite uses), feature (normals apart by the angle or more)."""
    first, second = F.element_at("u", 1), F.try_element_at("u", F.lit(2))
    n, m = ([first["normal"][i] for i in range(3)], [second["normal"][i] for i in range(3)])
    both = first["normal"].isNotNull() & second["normal"].isNotNull()
    two = F.col("uses") == 2
    return uses.select(
        "mesh_id", "lo", "hi", "uses", (F.col("uses") == 1).alias("boundary"), F.coalesce(two & (first["forward"] != second["forward"]), F.lit(False)).alias("closed"),
        F.coalesce(two & both & (dot(n, m) <= math.cos(math.radians(feature_degrees))), F.lit(False)).alias("feature"),
    )


def quantities(triangles: DataFrame, vertices: DataFrame, feature_degrees: float = 30.0) -> DataFrame:
    """Area, volume (null unless closed), closedness, boundary and feature edges of each mesh."""
    faces = measured(corners(triangles, vertices))
    sums = faces.groupBy("mesh_id").agg(F.count("*").alias("triangles"), F.sum("area").alias("area"), F.sum("volume").alias("signed_volume"))
    edges = edge_kinds(edge_uses(faces), feature_degrees).groupBy("mesh_id").agg(F.bool_and("closed").alias("is_closed"), F.count_if("boundary").alias("boundary_edges"), F.count_if("feature").alias("feature_edges"))
    wanted = triangles.groupBy("mesh_id").agg(F.count("*").alias("stored"))
    joined = wanted.join(sums, "mesh_id", "left").join(edges, "mesh_id", "left")
    whole = F.coalesce(F.col("is_closed") & (F.col("stored") == F.col("triangles")), F.lit(False))
    return joined.select("mesh_id", F.coalesce("triangles", F.lit(0)).alias("triangles"), (F.col("stored") - F.coalesce("triangles", F.lit(0))).alias("rejected_triangles"), "area", F.when(whole, F.abs("signed_volume")).alias("volume"), whole.alias("is_closed"), "boundary_edges", "feature_edges")


def masses(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Volume, area, centre of mass (null without volume) and bounds of each mesh, whether closed or not."""
    rows = corners(triangles, vertices)
    p = {c: [F.col(f"{c}{x}") for x in "xyz"] for c in "abc"}
    six = dot(p["a"], cross(p["b"], p["c"]))
    area = norm(cross(minus(p["b"], p["a"]), minus(p["c"], p["a"]))) / 2
    moments = [F.sum(six / 6 * (p["a"][k] + p["b"][k] + p["c"][k]) / 4).alias(f"m{x}") for k, x in enumerate("xyz")]
    sums = rows.groupBy("mesh_id").agg(F.count("*").alias("triangles"), F.sum(area).alias("area"), F.sum(six / 6).alias("signed"), *moments)
    box = vertices.groupBy("mesh_id").agg(F.count("*").alias("vertices"), *(f(x).alias(f"{n}_{x}") for x in "xyz" for n, f in (("min", F.min), ("max", F.max))))
    center = [F.when(F.abs("signed") > 1e-15, F.col(f"m{x}") / F.col("signed")).alias(f"center_{x}") for x in "xyz"]
    return box.join(sums, "mesh_id").select("mesh_id", "vertices", "triangles", F.abs("signed").alias("volume"), "area", *center, *(f"{n}_{x}" for x in "xyz" for n in ("min", "max")))


def welded(vertices: DataFrame) -> DataFrame:
    """Vertices with the first index of those at the same place (-0 is 0)."""
    zero = [(F.col(x) + F.lit(0.0)).alias(f"w{x}") for x in "xyz"]
    placed = vertices.select("mesh_id", "vertex", *zero)
    return placed.withColumn("canonical", F.min("vertex").over(Window.partitionBy("mesh_id", "wx", "wy", "wz"))).select("mesh_id", "vertex", "canonical")


def outline(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with one use after welding, in order of first occurrence."""
    map_ = welded(vertices)
    out = triangles
    for corner in "abc":
        out = out.join(map_.select("mesh_id", F.col("vertex").alias(corner), F.col("canonical").alias(f"w{corner}")), ["mesh_id", corner])
    sides = F.posexplode(F.array(*(F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi")) for p, q in (("wa", "wb"), ("wb", "wc"), ("wc", "wa")))))
    rows = out.select("mesh_id", "triangle", sides.alias("side", "e")).select("mesh_id", "e.*", (F.col("triangle") * 3 + F.col("side")).alias("at")).filter("lo <> hi")
    once = rows.groupBy("mesh_id", "lo", "hi").agg(F.count("*").alias("uses"), F.min("at").alias("at")).filter("uses = 1")
    return once.select("mesh_id", "lo", "hi", F.row_number().over(Window.partitionBy("mesh_id").orderBy("at")).alias("place"))


def normals(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Area-weighted unit normals by vertex; (0, 0, 1) where none is defined."""
    with_corners = corners(triangles, vertices)
    p = {c: [F.col(f"{c}{x}") for x in "xyz"] for c in "abc"}
    n = cross(minus(p["b"], p["a"]), minus(p["c"], p["a"]))
    rows = with_corners.select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vertex"), *(x.alias(f"n{k}") for k, x in zip("xyz", n, strict=True)))
    sums = rows.groupBy("mesh_id", "vertex").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in "xyz"))
    joined = vertices.select("mesh_id", "vertex").join(sums, ["mesh_id", "vertex"], "left")
    size = norm([F.col(f"n{k}") for k in "xyz"])
    return joined.select("mesh_id", "vertex", *(F.when(size > 0, F.col(f"n{k}") / size).otherwise(d).alias(f"n{k}") for k, d in zip("xyz", (0.0, 0.0, 1.0), strict=True)))


def strips(strips_: DataFrame) -> DataFrame:
    """Triangles of strips (strip, vertices array): every second one is turned."""
    i = F.explode(F.sequence(F.lit(0), F.size("vertices") - 3))
    v = lambda k: F.element_at("vertices", F.col("i") + k)
    rows = strips_.filter(F.size("vertices") >= 3).select("*", i.alias("i"))
    odd = F.col("i") % 2 == 1
    return rows.select("strip", F.col("i").alias("triangle"), v(1).alias("a"), F.when(odd, v(3)).otherwise(v(2)).alias("b"), F.when(odd, v(2)).otherwise(v(3)).alias("c"))


def bounds(points: DataFrame, keys: list[str], exact: str) -> DataFrame:
    """Extent, number of points, and whether all of them are exact."""
    return points.groupBy(*keys).agg(*(f(x).alias(f"{name}_{x}") for x in "xyz" for name, f in (("min", F.min), ("max", F.max))), F.count("*").alias("points"), F.bool_and(exact).alias("exact"))


def packed_offsets(parts: DataFrame, order: str, sizes: list[str], keys: list[str]) -> DataFrame:
    """Start of each part in the packed buffers."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("*", *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_offset") for s in sizes))
