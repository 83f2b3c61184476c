"""Topology tables: references between them, ownership, census.

Tables (keyed by doc_id and id): bodies; regions(body); shells(region); faces(shell);
loops(face, role); coedges(loop, edge); edges(start, end); vertices(point); points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: child table, column, parent table.
LINKS = (
    ("regions", "body", "bodies"), ("shells", "region", "regions"), ("faces", "shell", "shells"), ("loops", "face", "faces"), ("coedges", "loop", "loops"), ("coedges", "edge", "edges"),
    ("edges", "start", "vertices"), ("edges", "end", "vertices"), ("vertices", "point", "points"),
)


def dangling(child: DataFrame, column: str, parent: DataFrame, child_name: str, parent_name: str, doc: str = "doc_id", child_id: str = "id", parent_id: str = "id") -> DataFrame:
    """Rows whose reference is set but not found."""
    known = parent.select(F.col(doc), F.col(parent_id).alias(column)).distinct()
    lost = child.filter(F.col(column).isNotNull()).join(known, [doc, column], "left_anti")
    return lost.select(doc, F.lit(child_name).alias("table"), F.col(child_id).cast("string").alias("id"), F.lit(column).alias("column"), F.lit(parent_name).alias("parent"), F.col(column).cast("string").alias("missing"))


def reference_errors(tables: dict[str, DataFrame]) -> DataFrame:
    """All dangling references of the tables that are given."""
    found = [dangling(tables[c], col, tables[p], c, p) for c, col, p in LINKS if c in tables and p in tables]
    return reduce(DataFrame.unionByName, found)


def edge_owners(tables: dict[str, DataFrame]) -> DataFrame:
    """Body and face of each edge: those of its first coedge."""
    rows = tables["coedges"].select("doc_id", F.col("id").alias("coedge"), "loop", "edge")
    for table, column in (("loops", "face"), ("faces", "shell"), ("shells", "region"), ("regions", "body")):
        up = tables[table].select("doc_id", F.col("id").alias({"loops": "loop", "faces": "face", "shells": "shell", "regions": "region"}[table]), column)
        rows = rows.join(up, ["doc_id", up.columns[1]])
    return rows.groupBy("doc_id", "edge").agg(F.min_by("body", "coedge").alias("body"), F.min_by("face", "coedge").alias("face"), F.count("*").alias("uses"))


def census(tables: dict[str, DataFrame]) -> DataFrame:
    """Counts by body; V - E + F only where each face is a disk (one loop)."""
    faces = tables["faces"].select("doc_id", F.col("id").alias("face"), "shell")
    shells = tables["shells"].select("doc_id", F.col("id").alias("shell"), "region")
    regions = tables["regions"].select("doc_id", F.col("id").alias("region"), "body")
    owned = faces.join(shells, ["doc_id", "shell"]).join(regions, ["doc_id", "region"])
    loops = tables["loops"].select("doc_id", F.col("id").alias("loop"), "face")
    coedges = tables["coedges"].select("doc_id", "loop", F.col("id").alias("coedge"), "edge")
    edges = tables["edges"].select("doc_id", F.col("id").alias("edge"), "start", "end")
    rows = owned.join(loops, ["doc_id", "face"], "left").join(coedges, ["doc_id", "loop"], "left").join(edges, ["doc_id", "edge"], "left")
    per_face = rows.groupBy("doc_id", "body", "face").agg(F.count_distinct("loop").alias("n"))
    disks = per_face.groupBy("doc_id", "body").agg(F.bool_and(F.col("n") == 1).alias("disks"), F.count("*").alias("faces"), F.sum("n").alias("loops"))
    ends = rows.select("doc_id", "body", F.explode(F.array("start", "end")).alias("vertex")).groupBy("doc_id", "body").agg(F.count_distinct("vertex").alias("vertices"))
    counts = rows.groupBy("doc_id", "body").agg(F.count_distinct("edge").alias("edges"), F.count_distinct("coedge").alias("coedges"))
    uses = rows.filter(F.col("edge").isNotNull()).groupBy("doc_id", "body", "edge").agg(F.count_distinct("coedge").alias("n")).groupBy("doc_id", "body").agg(F.count_if(F.col("n") == 1).alias("boundary_edges"))
    out = disks.join(counts, ["doc_id", "body"]).join(ends, ["doc_id", "body"], "left").join(uses, ["doc_id", "body"], "left")
    return out.withColumn("euler", F.when(F.col("disks"), F.col("vertices") - F.col("edges") + F.col("faces")))


def instance_owner(instances: DataFrame) -> DataFrame:
    """Each instance with the first that holds the tables of its id."""
    first = F.min(F.when(F.col("owns_tables"), F.col("ordinal"))).over(Window.partitionBy("doc_id", "id"))
    return instances.withColumn("owner", first)


def boundary_role(stored: Column, derived: Column) -> Column:
    """A loop's stored role, else the derived one, else ``unspecified``."""
    return F.coalesce(F.nullif(stored, F.lit("unspecified")), derived, stored)
