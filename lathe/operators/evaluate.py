"""Evaluation of decoded topology: sampled edges, smoothness, bounds, losses.

edges: doc_id, id, body, kind (line, circle, ellipse, nurbs or null), low, high
(stored interval), derived_low, derived_high; for lines origin, direction; for
conics center, axis_x, axis_y, rx, ry; for free curves degree, knots, poles,
weights; faces (array of adjacent faces in use order), first_normal and
second_normal (outward unit normals at the edge's middle; null if unknown).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import conflicts, curves
from .numbering import cut


@dataclass(frozen=True)
class EvaluationOptions:
    chord_tolerance: float = 0.01
    most_segments: int = 512
    tangent_degrees: float = 0.5
    feature_degrees: float = 30.0
    configuration: str | None = None

    def __post_init__(self):
        if not (self.chord_tolerance > 0 and 1 <= self.most_segments <= 1_000_000 and 0 <= self.tangent_degrees <= 180 and 0 <= self.feature_degrees <= 180):
            raise ValueError("evaluation options are out of range")


#: reason: (loss code, severity)
REASONS = {
    "curve_missing": ("edge_curve_missing", "warning"), "definition_unreadable": ("curve_definition_unreadable", "warning"), "interval_unavailable": ("edge_interval_unavailable", "warning"), "segment_cap": ("edge_segment_cap", "warning"),
}


def interval(edges: DataFrame) -> DataFrame:
    """Stored interval, else the derived one, and which it is."""
    source = F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), "source").when(F.col("derived_low").isNotNull() & F.col("derived_high").isNotNull(), "derived").otherwise("unavailable")
    pick = lambda end: F.when(F.col("interval_source") == "source", F.col(end)).when(F.col("interval_source") == "derived", F.col(f"derived_{end}"))
    return edges.withColumn("interval_source", source).withColumns({"a": pick("low"), "b": pick("high")})


def line_interval(start: list[Column], end: list[Column], origin: Column, direction: Column) -> Column:
    """Parameters of an edge's ends on its line."""
    along = lambda p: sum(((p[k] - origin[k]) * direction[k] for k in range(1, 3)), (p[0] - origin[0]) * direction[0])
    return F.struct(F.least(along(start), along(end)).alias("low"), F.greatest(along(start), along(end)).alias("high"))


def polylines(edges: DataFrame, options: EvaluationOptions) -> DataFrame:
    """(doc_id, id, i, x, y, z): sampled points of all edges that can be sampled."""
    rows = interval(edges)
    ready = rows.filter(F.col("a").isNotNull())
    out = []
    ends = ready.filter("kind = 'line' AND origin IS NOT NULL AND direction IS NOT NULL").select("doc_id", "id", "origin", "direction", F.posexplode(F.array("a", "b")).alias("i", "t"))
    out.append(ends.select("doc_id", "id", "i", *((F.col("origin")[k] + F.col("t") * F.col("direction")[k]).alias(x) for k, x in enumerate("xyz"))))
    arcs = ready.filter("kind IN ('circle', 'ellipse') AND center IS NOT NULL").select("doc_id", "id", "center", "axis_x", "axis_y", "rx", F.coalesce("ry", "rx").alias("ry"), F.col("a").alias("start"), (F.col("b") - F.col("a")).alias("sweep"))
    out.append(curves.conic_points(arcs, options.chord_tolerance).select("doc_id", "id", "i", "x", "y", "z"))
    # One key for a document's edge; the pair itself is put back by splitting at the first sign that ids cannot hold.
    free = ready.filter("kind = 'nurbs' AND knots IS NOT NULL").select(F.concat_ws("\x1f", "doc_id", "id").alias("id"), "degree", "knots", "poles", "weights", F.col("a").alias("low"), F.col("b").alias("high"))
    parts = F.split("id", "\x1f")
    out.append(curves.sample_nurbs(free, options.chord_tolerance, options.most_segments).select(parts[0].alias("doc_id"), parts[1].alias("id"), "i", "x", "y", "z"))
    return reduce(DataFrame.unionByName, out)


def evaluated(edges: DataFrame, points: DataFrame, options: EvaluationOptions) -> DataFrame:
    """One row for each edge: status, reason, segments, smoothness, dihedral angle."""
    sampled = points.groupBy("doc_id", "id").agg((F.count("*") - 1).alias("segments"))
    rows = interval(edges).join(sampled, ["doc_id", "id"], "left")
    reason = F.when(F.col("segments").isNotNull(), None).when(F.col("kind").isNull(), "curve_missing").when(F.col("a").isNull(), "interval_unavailable").otherwise("definition_unreadable")
    uses = F.coalesce(F.size("faces"), F.lit(0))
    angle = F.when((uses == 2) & F.col("first_normal").isNotNull() & F.col("second_normal").isNotNull(), curves.dihedral(F.col("first_normal"), F.col("second_normal")))
    smooth = F.when(F.col("segments").isNull(), "unknown").when(uses == 1, "boundary").when(angle.isNull(), "unknown").when(angle <= options.tangent_degrees, "tangent").otherwise("sharp")
    return rows.select(
        "doc_id", "id", "body", F.coalesce("kind", F.lit("missing")).alias("curve_kind"), "interval_source", F.col("a").alias("low"), F.col("b").alias("high"), F.when(F.col("segments").isNotNull(), "sampled").otherwise("unsampled").alias("status"), reason.alias("reason"),
        F.coalesce("segments", F.lit(0)).alias("segments"), F.array_sort(F.array_distinct(F.coalesce("faces", F.array().cast("array<string>")))).alias("adjacent_faces"), uses.alias("uses"), smooth.alias("smoothness"),
        F.when(F.col("segments").isNotNull(), angle).alias("dihedral_degrees"), F.coalesce(F.col("kind").isin("line", "circle", "ellipse"), F.lit(False)).alias("analytic"),
    )


def losses(edge_rows: DataFrame, mesh_rows: DataFrame) -> DataFrame:
    """One row for each kind of loss and document."""
    by_reason = F.create_map(*(F.lit(x) for r, (code, _) in REASONS.items() for x in (r, code)))
    unsampled = edge_rows.filter("reason IS NOT NULL").select("doc_id", by_reason[F.col("reason")].alias("code"), F.lit("warning").alias("severity"))
    blind = edge_rows.filter("status = 'sampled' AND uses = 2 AND smoothness = 'unknown'").select("doc_id", F.lit("surface_normal_unavailable").alias("code"), F.lit("warning").alias("severity"))
    odd = edge_rows.filter("status = 'sampled' AND uses NOT IN (1, 2)").select("doc_id", F.lit("edge_use_count_unsupported").alias("code"), F.lit("warning").alias("severity"))
    still_open = mesh_rows.filter("NOT is_closed").select("doc_id", F.lit("mesh_not_closed").alias("code"), F.lit("info").alias("severity"))
    bad = mesh_rows.filter("rejected_triangles > 0").select("doc_id", F.lit("mesh_triangle_invalid").alias("code"), F.lit("warning").alias("severity"))
    every = reduce(DataFrame.unionByName, [unsampled, blind, odd, still_open, bad])
    return every.groupBy("doc_id", "code").agg(F.count("*").alias("n"), F.min("severity").alias("severity"))


def extents(edges: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Bounds from sampled points and, for arcs, their exact turning points."""
    arcs = interval(edges).filter("kind IN ('circle', 'ellipse') AND center IS NOT NULL AND a IS NOT NULL")
    e = curves.axis_extrema(F.col("center"), F.col("axis_x"), F.col("axis_y"), F.col("rx"), F.coalesce("ry", "rx"), F.col("a"), F.col("b") - F.col("a"))
    turning = arcs.select("doc_id", "id", e.alias("e")).select("doc_id", "id", F.explode(F.array(*(F.struct(*(F.col("e")[k][end].alias(x) for k, x in enumerate("xyz"))) for end in ("low", "high")))).alias("p")).select("doc_id", "id", "p.*")
    every = points.select("doc_id", "id", "x", "y", "z").unionByName(turning)
    owned = every.join(edges.select("doc_id", "id", *(k for k in keys if k != "doc_id")), ["doc_id", "id"])
    return owned.groupBy(*keys).agg(*(f(x).alias(f"{name}_{x}") for x in "xyz" for name, f in (("min", F.min), ("max", F.max))))


def summary(edge_rows: DataFrame) -> DataFrame:
    count = lambda c: F.count_if(c)
    s = F.col("smoothness")
    return edge_rows.groupBy("doc_id").agg(
        F.count("*").alias("edges"), count(F.col("status") == "sampled").alias("sampled_edges"), count(F.col("status") != "sampled").alias("unsampled_edges"), count(F.col("interval_source") == "derived").alias("derived_intervals"),
        count(s == "boundary").alias("boundary_edges"), count(s == "tangent").alias("tangent_edges"), count(s == "sharp").alias("sharp_edges"), count(s == "unknown").alias("unknown_edges"), F.sum("segments").alias("segments"),
    )


def selected_bodies(configurations: DataFrame, name: str) -> DataFrame:
    """(doc_id, bodies, state): bodies of the configuration of that name or id; null bodies mean the whole model.

    state: selected, whole_model (membership unknown), missing or ambiguous.
    """
    fits = F.count_if(F.coalesce(F.col("name") == name, F.lit(False)) | (F.col("id") == name))
    hit = F.when(F.coalesce(F.col("name") == name, F.lit(False)) | (F.col("id") == name), F.struct("bodies"))
    rows = configurations.groupBy("doc_id").agg(fits.alias("n"), F.first(hit, ignorenulls=True).alias("h"))
    state = F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").when(F.col("h.bodies").isNull(), "whole_model").otherwise("selected")
    return rows.select("doc_id", state.alias("state"), F.when(state == "selected", F.col("h.bodies")).alias("bodies"))


def evaluate(edges: DataFrame, mesh_rows: DataFrame, configurations: DataFrame | None = None, options: EvaluationOptions = EvaluationOptions()) -> dict[str, DataFrame]:  # noqa: B008
    """All evaluation tables. mesh_rows: doc_id and the columns of ``mesh.quantities``."""
    chosen = edges
    if options.configuration is not None and configurations is not None:
        wanted = selected_bodies(configurations, options.configuration).filter("state IN ('selected', 'whole_model')")
        chosen = edges.join(wanted, "doc_id").filter(F.col("bodies").isNull() | F.array_contains("bodies", F.col("body"))).select(edges.columns)
    points = cut(polylines(chosen, options))
    rows = cut(evaluated(chosen, points, options))
    return {"edges": rows, "points": points, "summary": summary(rows), "losses": losses(rows, mesh_rows), "body_bounds": extents(chosen, points, ["doc_id", "body"]), "bounds": extents(chosen, points, ["doc_id"])}


def matched_domains(ledger: DataFrame, extracted: DataFrame) -> DataFrame:
    """Each (stream, offset) of either side: matched, fields_differ, only_ledger, only_extracted or repeated."""
    key = lambda df, side: df.groupBy(F.lower("stream").alias("stream"), "offset").agg(F.count("*").alias(f"n_{side}"), F.min(F.struct("byte_len", "sha256")).alias(side))
    both = key(ledger, "ledger").join(key(extracted, "extracted"), ["stream", "offset"], "full_outer")
    status = (
        F.when(F.greatest(F.coalesce("n_ledger", F.lit(0)), F.coalesce("n_extracted", F.lit(0))) > 1, "repeated").when(F.col("extracted").isNull(), "only_ledger").when(F.col("ledger").isNull(), "only_extracted")
        .when(F.col("ledger") == F.col("extracted"), "matched").otherwise("fields_differ")
    )
    return both.select("stream", "offset", status.alias("status"))


def located(rows: DataFrame) -> DataFrame:
    """Entities with a place in the file, and distinct places."""
    return rows.groupBy("doc_id").agg(F.count("offset").alias("located"), F.count_distinct(F.when(F.col("offset").isNotNull(), F.struct(F.lower("stream"), "offset"))).alias("places"))


def outline_verdict(distances: DataFrame, tolerance: str, least: float = 0.98) -> DataFrame:
    """Do both directions of a display/model comparison lie within the tolerance? distances: doc_id, side, distance."""
    fractions = distances.groupBy("doc_id", "side").agg(F.avg((F.coalesce(F.col("distance"), F.lit(float("inf"))) <= F.col(tolerance)).cast("double")).alias("fraction"))
    return fractions.groupBy("doc_id").agg(F.min("fraction").alias("fraction"), F.count("*").alias("sides")).withColumn("agrees", (F.col("sides") == 2) & (F.col("fraction") >= least))


def report(edge_rows: DataFrame) -> DataFrame:
    """Loss book over all documents."""
    return conflicts.loss_book(edge_rows.filter("reason IS NOT NULL").select(F.col("reason").alias("code"), F.lit("warning").alias("severity")))
