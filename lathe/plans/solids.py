"""Meshes with shared edges, closed solids, topology, evaluation and container reading on shapes made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe import engine
from lathe.operators import conflicts, curves, delta, mesh, nearest, topology

from .registry import query, table

# Parts are points of grids 20 wide and 10 high, their sizes the heights; suppliers are tetrahedra with legs of 1 to 9.
# Every fourth tetrahedron has a triangle more, which names a vertex that isn't there.

_GRID = "g AS (SELECT p_partkey // 200 AS mesh_id, p_partkey % 200 AS vertex, CAST(p_partkey % 20 AS DOUBLE) AS x, CAST(p_partkey % 200 // 20 AS DOUBLE) AS y, CAST(p_size AS DOUBLE) AS z FROM part)"
_CELLS = "c AS (SELECT a.mesh_id, a.vertex AS v FROM g a JOIN g b ON b.mesh_id = a.mesh_id AND b.vertex = a.vertex + 21 WHERE a.vertex % 20 < 19)"
_MESHES = f"""WITH {_GRID}, {_CELLS}, s AS (SELECT 1000000 + s_suppkey AS mesh_id, CAST(s_suppkey % 9 + 1 AS DOUBLE) AS k, s_suppkey % 4 = 0 AS odd FROM supplier),
vertices AS (SELECT * FROM g UNION ALL SELECT mesh_id, 0, 0, 0, 0 FROM s UNION ALL SELECT mesh_id, 1, k, 0, 0 FROM s UNION ALL SELECT mesh_id, 2, 0, k, 0 FROM s UNION ALL SELECT mesh_id, 3, 0, 0, k FROM s),
triangles AS (SELECT mesh_id, 2 * v AS triangle, v AS a, v + 1 AS b, v + 21 AS c FROM c UNION ALL SELECT mesh_id, 2 * v + 1, v, v + 21, v + 20 FROM c
  UNION ALL SELECT mesh_id, t[1], t[2], t[3], t[4] FROM (SELECT mesh_id, unnest([[0, 0, 2, 1], [1, 0, 1, 3], [2, 0, 3, 2], [3, 1, 2, 3]]) AS t FROM s) UNION ALL SELECT mesh_id, 4, 0, 1, 9 FROM s WHERE odd),
f AS (SELECT t.mesh_id, t.triangle, t.a, t.b, t.c, u.x AS ux, u.y AS uy, u.z AS uz, (v.y-u.y)*(w.z-u.z)-(v.z-u.z)*(w.y-u.y) AS nx, (v.z-u.z)*(w.x-u.x)-(v.x-u.x)*(w.z-u.z) AS ny, (v.x-u.x)*(w.y-u.y)-(v.y-u.y)*(w.x-u.x) AS nz,
  u.x*(v.y*w.z-v.z*w.y)+u.y*(v.z*w.x-v.x*w.z)+u.z*(v.x*w.y-v.y*w.x) AS six FROM triangles t
  JOIN vertices u ON u.mesh_id = t.mesh_id AND u.vertex = t.a JOIN vertices v ON v.mesh_id = t.mesh_id AND v.vertex = t.b JOIN vertices w ON w.mesh_id = t.mesh_id AND w.vertex = t.c),
n AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS size FROM f),
sides AS (SELECT mesh_id, a AS p, b AS q, nx / size AS nx, ny / size AS ny, nz / size AS nz FROM n UNION ALL SELECT mesh_id, b, c, nx / size, ny / size, nz / size FROM n UNION ALL SELECT mesh_id, c, a, nx / size, ny / size, nz / size FROM n),
edges AS (SELECT mesh_id, least(p, q) AS lo, greatest(p, q) AS hi, count(*) AS uses, count(*) = 1 AS boundary, count(*) = 2 AND count(*) FILTER (p < q) = 1 AS closed, CASE WHEN count(*) = 2 THEN
  min(nx)*max(nx) END AS ignored, list(nx) AS xs, list(ny) AS ys, list(nz) AS zs FROM sides GROUP BY 1, 2, 3),
kinds AS (SELECT *, coalesce(uses = 2 AND xs[1]*xs[2]+ys[1]*ys[2]+zs[1]*zs[2] <= cos(radians(30)), false) AS feature FROM edges)
"""


def _meshes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of grids and tetrahedra."""
    at = F.col("p_partkey")
    grid = table(spark, sf_dir, "part").select(
        F.floor(at / 200).alias("mesh_id"), (at % 200).alias("vertex"), (at % 20).cast("double").alias("x"), F.floor(at % 200 / 20).cast("double").alias("y"), F.col("p_size").cast("double").alias("z")
    )
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000).alias("mesh_id"), (F.col("s_suppkey") % 9 + 1).cast("double").alias("k"), (F.col("s_suppkey") % 4 == 0).alias("odd"))
    long = lambda v: F.lit(v).cast("long")
    zero, k = F.lit(0.0), F.col("k")
    point = lambda i, *p: F.struct(long(i).alias("vertex"), *(x.alias(n) for n, x in zip("xyz", p, strict=True)))
    corners = s.select("mesh_id", F.explode(F.array(point(0, zero, zero, zero), point(1, k, zero, zero), point(2, zero, k, zero), point(3, zero, zero, k))).alias("p")).select("mesh_id", "p.*")
    far = grid.select("mesh_id", (F.col("vertex") - 21).alias("vertex"))
    cells = grid.filter(F.col("vertex") % 20 < 19).join(far, ["mesh_id", "vertex"]).select("mesh_id", F.col("vertex").alias("v"))
    v = F.col("v")
    triangle = lambda *t: F.struct(*(x.alias(n) for n, x in zip(("triangle", "a", "b", "c"), t, strict=True)))
    flat = cells.select("mesh_id", F.explode(F.array(triangle(2 * v, v, v + 1, v + 21), triangle(2 * v + 1, v, v + 21, v + 20))).alias("t")).select("mesh_id", "t.*")
    faces = [(0, 0, 2, 1), (1, 0, 1, 3), (2, 0, 3, 2), (3, 1, 2, 3)]
    some = F.array(*(triangle(*map(long, t)) for t in faces))
    solid = s.select("mesh_id", F.explode(F.when(F.col("odd"), F.concat(some, F.array(triangle(*map(long, (4, 0, 1, 9)))))).otherwise(some)).alias("t")).select("mesh_id", "t.*")
    return grid.unionByName(corners), flat.unionByName(solid)


@query(_MESHES + """SELECT mesh_id, CAST(count(DISTINCT triangles.triangle) - max(lost) AS BIGINT) AS triangles, CAST(max(lost) AS BIGINT) AS rejected_triangles, any_value(area) AS area, any_value(CASE WHEN ok AND lost = 0 THEN volume END) AS volume,
  any_value(ok AND lost = 0) AS is_closed, CAST(any_value(nb) AS BIGINT) AS boundary_edges, CAST(any_value(nf) AS BIGINT) AS feature_edges
FROM triangles JOIN (SELECT mesh_id, round(sum(size) / 2, 4) AS area, round(abs(sum(six)) / 6, 4) AS volume, count(*) AS found FROM n GROUP BY mesh_id) USING (mesh_id)
JOIN (SELECT mesh_id, bool_and(closed) AS ok, count(*) FILTER (boundary) AS nb, count(*) FILTER (feature) AS nf FROM kinds GROUP BY mesh_id) USING (mesh_id)
JOIN (SELECT mesh_id, count(*) FILTER (c = 9 AND mesh_id >= 1000000) AS lost FROM triangles GROUP BY mesh_id) USING (mesh_id) GROUP BY mesh_id""")
def mesh_quantities(spark, sf_dir):
    vertices, triangles = _meshes(spark, sf_dir)
    out = engine.evaluate_meshes(vertices, triangles)
    return out.withColumns({"area": F.round("area", 4), "volume": F.round("volume", 4)})


@query(_MESHES + "SELECT mesh_id, lo, hi, CAST(uses AS BIGINT) AS uses, boundary, closed, feature FROM kinds")
def shared_edges(spark, sf_dir):
    vertices, triangles = _meshes(spark, sf_dir)
    return mesh.edge_kinds(mesh.edge_uses(mesh.measured(mesh.corners(triangles, vertices))))


@query(_MESHES + """, sums AS (SELECT mesh_id, vertex, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM (SELECT mesh_id, unnest([a, b, c]) AS vertex, nx, ny, nz FROM f) GROUP BY ALL)
SELECT mesh_id, vertex, CASE WHEN size > 0 THEN round(nx / size, 6) ELSE 0.0 END + 0.0 AS nx, CASE WHEN size > 0 THEN round(ny / size, 6) ELSE 0.0 END + 0.0 AS ny, CASE WHEN size > 0 THEN round(nz / size, 6) ELSE 1.0 END + 0.0 AS nz
FROM (SELECT v.mesh_id, v.vertex, nx, ny, nz, coalesce(sqrt(nx*nx+ny*ny+nz*nz), 0) AS size FROM vertices v LEFT JOIN sums s ON s.mesh_id = v.mesh_id AND s.vertex = v.vertex)""")
def shared_normals(spark, sf_dir):
    vertices, triangles = _meshes(spark, sf_dir)
    return mesh.normals(triangles, vertices).select("mesh_id", "vertex", *((F.round(f"n{k}", 6) + 0.0).alias(f"n{k}") for k in "xyz"))


@query(_MESHES + """SELECT v.mesh_id, CAST(v.n AS BIGINT) AS vertices, CAST(t.n AS BIGINT) AS triangles, round(abs(six) / 6, 4) AS volume, round(area, 4) AS area, CASE WHEN six <> 0 THEN round(mx / six, 3) + 0.0 END AS center_x, CASE WHEN six <> 0 THEN round(my / six, 3) + 0.0 END AS center_y, CASE WHEN six <> 0 THEN round(mz / six, 3) + 0.0 END AS center_z, low, high
FROM (SELECT mesh_id, count(*) AS n, min(z) AS low, max(z) AS high FROM vertices GROUP BY mesh_id) v JOIN (SELECT f.mesh_id, count(*) AS n, sum(six) AS six, sum(sqrt(nx*nx+ny*ny+nz*nz)) / 2 AS area, sum(six * (a.x + b.x + c.x)) / 4 AS mx, sum(six * (a.y + b.y + c.y)) / 4 AS my, sum(six * (a.z + b.z + c.z)) / 4 AS mz
  FROM f JOIN vertices a ON a.mesh_id = f.mesh_id AND a.vertex = f.a JOIN vertices b ON b.mesh_id = f.mesh_id AND b.vertex = f.b JOIN vertices c ON c.mesh_id = f.mesh_id AND c.vertex = f.c GROUP BY f.mesh_id) t USING (mesh_id)""")
def mesh_masses(spark, sf_dir):
    vertices, triangles = _meshes(spark, sf_dir)
    out = mesh.masses(triangles, vertices)
    center = [(F.round(f"center_{x}", 3) + 0.0).alias(f"center_{x}") for x in "xyz"]
    return out.select("mesh_id", "vertices", "triangles", F.round("volume", 4).alias("volume"), F.round("area", 4).alias("area"), *center, F.col("min_z").alias("low"), F.col("max_z").alias("high"))


# ---- topology: each supplier is a tetrahedron; some have an inner loop, some miss a face --------------------

_FACES = ((0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3))
_EDGES = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))


def _solids(spark, sf_dir, spoiled: bool = False) -> dict[str, DataFrame]:
    """Tables of one body for each supplier. ``spoiled``: one link of each, by its number, leads nowhere."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"))
    few = F.col("doc_id") % 5 == 1

    def rows(columns: list[str], values: list[tuple], kept=None) -> DataFrame:
        entry = F.explode(F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(columns, row, strict=True))) for row in values)))
        return s.select("doc_id", entry.alias("e")).select("doc_id", "e.*").filter(F.lit(True) if kept is None else kept)

    uses = [(f"c{f}.{i}", f"l{f}", f"e{_EDGES.index(tuple(sorted((face[i], face[(i + 1) % 3]))))}") for f, face in enumerate(_FACES) for i in range(3)]
    loops = rows(["id", "face"], [(f"l{f}", f"f{f}") for f in range(4)], ~(few & (F.col("id") == "l3")))
    tables = {
        "bodies": rows(["id"], [("b0",)]), "regions": rows(["id", "body"], [("r0", "b0")]), "shells": rows(["id", "region"], [("s0", "r0")]), "faces": rows(["id", "shell"], [(f"f{f}", "s0") for f in range(4)], ~(few & (F.col("id") == "f3"))),
        "loops": loops.unionByName(rows(["id", "face"], [("l9", "f0")], F.col("doc_id") % 3 == 0)), "coedges": rows(["id", "loop", "edge"], uses, ~(few & (F.col("loop") == "l3"))),
        "edges": rows(["id", "start", "end"], [(f"e{n}", f"v{a}", f"v{b}") for n, (a, b) in enumerate(_EDGES)]), "vertices": rows(["id", "point"], [(f"v{n}", f"p{n}") for n in range(4)]), "points": rows(["id"], [(f"p{n}",) for n in range(4)]),
    }
    if spoiled:
        for n, (child, column, _) in enumerate(topology.LINKS):
            wrong = (F.col("doc_id") % 9 == n) & F.col("id").endswith("0")
            tables[child] = tables[child].withColumn(column, F.when(wrong, "gone").otherwise(F.col(column)))
    return tables


@query("""SELECT s_suppkey AS doc_id, 'b0' AS body, s_suppkey % 3 <> 0 AS disks, CAST(4 - lost AS BIGINT) AS faces, CAST(4 - lost + inner_loops AS BIGINT) AS loops, CAST(6 AS BIGINT) AS edges, CAST(12 - 3 * lost AS BIGINT) AS coedges, CAST(4 AS BIGINT) AS vertices,
  CAST(3 * lost AS BIGINT) AS boundary_edges, CASE WHEN inner_loops = 0 THEN CAST(4 - 6 + 4 - lost AS BIGINT) END AS euler FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 1 THEN 1 ELSE 0 END AS lost, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS inner_loops FROM supplier)""")
def solid_census(spark, sf_dir):
    return topology.census(_solids(spark, sf_dir))


_LINKS = [(n, c, col, p) for n, (c, col, p) in enumerate(topology.LINKS)]
_FIRST = {"regions": ["r0"], "shells": ["s0"], "faces": ["f0"], "loops": ["l0"], "coedges": [f"c{f}.0" for f in range(4)], "edges": ["e0"], "vertices": ["v0"]}


@query(" UNION ALL ".join(
    f"""SELECT s_suppkey AS doc_id, '{c}' AS "table", id, '{col}' AS "column", '{p}' AS parent, 'gone' AS missing FROM supplier, (SELECT unnest({_FIRST[c]}) AS id) WHERE s_suppkey % 9 = {n}""" + (" AND NOT (s_suppkey % 5 = 1 AND id = 'c3.0')" if c == "coedges" else "")
    for n, c, col, p in _LINKS
))
def topology_links(spark, sf_dir):
    return topology.reference_errors(_solids(spark, sf_dir, spoiled=True))


@query("""SELECT s_suppkey AS doc_id, 'e' || n AS edge, 'b0' AS body, f[1] AS face, CAST(CASE WHEN s_suppkey % 5 = 1 AND n IN (3, 4, 5) THEN 1 ELSE 2 END AS BIGINT) AS uses
FROM supplier, (SELECT unnest(range(6)) AS n, unnest([['f0'], ['f0'], ['f1'], ['f0'], ['f1'], ['f2']]) AS f)""")
def edge_owners(spark, sf_dir):
    return topology.edge_owners(_solids(spark, sf_dir))


# ---- evaluation: each part is an edge of its brand's model ---------------------------------

_EDGE_ROWS = """SELECT p_brand AS doc_id, p_partkey, p_size, p_partkey % 5 AS kind, p_partkey % 3 AS uses,
  CASE WHEN p_partkey % 5 = 1 THEN CAST(least(greatest(ceil(round((pi() / 2) / least(2 * acos(greatest(-1.0, 1 - 0.01 / p_size)), pi() / 2), 9)), 1), 512) AS BIGINT) WHEN p_partkey % 5 IN (0, 4) THEN 1 ELSE 0 END AS segments FROM part"""


def _edges(spark, sf_dir) -> DataFrame:
    """Lines (stored or derived interval), quarter circles, edges without a curve and without an interval; one to three uses, normals 0, 0.4 or 10 degrees apart."""
    key, size, kind, uses = F.col("p_partkey"), F.col("p_size").cast("double"), F.col("p_partkey") % 5, F.col("p_partkey") % 3
    vector = lambda *v: F.array(*(x if isinstance(x, F.Column) else F.lit(float(x)) for x in v))
    angle = F.radians(F.element_at(F.array(*map(F.lit, (0.0, 0.4, 10.0))), (F.col("p_size") % 3 + 1).cast("int")))
    line, arc, none = kind.isin(0, 3, 4), kind == 1, F.lit(None).cast("double")
    faces = F.slice(F.array(*map(F.lit, ("f1", "f2", "f3"))), 1, uses.cast("int") + 1)
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("doc_id"), key.cast("string").alias("id"), F.concat(F.lit("b"), (F.col("p_size") % 2).cast("string")).alias("body"), F.when(line, "line").when(arc, "circle").alias("kind"),
        F.when(kind == 0, 0.0).when(arc, 0.0).alias("low"), F.when(kind == 0, size).when(arc, F.pi() / 2).alias("high"), F.when(kind == 4, -size).otherwise(none).alias("derived_low"), F.when(kind == 4, size).otherwise(none).alias("derived_high"),
        F.when(line, vector(1, 2, 3)).alias("origin"), F.when(line, vector(1, 0, 0)).alias("direction"), F.when(arc, vector(0, 0, 0)).alias("center"), F.when(arc, vector(1, 0, 0)).alias("axis_x"), F.when(arc, vector(0, 1, 0)).alias("axis_y"),
        F.when(arc, size).alias("rx"), F.when(arc, size).alias("ry"), F.lit(None).cast("int").alias("degree"), F.lit(None).cast("array<double>").alias("knots"), F.lit(None).cast("array<array<double>>").alias("poles"), F.lit(None).cast("array<double>").alias("weights"),
        faces.alias("faces"), vector(0, 0, 1).alias("first_normal"), vector(0.0, F.sin(angle), F.cos(angle)).alias("second_normal"),
    )


def _evaluated(spark, sf_dir) -> dict[str, DataFrame]:
    none = spark.createDataFrame([], "doc_id string, is_closed boolean, rejected_triangles long")
    return engine.evaluate(_edges(spark, sf_dir), none)


@query(f"""SELECT doc_id, CAST(count(*) AS BIGINT) AS edges, CAST(count(*) FILTER (kind IN (0, 1, 4)) AS BIGINT) AS sampled_edges, CAST(count(*) FILTER (kind IN (2, 3)) AS BIGINT) AS unsampled_edges, CAST(count(*) FILTER (kind = 4) AS BIGINT) AS derived_intervals,
  CAST(count(*) FILTER (kind IN (0, 1, 4) AND uses = 0) AS BIGINT) AS boundary_edges, CAST(count(*) FILTER (kind IN (0, 1, 4) AND uses = 1 AND p_size % 3 < 2) AS BIGINT) AS tangent_edges, CAST(count(*) FILTER (kind IN (0, 1, 4) AND uses = 1 AND p_size % 3 = 2) AS BIGINT) AS sharp_edges,
  CAST(count(*) FILTER (kind IN (2, 3) OR uses = 2) AS BIGINT) AS unknown_edges, CAST(sum(segments) AS BIGINT) AS segments FROM ({_EDGE_ROWS}) GROUP BY doc_id""")
def evaluation_summary(spark, sf_dir):
    return _evaluated(spark, sf_dir)["summary"]


@query(f"""SELECT doc_id, code, CAST(count(*) AS BIGINT) AS n, 'warning' AS severity FROM (SELECT doc_id, CASE WHEN kind = 2 THEN 'edge_curve_missing' WHEN kind = 3 THEN 'edge_interval_unavailable' WHEN uses = 2 THEN 'edge_use_count_unsupported' END AS code FROM ({_EDGE_ROWS})) WHERE code IS NOT NULL GROUP BY doc_id, code""")
def evaluation_losses(spark, sf_dir):
    return _evaluated(spark, sf_dir)["losses"]


@query(f"""SELECT doc_id, round(min(x0), 6) AS min_x, round(max(x1), 6) AS max_x, round(min(y0), 6) AS min_y, round(max(y1), 6) AS max_y, min(z) AS min_z, max(z) AS max_z FROM (
  SELECT doc_id, CASE kind WHEN 0 THEN 1 WHEN 4 THEN 1 - p_size ELSE 0 END AS x0, CASE kind WHEN 0 THEN 1 + p_size WHEN 4 THEN 1 + p_size ELSE p_size END AS x1, CASE WHEN kind = 1 THEN 0 ELSE 2 END AS y0, CASE WHEN kind = 1 THEN p_size ELSE 2 END AS y1, CASE WHEN kind = 1 THEN 0.0 ELSE 3.0 END::DOUBLE AS z
  FROM ({_EDGE_ROWS}) WHERE kind IN (0, 1, 4)) GROUP BY doc_id""".replace("round(min(x0), 6)", "CAST(min(x0) AS DOUBLE)").replace("round(max(x1), 6)", "CAST(max(x1) AS DOUBLE)").replace("round(min(y0), 6)", "CAST(min(y0) AS DOUBLE)").replace("round(max(y1), 6)", "CAST(max(y1) AS DOUBLE)"))
def evaluation_bounds(spark, sf_dir):
    out = _evaluated(spark, sf_dir)["bounds"]
    return out.select("doc_id", *(F.round(f"{end}_{x}", 6).alias(f"{end}_{x}") for x in "xyz" for end in ("min", "max")))


@query(f"""SELECT doc_id, 'b' || p_size % 2 AS body, CAST(min(CASE kind WHEN 0 THEN 1 WHEN 4 THEN 1 - p_size ELSE 0 END) AS DOUBLE) AS min_x, CAST(max(CASE kind WHEN 0 THEN 1 + p_size WHEN 4 THEN 1 + p_size ELSE p_size END) AS DOUBLE) AS max_x FROM ({_EDGE_ROWS}) WHERE kind IN (0, 1, 4) GROUP BY ALL""")
def body_bounds(spark, sf_dir):
    out = _evaluated(spark, sf_dir)["body_bounds"]
    return out.select("doc_id", "body", *(F.round(f"{end}_x", 6).alias(f"{end}_x") for end in ("min", "max")))


# ---- containers written from the tables and read back ---------------------------------------


def _packed(batches):
    """Documents as chunk files (even ids) or ZIP files (odd ids), each with a property stream and the text as another."""
    import io
    import struct
    import zipfile
    import zlib

    import pandas as pd

    from lathe.sources import containers

    def block(name: str, data: bytes) -> bytes:
        squeeze = zlib.compressobj(1, zlib.DEFLATED, -15)
        packed = squeeze.compress(data) + squeeze.flush()
        raw = bytes((b >> 4 | b << 4) & 0xFF for b in name.encode())
        return containers.CHUNK_MARKER + struct.pack("<5I", 7, zlib.crc32(data), len(packed), len(data), len(raw)) + raw + packed

    def properties(row) -> bytes:
        entry = lambda name, value: f'<property name="{name}">' + ("" if value is None else f"<lpstr>{value}</lpstr>") + "</property>"
        return ('<Properties><propertySection name="UserDefinedProperties">' + entry("lang", row.lang) + entry("source", row.source) + "</propertySection></Properties>").encode()

    for frame in batches:
        out = []
        for row in frame.itertuples():
            streams = {"docProps/custom.xml": properties(row), "Contents/Text": (row.text or "").encode()}
            if row.doc_id % 2:
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
                    for name, data in streams.items():
                        z.writestr(zipfile.ZipInfo(name), data)
                out.append((str(row.doc_id), held.getvalue()))
            else:
                out.append((str(row.doc_id), b"\0\0\0\0" + struct.pack(">I", 19000) + b"".join(block(n, d) for n, d in streams.items())))
        yield pd.DataFrame(out, columns=["path", "content"])


def _containers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").mapInPandas(_packed, "path string, content binary")


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'Contents/Text' AS path, CAST(octet_length(encode(text)) AS BIGINT) AS decoded_size, sha256(text) AS decoded_sha256, CASE WHEN doc_id % 2 = 1 THEN NULL ELSE CAST(19000 AS BIGINT) END AS format_version FROM documents""")
def container_texts(spark, sf_dir):
    found = engine.inventory(_containers(spark, sf_dir), "desktop").filter("path = 'Contents/Text'")
    return found.select("doc_id", "path", "decoded_size", "decoded_sha256", "format_version")


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, name, value AS raw_value, CASE WHEN value IS NULL THEN 'missing' ELSE 'present' END AS value_state FROM (SELECT doc_id, 'lang' AS name, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents)""")
def container_properties(spark, sf_dir):
    return engine.parse(_containers(spark, sf_dir), "desktop")["properties"].select("doc_id", "name", "raw_value", "value_state")


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 2 = 1 THEN 'zip_opc' ELSE 'modern_chunk' END AS envelope, 'recognized' AS status FROM documents""")
def container_probe(spark, sf_dir):
    return engine.probe(_containers(spark, sf_dir), "desktop").select(F.col("path").alias("doc_id"), "envelope", "status")




# ---- curves, quantiles, samples, coverage and comparison reports ------------------------------


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS id, t AS parameter, round((1-t)*(1-t)*a + 2*t*(1-t)*b + t*t*c, 6) + 0.0 AS x, round(2*(1-t)*(b-a) + 2*t*(c-b), 6) + 0.0 AS dx, round(t, 6) + 0.0 AS y, 1.0::DOUBLE AS dy
FROM (SELECT s_suppkey, s_suppkey % 7 AS a, s_suppkey % 11 AS b, s_suppkey % 5 AS c, CAST(s_suppkey % 4 AS DOUBLE) / 4 AS t FROM supplier)""")
def curve_derivatives(spark, sf_dir):
    """Quadratic curves with one span; rational and surface forms are tested against difference quotients."""
    key = F.col("s_suppkey")
    pole = lambda x, y: F.array(x.cast("double"), F.lit(float(y)), F.lit(0.0))
    rows = table(spark, sf_dir, "supplier").select(
        key.cast("string").alias("id"), F.lit(2).alias("degree"), F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0, 1.0, 1.0))).alias("knots"), F.array(pole(key % 7, 0), pole(key % 11, 0.5), pole(key % 5, 1)).alias("poles"),
        F.lit(None).cast("array<double>").alias("weights"), ((key % 4).cast("double") / 4).alias("parameter"),
    )
    return curves.derivatives(rows).select("id", "parameter", *((F.round(c, 6) + 0.0).alias(c) for c in ("x", "dx", "y", "dy")))


@query("""SELECT o_orderpriority, max(CASE WHEN k = least(n - 1, CAST(floor(0.98 * n) AS BIGINT)) THEN v END) AS quantile FROM (SELECT o_orderpriority, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) GROUP BY o_orderpriority""")
def index_quantile(spark, sf_dir):
    return nearest.index_quantile(table(spark, sf_dir, "orders"), "o_totalprice", 0.98, ["o_orderpriority"])


@query("""SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || vec_id), vec_id) AS place FROM embeddings) WHERE place <= 12""")
def seeded_sample(spark, sf_dir):
    return nearest.sample(table(spark, sf_dir, "embeddings").select("label", "vec_id"), "vec_id", 12, 7, ["label"])


@query("""SELECT lang, source, bool_and(n_chars IS NOT NULL) AND lang <> 'de' AS consistent FROM documents GROUP BY lang, source""")
def coverage_consistency(spark, sf_dir):
    """Totals of one language are overstated by a byte, which the check must tell."""
    docs = table(spark, sf_dir, "documents")
    state = F.element_at(F.array(*map(F.lit, conflicts.CLASSES)), (F.col("doc_id") % len(conflicts.CLASSES) + 1).cast("int"))
    covered = conflicts.coverage(docs.withColumn("class", state), ["lang", "source"], "class", "n_chars")
    totals = docs.groupBy("lang", "source").agg(F.count("*").alias("streams"), (F.sum("n_chars") + F.when(F.col("lang") == "de", 1).otherwise(0)).alias("bytes"))
    return conflicts.consistent(covered, ["lang", "source"], totals)


_VERSIONS = "a AS (SELECT lang, n_chars // 100 AS size_class, doc_id, md5(text) AS content FROM documents WHERE doc_id % 2 = 0), b AS (SELECT lang, n_chars // 100 AS size_class, doc_id, md5(text) AS content FROM documents WHERE doc_id % 2 = 1)"


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("lang", F.floor(F.col("n_chars") / 100).alias("size_class"), "doc_id", F.md5("text").alias("content"))
    return docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")


@query(f"""WITH {_VERSIONS} SELECT lang, size_class, CAST(least(x, y) AS BIGINT) AS kept, CAST(greatest(x - y, 0) AS BIGINT) AS removed, CAST(greatest(y - x, 0) AS BIGINT) AS added, coalesce(p, q) AS exemplar_id, coalesce(pc, qc) AS exemplar_content FROM (
  SELECT lang, size_class, coalesce(x, 0) AS x, coalesce(y, 0) AS y, p, q, pc, qc FROM (SELECT lang, size_class, count(*) AS x, min(doc_id) AS p, arg_min(content, doc_id) AS pc FROM a GROUP BY ALL)
  FULL JOIN (SELECT lang, size_class, count(*) AS y, min(doc_id) AS q, arg_min(content, doc_id) AS qc FROM b GROUP BY ALL) USING (lang, size_class))""")
def exemplified_delta(spark, sf_dir):
    out = delta.exemplified(*_versions(spark, sf_dir), ["lang", "size_class"], ["doc_id"])
    return out.select("lang", "size_class", "kept", "removed", "added", F.col("exemplar.doc_id").alias("exemplar_id"), F.col("exemplar.content").alias("exemplar_content"))


@query(f"""WITH {_VERSIONS}, s AS (SELECT lang, size_class, sum(x) AS x, sum(y) AS y FROM (SELECT lang, size_class, 1 AS x, 0 AS y FROM a UNION ALL SELECT lang, size_class, 0, 1 FROM b) GROUP BY ALL),
c AS (SELECT CASE WHEN b.role IS NULL THEN 'removed' WHEN a.role IS NULL THEN 'added' WHEN a.role = b.role AND a.text = b.text THEN 'preserved' ELSE 'changed' END AS measure FROM (SELECT * FROM conversations WHERE conv_id % 2 = 0) a FULL JOIN (SELECT conv_id - 1 AS conv_id, turn, role, text FROM conversations WHERE conv_id % 2 = 1) b USING (conv_id, turn))
SELECT 'sheets' AS part, measure, n FROM (SELECT 'preserved' AS measure, CAST(sum(least(x, y)) AS BIGINT) AS n FROM s UNION ALL SELECT 'removed', CAST(sum(greatest(x - y, 0)) AS BIGINT) FROM s UNION ALL SELECT 'added', CAST(sum(greatest(y - x, 0)) AS BIGINT) FROM s) WHERE n > 0
UNION ALL SELECT 'views', measure, CAST(count(*) AS BIGINT) FROM c GROUP BY measure""")
def comparison_report(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    views = delta.carriers(c.filter("conv_id % 2 = 0"), c.filter("conv_id % 2 = 1").withColumn("conv_id", F.col("conv_id") - 1), ["conv_id", "turn"], ["role", "text"])
    return delta.report({"sheets": delta.multiset(*_versions(spark, sf_dir), ["lang", "size_class"]), "views": views})


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN ['', 'outer', 'inner'][s_suppkey % 3 + 1] WHEN s_suppkey % 2 = 0 THEN 'inner' ELSE 'unspecified' END AS role FROM supplier""")
def boundary_roles(spark, sf_dir):
    key = F.col("s_suppkey")
    stored = F.when(key % 3 == 0, "unspecified").when(key % 3 == 1, "outer").otherwise("inner")
    return table(spark, sf_dir, "supplier").select("s_suppkey", topology.boundary_role(stored, F.when(key % 2 == 0, "inner")).alias("role"))


@query("""SELECT lang AS doc_id, CAST(count(*) AS BIGINT) AS records, CAST(count(*) FILTER (doc_id % 4 = 0) AS BIGINT) AS sheet_records, CAST(count(*) FILTER (doc_id % 4 = 1) AS BIGINT) AS view_records,
  CAST(count(DISTINCT (source, n_chars // 50, n_chars % 3)) AS BIGINT) AS distinct_ranges, CAST(count(*) FILTER (doc_id % 8 = 0) AS BIGINT) AS sheets, CAST(count(*) FILTER (doc_id % 8 = 1) AS BIGINT) AS views,
  CAST(count(*) FILTER (doc_id % 5 = 0) AS BIGINT) AS candidate_streams, CAST(coalesce(sum(n_chars) FILTER (doc_id % 5 = 0), 0) AS BIGINT) AS candidate_bytes, CAST(count(*) FILTER (doc_id % 4 = 1) - count(*) FILTER (doc_id % 8 = 1) AS BIGINT) AS unassigned_views,
  CAST(count(*) FILTER (doc_id % 4 = 2) AS BIGINT) AS notes FROM documents GROUP BY lang""")
def drawing_coverage(spark, sf_dir):
    from lathe.facts import resolve

    d, key = table(spark, sf_dir, "documents"), F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("sheet", "view", "note", "other"))), (key % 4 + 1).cast("int"))
    rows = d.select(F.col("lang").alias("doc_id"), F.col("source").alias("stream_path"), kind.alias("class"), F.floor(F.col("n_chars") / 50).alias("decoded_offset"), (F.col("n_chars") % 3).alias("byte_len"))
    own = F.col("lang").alias("doc_id")
    out = resolve.drawing_coverage(rows, d.filter(key % 8 == 0).select(own), d.filter(key % 8 == 1).select(own), d.filter(key % 5 == 0).select(own, F.col("n_chars").alias("decoded_size")))
    return out.withColumn("notes", F.coalesce(F.col("classes")["note"], F.lit(0))).drop("classes")


@query("""SELECT page_id % 50 AS doc_id, bool_or(page_id % 7 = 0 OR page_id % 11 = 3 OR page_id % 13 = 5) AS is_candidate FROM pages GROUP BY page_id % 50""")
def legacy_candidates(spark, sf_dir):
    from lathe.sources import probe

    key = F.col("page_id")
    path = F.when(key % 7 == 0, "/a/_MO_VERSION_12000/b").when(key % 11 == 3, "/").when(key % 13 == 5, "/Contents/CMgr").when(key % 2 == 0, F.col("url")).otherwise(F.lit(None))
    entries = table(spark, sf_dir, "pages").select((key % 50).alias("doc_id"), path.alias("path"), F.when(key % 11 == 3, F.create_map(F.lit("clsid"), F.lit(probe.ROOT_CLASSES[1]))).alias("attributes"))
    return probe.legacy_candidates(entries)
