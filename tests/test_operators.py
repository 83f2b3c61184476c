"""Operators on hand-made cases and against plain recomputation."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathe import engine
from lathe.functions import paths, values
from lathe.operators import bom, conflicts, curves, delta, graph, intervals, mesh, nearest, numbering, resolve, topology

# ---- paths and values ----------------------------------------------------------


def test_paths(spark):
    rows = [("C:\\a\\..\\b\\.\\X.SldPrt",), ("//srv/share/x",), ("/host/a//b/",), ("..\\..\\c",), ("",)]
    df = spark.createDataFrame(rows, "p string")
    p = F.col("p")
    got = df.select(paths.normalize(p), paths.lexical(paths.trim_drive(p)), paths.source_basename(p), paths.is_windows_absolute(p), paths.is_host_absolute(p)).collect()
    assert [tuple(r) for r in got] == [
        ("C:/a/../b/X.SldPrt", "b/X.SldPrt", "X.SldPrt", True, False), ("srv/share/x", "srv/share/x", "x", True, False), ("host/a/b", "host/a/b", "b", False, True), ("../../c", "c", "c", False, False), ("", "", None, False, False),
    ]
    r = df.limit(1).select(paths.has_prefix(F.lit("a/bc"), F.lit("a/b")), paths.has_prefix(F.lit("a/b/c"), F.lit("a/b")), paths.has_prefix(F.lit("a/b"), F.lit("a/b"))).first()
    assert tuple(r) == (False, True, True)


def test_values(spark):
    df = spark.createDataFrame([(" 12 ", "1,2,3,4,5,6,7,8,9,10,11,12,13", "1 nan 3")], "i string, m string, t string")
    r = df.select(
        values.strict_integer(F.col("i")).alias("strict"), values.trimmed_integer(F.col("i")).alias("trimmed"), values.mass_properties(F.col("m")).alias("m"), values.tokens(F.col("t"), 3).alias("t"), values.tristate(F.lit("No")).alias("no"), values.tristate(F.lit("?")).alias("odd"),
        values.occurrence_leaf(F.lit("Bolt-2@top")).alias("leaf"), values.packed_rgba(F.lit(0x40FF0080)).alias("c"),
    ).first()
    assert (r["strict"], r["trimmed"], r["t"], r["no"], r["odd"], r["leaf"]) == (None, 12, None, False, None, "Bolt-2")
    assert r["m"]["mass"] == "6" and r["m"]["rest"] == ["13"] and r["c"] == pytest.approx([128 / 255, 0, 1, 1])


# ---- intervals -------------------------------------------------------------------


@pytest.mark.parametrize("slices", [1, 3, 64])
def test_intervals_against_points(spark, slices):
    rng = random.Random(3)
    spans = [(k, a, a + rng.randrange(0, 6)) for k in ("a", "b") for a in (rng.randrange(0, 60) for _ in range(14))]
    df, bounds = spark.createDataFrame(spans, "k string, start long, end long"), spark.createDataFrame([("a", 0, 70), ("b", 0, 70), ("c", 5, 9)], "k string, lower long, upper long")

    def runs(points):
        out = []
        for x in sorted(points):
            if out and out[-1][1] == x:
                out[-1][1] = x + 1
            else:
                out.append([x, x + 1])
        return {tuple(r) for r in out}

    union = intervals.union(df, ["k"], slices)
    got = {k: {(r["start"], r["end"]) for r in union.collect() if r["k"] == k} for k in "ab"}
    covered = {k: {x for n, a, b in spans if n == k for x in range(a, b)} for k in "abc"}
    assert got == {k: runs(covered[k]) for k in "ab"}
    gaps = intervals.complement(union, bounds, ["k"]).collect()
    assert {k: {(r["start"], r["end"]) for r in gaps if r["k"] == k} for k in "abc"} == {k: runs(set(range(lo, hi)) - covered[k]) for k, lo, hi in (("a", 0, 70), ("b", 0, 70), ("c", 5, 9))}
    parts = intervals.partition(df, bounds, ["k"])
    assert intervals.audit(parts, df, bounds, ["k"]).count() == 0
    assert intervals.audit(parts.limit(3), df, bounds, ["k"]).filter("side = 'stored'").count() == 0
    faults = intervals.faulty(df.union(spark.createDataFrame([("a", 60, 99), ("z", 1, 2)], df.schema)), bounds, ["k"])
    assert {r["reason"] for r in faults.collect()} == {"outside", "unknown_domain"} | ({"empty"} if any(a == b for _, a, b in spans) else set())


def test_numbering(spark):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "v int").repartition(5)
    assert [r["row_number"] for r in numbering.number(df, ["v"]).orderBy("v").collect()] == list(range(1000))


# ---- resolution and graph ----------------------------------------------------------


def cascade(spark, files, refs, roots=(), searches=(), mappings=(), most=1024):
    f = spark.createDataFrame([(p, p) for p in files], "host_path string, label string")
    r = spark.createDataFrame([(n, p, d) for n, (p, d) in enumerate(refs)], "id int, stored string, document string")
    keys, file_keys = resolve.path_steps(F.col("stored"), F.col("document"), list(roots), list(searches), list(mappings))
    out = resolve.cascade(r, "id", keys, resolve.keyed_files(f, file_keys), F.coalesce(F.trim("stored"), F.lit("")) == "", most)
    return [(x["status"], None if x["step"] is None else resolve.BASES[x["step"]], x["candidate_count"], x["resolved"] or (x["candidates"] or None)) for x in out.orderBy("id").collect()]


@pytest.mark.parametrize("top", ["", "/", "file:///", "file:/"])
def test_cascade(spark, top):
    files = [top + p for p in ("proj/a/bolt.sldprt", "proj/b/Bolt.SLDPRT", "proj/a/sub/nut.sldprt", "lib/washer.sldprt", "lib/deep/only.sldprt")]
    doc = top + "proj/a/top.sldasm"
    got = cascade(
        spark, files,
        [("sub\\NUT.sldprt", doc), ("D:\\old\\bolt.sldprt", doc), ("D:\\old\\bolt.sldprt", top + "proj/c/x.sldasm"), ("W:\\store\\deep\\only.sldprt", doc), ("washer.sldprt", doc), ("nothing.sldprt", doc), (" ", doc), ("/lib/washer.sldprt", doc), ("..\\b\\bolt.sldprt", doc),
         ("Z:\\gone\\only.sldprt", doc), ("b\\bolt.sldprt", top + "else/x.sldasm"), (None, doc)],
        roots=[top + "proj"], searches=[top + "lib"], mappings=[("W:\\", top + "elsewhere"), ("W:\\store", top + "lib")],
    )
    assert got == [
        ("resolved", "document_relative", 1, files[2]), ("resolved", "document_directory_basename", 1, files[0]), ("ambiguous", "project_root_basename", 2, files[:2]), ("resolved", "windows_prefix_mapping", 1, files[4]),
        ("resolved", "search_directory_relative", 1, files[3]), ("missing", None, 0, None), ("no_stored_path", None, 0, None), ("resolved", "host_absolute", 1, files[3]), ("resolved", "document_relative", 1, files[1]),
        ("resolved", "search_directory_basename", 1, files[4]), ("resolved", "project_root_relative", 1, files[1]), ("no_stored_path", None, 0, None),
    ]


def test_folders_of_one_rule_share_a_step(spark):
    files = ["/s1/x/p.sldprt", "/s2/x/p.sldprt", "/s1/only.sldprt", "/m1/q.sldprt", "/m2/q.sldprt"]
    got = cascade(
        spark, files, [("x\\p.sldprt", "/proj/t.sldasm"), ("C:\\old\\p.sldprt", "/proj/t.sldasm"), ("only.sldprt", "/proj/t.sldasm"), ("W:\\lib\\q.sldprt", "/proj/t.sldasm"), ("w:/LIB/sub/../q.sldprt", "/proj/t.sldasm")],
        roots=["/proj"], searches=["/s1", "/s2"], mappings=[("W:\\lib", "/m1"), ("W:/lib/", "/m2"), ("W:\\", "/m1/none")],
    )
    assert got == [
        ("ambiguous", "search_directory_relative", 2, files[:2]), ("ambiguous", "search_directory_basename", 2, files[:2]), ("resolved", "search_directory_relative", 1, files[2]),
        ("ambiguous", "windows_prefix_mapping", 2, files[3:]), ("ambiguous", "windows_prefix_mapping", 2, files[3:]),
    ]
    assert cascade(spark, files, [("p.sldprt", "/proj/t.sldasm")], searches=["/s1", "/s2"], most=1) == [("ambiguous", "search_directory_basename", 2, files[:1])]


def test_embedded_names_come_first(spark):
    files = spark.createDataFrame([("/p/pin.sldprt", "pin.sldprt", None, None), (None, "top#VirtualComp/1", "/p/top.sldasm", "Pin"), (None, "other#VirtualComp/1", "/p/other.sldasm", "Pin")], "host_path string, label string, container string, embedded_name string")
    refs = spark.createDataFrame([(0, "C:\\tmp\\Pin^top.sldprt", "/p/top.sldasm", True), (1, "C:\\tmp\\pin.sldprt", "/p/top.sldasm", False), (2, "C:\\tmp\\pin.sldprt", "/p/else.sldasm", True)], "id int, stored string, document string, is_virtual boolean")
    keys, file_keys = resolve.path_steps(F.col("stored"), F.col("document"), ["/p"], [], [], F.col("is_virtual"))
    got = resolve.cascade(refs, "id", keys, resolve.keyed_files(files, file_keys), F.lit(False)).orderBy("id").collect()
    assert [(resolve.BASES[r["step"]], r["resolved"]) for r in got] == [("embedded_virtual_component", "top#VirtualComp/1"), ("document_directory_basename", "pin.sldprt"), ("document_directory_basename", "pin.sldprt")]


def labelled(spark, edges, roots, **options):
    rows = [("p", s, n, c, t, q, bool(sup)) for n, (s, c, t, q, sup) in enumerate(edges)]
    e = spark.createDataFrame(rows, "project string, source string, reference_id long, configuration long, target string, requested array<long>, is_suppressed boolean")
    r = spark.createDataFrame([("p", x, i) for i, x in enumerate(roots)], "project string, node string, root_order long")
    return [(x["source"], x["target"], x["traversal_status"]) for x in graph.label(e, r, **options).orderBy("edge_id").collect()]


def test_traversal_labels(spark):
    edges = [("top", 0, "sub", None, 0), ("top", 0, "leaf", None, 0), ("sub", 0, "leaf", None, 0), ("sub", 0, "top", None, 0), ("top", 0, None, None, 0), ("top", 0, "sub", None, 1)]
    assert labelled(spark, edges, ["top"]) == [
        ("top", "sub", "followed"), ("sub", "leaf", "followed"), ("sub", "top", "cycle"), ("top", "leaf", "reused"), ("top", None, "unresolved"), ("top", "sub", "suppressed"),
    ]
    assert [x[2] for x in labelled(spark, edges, ["top"], depth_cap=1)] == ["followed", "depth_limited", "cycle", "followed", "unresolved", "suppressed"]
    assert len(labelled(spark, edges, ["top"], edge_cap=2)) == 2


def test_edge_cap_rejects(spark):
    e = spark.createDataFrame([(p, "a", n, 0, f"b{n}", None, False) for p in ("x", "y") for n in range(3 if p == "x" else 2)], "project string, source string, reference_id long, configuration long, target string, requested array<long>, is_suppressed boolean")
    r = spark.createDataFrame([("x", "a", 0), ("y", "a", 0)], "project string, node string, root_order long")
    got = graph.label(e, r, edge_cap=2).groupBy("project", "rejected").count().collect()
    assert {tuple(x) for x in got} == {("x", True, 2), ("y", False, 2)}
    assert {x["rejected"] for x in graph.label(e, r, edge_cap=0).collect()} == {True}


def test_configurations_are_emitted_once(spark):
    edges = [("top", 0, "sub", [0], 0), ("top", 0, "sub", [1], 0), ("top", 0, "sub", [0], 0), ("sub", 0, "a", None, 0), ("sub", 1, "b", None, 0), ("sub", None, "ref", None, 0)]
    assert labelled(spark, edges, ["top"]) == [("top", "sub", "followed"), ("sub", "ref", "followed"), ("sub", "a", "followed"), ("top", "sub", "reused"), ("sub", "b", "followed"), ("top", "sub", "reused")]


def test_reach(spark):
    roots, edges = spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", "y")], "source string, target string")
    assert {r["node"]: r["depth"] for r in graph.reach(roots, edges).collect()} == {"a": 0, "b": 1, "c": 1}


# ---- bill of materials ------------------------------------------------------------

EDGE = "id string, source_node_id string, source_configuration_index long, ordinal int, target_node_id string, traversal_status string, referenced_configuration string, stored_path string, is_suppressed boolean, exclude_from_bom boolean, is_virtual boolean"
NODE = "id string, document_kind string, path string, configurations array<struct<index:long,name:string>>"


@pytest.fixture(scope="module")
def assembly(spark):
    d, both = [(0, "Default")], [(0, "Default"), (1, "Alternate")]
    nodes = [("root", "assembly", "root", both), ("sub", "assembly", "sub", d), ("leaf", "part", "leaf", d), ("bolt", "part", "bolt", d), ("spare", "part", "spare", d)]
    rows = [
        ("root", 0, "sub", "followed", None, None), ("root", 0, "sub", "reused", None, None), ("root", 0, "leaf", "suppressed", True, None), ("root", 0, None, "unresolved", None, None), ("root", 0, "spare", "followed", None, True),
        ("root", 1, "leaf", "followed", None, None), ("sub", 0, "leaf", "followed", None, None), ("sub", 0, "bolt", "followed", None, None), ("sub", 0, "bolt", "reused", None, None),
    ]
    edges = [(f"e{n}", s, c, n, t, label, None, "C:\\x\\Missing.sldprt" if t is None else t, sup, exc, None) for n, (s, c, t, label, sup, exc) in enumerate(rows)]
    return spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, NODE)


def quantities(items):
    return {r["node_id"] or r["unresolved_name"]: (r["quantity"], r["suppressed_quantity"], r["excluded_quantity"], r["minimum_depth"]) for r in items.collect()}


def test_bom(assembly):
    out = engine.bom(*assembly, "root", "Default")
    assert out["occurrences"].count() == 12
    assert quantities(out["items"]) == {"sub": (2, 0, 0, 1), "bolt": (4, 0, 0, 2), "leaf": (2, 1, 0, 1), "spare": (0, 0, 1, 1), "missing.sldprt": (1, 0, 0, 1)}
    parents = {r["id"]: r["parent_id"] for r in out["occurrences"].collect()}
    assert parents["occ:00000006"] == "occ:00000001" and parents["occ:00000009"] == "occ:00000002" and parents["occ:00000000"] is None
    whole = engine.bom(*assembly, "root", "Default", include_suppressed=True, include_excluded=True)
    assert quantities(whole["items"])["leaf"] == (3, 0, 0, 1) and quantities(whole["items"])["spare"] == (1, 0, 0, 1)
    assert engine.bom(*assembly, "root", "Alternate")["occurrences"].count() == 2
    with pytest.raises(ValueError, match="2 configurations"):
        engine.bom(*assembly, "root")
    capped = engine.bom(*assembly, "root", "Default", max_occurrences=3)["occurrences"].orderBy("id").collect()
    assert [r["children_state"] for r in capped] == ["limit_reached", "expanded", "expanded"]


def test_bom_order_on_random_trees(spark):
    rng = random.Random(9)
    for _ in range(3):
        children = {n: [f"n{rng.randrange(n + 1, 9)}" for _ in range(rng.randrange(0, 4))] if n < 8 else [] for n in range(9)}
        nodes = [(f"n{n}", "assembly", f"n{n}", [(0, "D")]) for n in range(9)]
        edges = [(f"e{n}.{i}", f"n{n}", 0, i, t, "followed", None, t, None, None, None) for n, ts in children.items() for i, t in enumerate(ts)]
        want, stack = ["n0"], ["n0"]
        while stack:
            kids = children[int(stack.pop()[1:])]
            want += kids
            stack += reversed(kids)
        if edges:
            got = bom.expand(spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, NODE), "n0", 0).orderBy("id").collect()
            assert [r["node_id"] for r in got] == want


def plain_bom(children, cap):
    """(node, state) in source order; expansion stops at the first row beyond the cap."""
    rows, stack = [["n0", "expanded"]], [0]
    while stack:
        at = stack.pop()
        kids = []
        for kid in children[rows[at][0]]:
            if len(rows) >= cap:
                rows[at][1] = "limit_reached"
                return [tuple(r) for r in rows]
            kids.append(len(rows))
            rows.append([kid, "expanded"])
        stack += reversed(kids)
    return [tuple(r) for r in rows]


def capped(spark, children, cap, **options):
    nodes = [(n, "assembly", n, [(0, "D")]) for n in children]
    edges = [(f"{n}.{i}", n, 0, i, t, "followed", None, t, None, None, None) for n, ts in children.items() for i, t in enumerate(ts)]
    out = bom.expand(spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, NODE), "n0", 0, bom.BomOptions(max_occurrences=cap, **options))
    return [(r["node_id"], r["children_state"]) for r in out.orderBy("id").collect()]


def test_bom_cap_on_a_lopsided_tree(spark):
    children = {"n0": ["c1", "c2"], "c1": ["d1"], "c2": [f"x{i}" for i in range(600)]} | {f"d{i}": [f"d{i + 1}"] for i in range(1, 5)} | {"d5": []} | {f"x{i}": [] for i in range(600)}
    for cap in (1, 2, 6, 9, 700):
        assert capped(spark, children, cap) == plain_bom(children, cap), cap


def test_bom_cap_on_random_trees(spark):
    rng = random.Random(3)
    for cap in (2, 5, 17):
        children = {f"n{n}": [f"n{rng.randrange(n + 1, 8)}" for _ in range(rng.choice((0, 1, 1, 5)))] if n < 7 else [] for n in range(8)}
        if any(children.values()):
            assert capped(spark, children, cap) == plain_bom(children, cap), (cap, children)


def test_bom_depth_cap_is_told(spark):
    children = {f"n{i}": [f"n{i + 1}"] for i in range(4)} | {"n4": []}
    assert capped(spark, children, None, max_depth=2) == [("n0", "expanded"), ("n1", "expanded"), ("n2", "limit_reached")]
    assert capped(spark, children, None, max_depth=4) == [(f"n{i}", "expanded") for i in range(5)]


# ---- differences, conflicts ----------------------------------------------------------


def test_record_delta(spark):
    b = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("c", "1"), ("d", "x")], "k string, content string")
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("c", "3"), ("e", "y")], "k string, content string")
    got = {r["k"]: (r["preserved"], r["changed"], r["removed"], r["added"]) for r in delta.records(b, a, ["k"], "content").collect()}
    assert got == {"a": (1, 0, 0, 0), "b": (0, 1, 0, 0), "c": (1, 0, 1, 1), "d": (0, 0, 1, 0), "e": (0, 0, 0, 1)}


def test_ranked_and_withheld(spark):
    rows = spark.createDataFrame([("x", "b", 1, 0), ("x", "a", 1, 1), ("x", "a", 0, 2), ("y", "c", 0, 3)], "k string, v string, p int, n int")
    assert [(r["k"], r["v"], r["place"]) for r in conflicts.ranked(rows, ["k"], "v", "p", "n").orderBy("k", "place").collect()] == [("x", "a", 1), ("x", "b", 2), ("y", "c", 1)]
    assert {r["k"]: (r["value"], r["withheld"]) for r in conflicts.withheld(rows, ["k"], "v").collect()} == {"x": (None, True), "y": ("c", False)}


# ---- meshes ------------------------------------------------------------------------

CUBE = [(x, y, z) for x in (0.0, 1.0) for y in (0.0, 1.0) for z in (0.0, 1.0)]
FACES = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]


def mesh_tables(spark, faces, points=CUBE):
    v = spark.createDataFrame([("m", i, *p) for i, p in enumerate(points)], "mesh_id string, vertex int, x double, y double, z double")
    return spark.createDataFrame([("m", i, *f) for i, f in enumerate(faces)], "mesh_id string, triangle int, a int, b int, c int"), v


def test_cube(spark):
    r = mesh.quantities(*mesh_tables(spark, FACES)).first()
    assert (r["area"], r["volume"], r["is_closed"], r["feature_edges"], r["boundary_edges"]) == (pytest.approx(6), pytest.approx(1), True, 12, 0)
    r = mesh.quantities(*mesh_tables(spark, FACES[1:])).first()
    assert (r["volume"], r["is_closed"], r["boundary_edges"]) == (None, False, 3)
    turned = [(0, 3, 1), *FACES[1:]]
    assert mesh.quantities(*mesh_tables(spark, turned)).first()["is_closed"] is False
    r = mesh.quantities(*mesh_tables(spark, [*FACES, (0, 1, 99)])).first()
    assert (r["rejected_triangles"], r["volume"]) == (1, None)


def test_outline_and_normals(spark):
    points = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (1.0, -0.0, 0.0), (1.0, 1.0, 0.0), (-0.0, 1.0, 0.0), (9.0, 9.0, 9.0)]
    t, v = mesh_tables(spark, [(0, 1, 2), (3, 4, 5)], points)
    assert [(r["lo"], r["hi"]) for r in mesh.outline(t, v).orderBy("place").collect()] == [(0, 1), (0, 2), (1, 4), (2, 4)]
    assert {r["vertex"]: (r["nx"], r["ny"], r["nz"]) for r in mesh.normals(t, v).collect()} == dict.fromkeys(range(7), (0.0, 0.0, 1.0))
    s = spark.createDataFrame([(1, [5, 6, 7, 8])], "strip int, vertices array<int>")
    assert [(r["a"], r["b"], r["c"]) for r in mesh.strips(s).collect()] == [(5, 6, 7), (6, 8, 7)]


# ---- topology -------------------------------------------------------------------------


def cube_topology(spark):
    """Six faces of four edges each on one body."""
    sides = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    edges = sorted({tuple(sorted((q[i], q[(i + 1) % 4]))) for q in sides for i in range(4)})
    name = {e: f"e{i}" for i, e in enumerate(edges)}
    t = lambda rows, columns: spark.createDataFrame(rows, "doc_id string, id string, " + columns)
    coedges = [("d", f"c{f}.{i}", f"l{f}", name[tuple(sorted((q[i], q[(i + 1) % 4])))]) for f, q in enumerate(sides) for i in range(4)]
    return {
        "bodies": spark.createDataFrame([("d", "b")], "doc_id string, id string"), "regions": t([("d", "r", "b")], "body string"), "shells": t([("d", "s", "r")], "region string"), "faces": t([("d", f"f{i}", "s") for i in range(6)], "shell string"),
        "loops": t([("d", f"l{i}", f"f{i}") for i in range(6)], "face string"), "coedges": t(coedges, "loop string, edge string"), "edges": t([("d", name[e], f"v{e[0]}", f"v{e[1]}") for e in edges], "start string, end string"),
        "vertices": t([("d", f"v{i}", f"p{i}") for i in range(8)], "point string"), "points": spark.createDataFrame([("d", f"p{i}") for i in range(8)], "doc_id string, id string"),
    }


def test_topology(spark):
    tables = cube_topology(spark)
    assert topology.reference_errors(tables).count() == 0
    r = topology.census(tables).first()
    assert (r["vertices"], r["edges"], r["faces"], r["coedges"], r["euler"], r["boundary_edges"]) == (8, 12, 6, 24, 2, 0)
    owners = topology.edge_owners(tables).collect()
    assert len(owners) == 12 and {(o["body"], o["uses"]) for o in owners} == {("b", 2)}
    holed = tables | {"loops": tables["loops"].union(spark.createDataFrame([("d", "l9", "f0")], tables["loops"].schema))}
    assert topology.census(holed).first()["euler"] is None
    for child, column, _ in topology.LINKS:
        first = tables[child].select(F.min("id").alias("m")).first()["m"]
        broken = tables | {child: tables[child].withColumn(column, F.when(F.col("id") == first, "lost").otherwise(F.col(column)))}
        assert [(e["table"], e["column"], e["missing"]) for e in topology.reference_errors(broken).collect()] == [(child, column, "lost")]


# ---- curves ---------------------------------------------------------------------------


def test_arcs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(30):
        a, b = rng.normal(size=3), rng.normal(size=3)
        a /= np.linalg.norm(a)
        b = np.cross(a, b)
        b /= np.linalg.norm(b)
        rows.append((rng.normal(size=3).tolist(), a.tolist(), b.tolist(), float(rng.uniform(1, 5)), float(rng.uniform(1, 5)), float(rng.uniform(-7, 7)), float(rng.uniform(-6, 6))))
    df = spark.createDataFrame(rows, "center array<double>, axis_x array<double>, axis_y array<double>, rx double, ry double, start double, sweep double")
    got = df.select("*", curves.axis_extrema(*(F.col(c) for c in df.columns)).alias("e")).collect()
    for r in got:
        t = np.linspace(r["start"], r["start"] + r["sweep"], 20_001)
        p = np.array(r["center"]) + r["rx"] * np.cos(t)[:, None] * np.array(r["axis_x"]) + r["ry"] * np.sin(t)[:, None] * np.array(r["axis_y"])
        assert [x["low"] for x in r["e"]] == pytest.approx(p.min(axis=0), abs=1e-5) and [x["high"] for x in r["e"]] == pytest.approx(p.max(axis=0), abs=1e-5)
    points = curves.conic_points(df.filter("rx > ry").limit(1), 0.001).count()
    assert points > 20


def test_conic_interval(spark):
    r = spark.range(1).select(curves.conic_interval(F.lit(0.5), F.lit(0.5), F.lit(True)).alias("full"), curves.conic_interval(F.lit(6.0), F.lit(1.0), F.lit(True)).alias("over"), curves.conic_interval(F.lit(1.0), F.lit(0.5), F.lit(False)).alias("back")).first()
    assert r["full"]["high"] - r["full"]["low"] == pytest.approx(2 * math.pi)
    assert (r["over"]["low"], r["over"]["high"]) == pytest.approx((6.0, 1.0 + 2 * math.pi)) and (r["back"]["low"], r["back"]["high"]) == pytest.approx((0.5, 1.0))


def test_nurbs(spark):
    s = math.sqrt(0.5)
    circle = ("q", 2, [0.0, 0.0, 0.0, 1.0, 1.0, 1.0], [[1.0, 0.0, 0.0], [1.0, 1.0, 0.0], [0.0, 1.0, 0.0]], [1.0, s, 1.0], 0.0, 1.0)
    df = spark.createDataFrame([circle], "id string, degree int, knots array<double>, poles array<array<double>>, weights array<double>, low double, high double")
    rows = curves.sample_nurbs(df, 1e-3).orderBy("i").collect()
    assert all(r["x"] ** 2 + r["y"] ** 2 == pytest.approx(1) for r in rows) and all(r["within_tolerance"] for r in rows) and 8 < len(rows) < 100
    assert not curves.sample_nurbs(df, 1e-9, most=4).first()["within_tolerance"]
    knots, poles = np.array([0, 0, 0, 0, 1, 2, 3, 3, 3, 3.0]), np.random.default_rng(2).normal(size=(6, 3))
    for t in (0.0, 0.4, 1.0, 1.7, 3.0):
        d = {i: p for i, p in enumerate(poles)}
        span = min(max(int(np.searchsorted(knots, t, "right")) - 1, 3), 5)
        q = [d[span - 3 + i] for i in range(4)]
        for k in range(1, 4):
            for j in range(3, k - 1, -1):
                i = span - 3 + j
                w = (t - knots[i]) / (knots[i + 4 - k] - knots[i])
                q[j] = (1 - w) * q[j - 1] + w * q[j]
        assert curves.nurbs_point(3, knots, poles, None, t) == pytest.approx(q[3])


def test_normals_of_surfaces(spark):
    a = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    n = lambda kind, p, half=0.0, major=0.0: curves.surface_normal(F.lit(kind), a(0, 0, 1), a(0, 0, 0), a(*p), F.lit(half), F.lit(major))
    r = spark.range(1).select(n("plane", (1, 2, 3)), n("cylinder", (0, 2, 5)), n("sphere", (0, 0, -3)), n("torus", (6, 0, 0), 0.0, 5.0), n("other", (1, 0, 0)), n("sphere", (0, 0, 0)), curves.dihedral(a(0, 0, 1), a(0, 1, 0))).first()
    assert [r[i] for i in range(4)] == [[0, 0, 1], [0, 1, 0], [0, 0, -1], [1, 0, 0]] and r[4] is None and r[5] == [None] * 3 and r[6] == pytest.approx(90)


def square(face, loop, x, y, size):
    corners = [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]
    return [("d", face, loop, i, float(u), float(v)) for i, (u, v) in enumerate(corners)]


def test_loop_roles(spark):
    rows = square("holes", "a", 0, 0, 10) + square("holes", "b", 1, 1, 2) + square("holes", "c", 5, 5, 2) + square("apart", "a", 0, 0, 1) + square("apart", "b", 5, 5, 1) + square("cross", "a", 0, 0, 4) + square("cross", "b", 2, 2, 4)
    rows += square("nest", "a", 0, 0, 9) + square("nest", "b", 1, 1, 6) + square("nest", "c", 2, 2, 2) + [("d", "bow", "a", i, float(u), float(v)) for i, (u, v) in enumerate([(0, 0), (2, 2), (2, 0), (0, 3)])]
    got = {(r["face"], r["loop"]): r["role"] for r in curves.loop_roles(spark.createDataFrame(rows, "doc_id string, face string, loop string, i int, u double, v double")).collect()}
    assert [got["holes", x] for x in "abc"] == ["outer", "inner", "inner"]
    assert {got[f, "a"] for f in ("apart", "cross", "nest", "bow")} == {None}


def test_grid_nearest_and_quantiles(spark):
    rng = np.random.default_rng(4)
    p, s = rng.uniform(0, 3, (60, 3)), rng.uniform(0, 3, (12, 6))
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id int, x double, y double, z double")
    segments = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(s)], "segment int, ax double, ay double, az double, bx double, by double, bz double")

    def off(q, x):
        a, d = x[:3], x[3:] - x[:3]
        return float(np.linalg.norm(q - a - np.clip((q - a) @ d / (d @ d), 0, 1) * d))

    got = {r["id"]: r["distance"] for r in nearest.grid_nearest(points, segments, 0.5).collect()}
    for i, q in enumerate(p):
        best = min(off(q, x) for x in s)
        if best <= 0.5:
            assert got[i] == pytest.approx(best)
        assert got[i] is None or got[i] >= best - 1e-9
    values_ = [float(x) for x in rng.integers(0, 50, 101)]
    r = nearest.distribution(spark.createDataFrame([(v,) for v in values_], "v double"), "v").first()
    order = sorted(values_)
    assert (r["minimum"], r["median"], r["p95"], r["maximum"]) == (order[0], order[50], order[math.ceil(0.95 * 101) - 1], order[-1])


# ---- evaluation -----------------------------------------------------------------------


def test_evaluate(spark):
    from lathe.operators import evaluate

    schema = (
        "doc_id string, id string, body string, kind string, low double, high double, derived_low double, derived_high double, origin array<double>, direction array<double>, center array<double>, axis_x array<double>, axis_y array<double>, rx double, ry double, "
        "degree int, knots array<double>, poles array<array<double>>, weights array<double>, faces array<string>, first_normal array<double>, second_normal array<double>"
    )
    empty = dict.fromkeys(x.strip().split()[0] for x in schema.split(","))
    up, side = [0.0, 0.0, 1.0], [0.0, 1.0, 0.0]
    rows = [
        empty | {"doc_id": "d", "id": "line", "body": "b", "kind": "line", "derived_low": 0.0, "derived_high": 2.0, "origin": [1.0, 0.0, 0.0], "direction": [1.0, 0.0, 0.0], "faces": ["f", "g"], "first_normal": up, "second_normal": side},
        empty | {"doc_id": "d", "id": "arc", "body": "b", "kind": "circle", "low": 0.0, "high": math.pi, "center": [0.0, 0.0, 5.0], "axis_x": [1.0, 0.0, 0.0], "axis_y": side, "rx": 2.0, "faces": ["f"]},
        empty | {"doc_id": "d", "id": "free", "body": "c", "kind": "nurbs", "low": 0.0, "high": 1.0, "degree": 1, "knots": [0.0, 0.0, 1.0, 1.0], "poles": [[0.0, 0.0, 0.0], [9.0, 9.0, 9.0]], "faces": ["f", "g"], "first_normal": up, "second_normal": up},
        empty | {"doc_id": "d", "id": "none", "body": "c"}, empty | {"doc_id": "d", "id": "open", "body": "c", "kind": "line", "origin": up, "direction": up},
    ]
    edges = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    meshes = spark.createDataFrame([("d", False, 1)], "doc_id string, is_closed boolean, rejected_triangles int")
    configurations = spark.createDataFrame([("d", "0", "Small", ["b"]), ("d", "1", "All", None)], "doc_id string, id string, name string, bodies array<string>")
    out = evaluate.evaluate(edges, meshes, configurations)
    got = {r["id"]: (r["status"], r["reason"], r["interval_source"], r["smoothness"]) for r in out["edges"].collect()}
    assert got == {
        "line": ("sampled", None, "derived", "sharp"), "arc": ("sampled", None, "source", "boundary"), "free": ("sampled", None, "source", "tangent"), "none": ("unsampled", "curve_missing", "unavailable", "unknown"), "open": ("unsampled", "interval_unavailable", "unavailable", "unknown"),
    }
    box = {r["body"]: r for r in out["body_bounds"].collect()}
    assert (box["b"]["min_x"], box["b"]["max_x"], box["b"]["max_y"], box["b"]["max_z"]) == pytest.approx((-2, 3, 2, 5)) and box["c"]["max_x"] == pytest.approx(9)
    assert {r["code"]: r["n"] for r in out["losses"].collect()} == {"edge_curve_missing": 1, "edge_interval_unavailable": 1, "mesh_not_closed": 1, "mesh_triangle_invalid": 1}
    assert out["summary"].first()["sampled_edges"] == 3
    small = evaluate.evaluate(edges, meshes, configurations, evaluate.EvaluationOptions(configuration="Small"))
    assert {r["id"] for r in small["edges"].collect()} == {"line", "arc"}
    states = {n: evaluate.selected_bodies(configurations, n).first()["state"] for n in ("Small", "1", "?")}
    assert states == {"Small": "selected", "1": "whole_model", "?": "missing"}
    with pytest.raises(ValueError, match="options"):
        evaluate.EvaluationOptions(chord_tolerance=0)


def test_domains_and_verdict(spark):
    from lathe.operators import evaluate

    schema = "stream string, offset long, byte_len long, sha256 string"
    ledger = spark.createDataFrame([("A", 0, 5, "x"), ("A", 5, 5, "y"), ("B", 0, 1, "z"), ("C", 0, 1, "q"), ("C", 0, 1, "q")], schema)
    found = spark.createDataFrame([("a", 0, 5, "x"), ("a", 5, 6, "y"), ("d", 0, 1, "z"), ("C", 0, 1, "q")], schema)
    got = {(r["stream"], r["offset"]): r["status"] for r in evaluate.matched_domains(ledger, found).collect()}
    assert got == {("a", 0): "matched", ("a", 5): "fields_differ", ("b", 0): "only_ledger", ("d", 0): "only_extracted", ("c", 0): "repeated"}
    rows = spark.createDataFrame([("d", s, v, 0.5) for s in ("model", "display") for v in (0.1, 0.2)] + [("e", "model", 0.1, 0.5), ("e", "display", 0.9, 0.5)], "doc_id string, side string, distance double, tolerance double")
    assert {r["doc_id"]: r["agrees"] for r in evaluate.outline_verdict(rows, "tolerance").collect()} == {"d": True, "e": False}


def test_cylinder_roles(spark):
    def ring(loop, face, low, high, bottom, top, forward):
        corners = [(low, bottom), (high, bottom), (high, top), (low, top)]
        return [("d", face, loop, i, (u + math.pi) % (2 * math.pi) - math.pi, float(v), 2.0) for i, (u, v) in enumerate(corners if forward else corners[::-1])]

    rows = ring("o", "ok", 2.0, 4.5, 0, 9, True) + ring("h", "ok", 3.0, 3.5, 2, 4, False) + ring("o", "bad", 0.0, 1.0, 0, 9, True) + ring("h", "bad", 2.0, 3.0, 2, 4, False)
    df = spark.createDataFrame(rows, "doc_id string, face string, loop string, i int, angle double, height double, radius double")
    assert {(r["face"], r["loop"]): r["role"] for r in curves.cylinder_roles(df).collect()} == {("ok", "o"): "outer", ("ok", "h"): "inner", ("bad", "o"): None, ("bad", "h"): None}


def test_nurbs_interval():
    knots, poles = [0, 0, 0, 1, 2, 2, 2], [[0, 0, 0], [1, 2, 0], [2, -1, 0], [4, 0, 0]]
    p = curves.nurbs_point(2, knots, poles, None, 0.7)
    assert curves.nurbs_interval(2, knots, poles, None, p) == pytest.approx(0.7, abs=1e-9)
    assert curves.nurbs_interval(2, knots, poles, None, p + 1) is None and curves.nurbs_interval(2, knots, poles[::-1][:1] * 4, None, p) is None


def test_configuration_facts(spark):
    from lathe.facts import binary, resolve

    configs = spark.createDataFrame([("d", 0, "A", ["B"]), ("d", 1, "B", None), ("e", 0, "X", None)], "doc_id string, configuration_index long, name string, alternate_names array<string>")
    asked = spark.createDataFrame([("d", "A"), ("d", "B"), ("d", "?"), ("d", None), ("e", "X")], "doc_id string, requested string")
    got = {(r["doc_id"], r["requested"]): (r["status"], r["indices"]) for r in resolve.selected_configurations(asked, configs).collect()}
    assert got == {("d", "A"): ("selected", [0]), ("d", "B"): ("ambiguous", []), ("d", "?"): ("missing", []), ("d", None): ("selected", [0, 1]), ("e", "X"): ("selected", [0])}
    candidates = spark.createDataFrame([("d", "s", 0, 7, None, None, None, None, None)], "doc_id string, stream_path string, ordinal int, configuration_index long, name string, priority int, parent_name string, parent_index long, material string")
    properties = spark.createDataFrame([("d", "p", 1, "SW-Configuration Name", "Active", "lpstr", "present", "system", "global", None)], "doc_id string, stream_path string, ordinal int, name string, raw_value string, value_type string, value_state string, kind string, scope string, configuration_index long")
    assert resolve.configurations(resolve.with_name_fallbacks(candidates, properties)).first()["name"] == "Active"
    raw = b"\x02\x00" + b"".join(b"\xff\xfe\xff" + bytes([len(n)]) + n.encode("utf-16-le") for n in ("S1", "S2")) + b"\0"
    assert binary.sheet_names(raw) == ["S1", "S2"]
    names = binary.sheet_name_rows(spark.createDataFrame([("d", bytearray(raw)), ("e", bytearray(b"\x01\x00zz"))], "doc_id string, decoded binary"))
    sheets = spark.createDataFrame([("d", 0, "S2"), ("d", 1, "S2"), ("d", 2, "other")], "doc_id string, ordinal int, name string")
    previews = spark.createDataFrame([("d", 1, "Images/Sheet_1")], "doc_id string, ordinal int, path string")
    assert {r["ordinal"]: r["preview"] for r in resolve.sheet_previews(sheets, names, previews).collect()} == {0: "Images/Sheet_1", 1: None, 2: None}
    kinds = spark.createDataFrame([("x/a.SLDPRT", "assembly"), ("x/b.sldasm", "assembly")], "doc_id string, document_kind string")
    assert [(r["announced"], r["document_kind"]) for r in resolve.extension_mismatches(kinds).collect()] == [("part", "assembly")]


def test_binary_functions(spark):
    from lathe.functions import binary

    df = spark.createDataFrame([(bytearray(b"\x01\x02\xff\xfe\x00\x00\x00\x80\xff\xff\xff\xff\xff\xff\xff\xff"),)], "b binary")
    b = F.col("b")
    r = df.select(
        binary.unsigned(b, 0, 2), binary.unsigned(b, 0, 2, little=False), binary.unsigned(b, 4, 4), binary.unsigned(b, 14, 4), binary.unsigned_text(b, 8), binary.checked_end(F.lit(2**63 - 1), F.lit(1)), binary.checked_end(F.lit(1), F.lit(2), F.lit(3))
    ).first()
    assert tuple(r) == (0x0201, 0x0102, 0x80000000, None, str(2**64 - 1), None, 6)
    labels = spark.createDataFrame([("a/b.sldprt",), ("",), ("/a",), ("C:\\a",), ("a/../b",), ("a//b",)], "l string")
    assert [x[0] for x in labels.select(binary.label_fault(F.col("l"))).collect()] == [None, "blank", "absolute", "absolute", "leaves_folder", "not_normal"]
    nested = spark.createDataFrame([], "a string, s struct<host_path:string,x:array<struct<absolute_path:int>>>")
    assert binary.path_fields(nested) == ["s.host_path", "s.x[].absolute_path"]


def test_free_curves_and_surfaces_have_exact_derivatives():
    import numpy as np

    rng = np.random.default_rng(1)
    knots, surface_knots = [0, 0, 0, 0.4, 0.7, 1, 1, 1], ([0, 0, 0, 0.5, 1, 1, 1], [0, 0, 1, 2, 2])
    poles, weights = rng.normal(size=(5, 3)), rng.uniform(0.5, 2, 5)
    net, held = rng.normal(size=(4, 3, 3)), rng.uniform(0.5, 2, (4, 3))
    step = 1e-6
    for t in (0.1, 0.39, 0.55, 0.9):
        point, change = curves.nurbs_derivative(2, knots, poles, weights, t)
        at = lambda x: curves.nurbs_point(2, knots, poles, weights, x)
        assert np.allclose(point, at(t)) and np.allclose(change, (at(t + step) - at(t - step)) / (2 * step), atol=1e-4)
        u, v = t, 2 * t
        on = lambda a, b: curves.nurbs_surface((2, 1), surface_knots, net, held, a, b)[0]
        _, du, dv = curves.nurbs_surface((2, 1), surface_knots, net, held, u, v)
        assert np.allclose(du, (on(u + step, v) - on(u - step, v)) / (2 * step), atol=1e-4) and np.allclose(dv, (on(u, v + step) - on(u, v - step)) / (2 * step), atol=1e-4)
        normal = curves.nurbs_normal((2, 1), surface_knots, net, held, u, v)
        assert abs(normal @ du) < 1e-9 and abs(normal @ dv) < 1e-9 and abs(np.linalg.norm(normal) - 1) < 1e-12


def test_parsing_holds_few_rows(spark, monkeypatch):
    """Rows of facts leave the task in small batches, however many streams came in one."""
    from lathe.facts import streams
    from lathe.sources.limits import DESKTOP

    xml = b'<swDoc><swHeader>%s</swHeader></swDoc>' % b"".join(b'<swFile id="%d" swPath="a > b" swDocType="PART"/>' % i for i in range(300))
    given = spark.createDataFrame([(f"d{i}", "e", streams.TREE, xml) for i in range(40)] + [("bad", "e", streams.TREE, b"<a")], "doc_id string, entry_id string, path string, decoded binary").coalesce(1)
    whole = type(given).mapInArrow
    sizes = spark.sparkContext.accumulator(0)
    most = 2 * streams.ROWS_HELD

    def watched(self, run, schema):
        def counted(batches):
            for batch in run(batches):
                sizes.add(int(batch.num_rows > most))
                yield batch

        return whole(self, counted, schema)

    monkeypatch.setattr(type(given), "mapInArrow", watched)
    found = streams.tables(given, DESKTOP)
    assert found["header_files"].count() == 12_000 and found["header_files"].filter("stored_path = 'a > b'").count() == 12_000
    assert [r["code"] for r in found["faults"].collect()] == ["xml_malformed"]
    assert streams.rows(given, "header_files", DESKTOP).count() == 12_000
    assert sizes.value == 0


def test_ends_of_tags():
    from lathe.facts import xmltree

    assert xmltree._tag_end(b"""x<a b="1>2" c='"' d="'>">t</a>""", 1) == 24
    with pytest.raises(xmltree.XmlFault):
        xmltree._tag_end(b'<a b="1>', 0)


def _plain_walk(edges, roots, depth_cap):
    """The walk edge by edge, as it is defined: (source, reference_id, depth, label) in order."""
    out, loaded, seen = [], set(), set()

    def due(node, requested):
        loaded.add(node)
        own = [e for e in edges if e[0] == node]
        chosen = [c for c in [None, *sorted({e[2] for e in own if e[2] is not None})] if (c is None or requested is None or c in requested) and (node, c) not in seen]
        seen.update((node, c) for c in chosen)
        return [e for c in chosen for e in sorted((e for e in own if e[2] == c), key=lambda e: e[1])]

    def visit(node, take, path):
        for source, ref, _, target, requested, suppressed in take:
            depth = len(path) - 1
            label = "unresolved" if target is None else "suppressed" if suppressed else "cycle" if target in path else "depth_limited" if depth >= depth_cap else "reused" if target in loaded else "followed"
            out.append((source, ref, depth, label))
            if label in ("followed", "reused"):
                visit(target, due(target, requested), [*path, target])

    for root in roots:
        visit(root, due(root, None), [root])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_labels_equal_a_plain_walk(spark, seed):
    """Leaves, cycles, configurations, roots without edges, depth and edge caps."""
    rng = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(24)]
    edges = []
    for node in nodes[:12]:
        for ref in range(1, rng.randint(2, 9)):
            edges.append((node, ref, rng.choice([None, 0, 1]), rng.choice([*nodes, None]), rng.choice([None, [0], [1], []]), rng.random() < 0.2))
    roots = rng.sample(nodes, 8)
    e = spark.createDataFrame([("p", *x) for x in edges], "project string, source string, reference_id long, configuration long, target string, requested array<long>, is_suppressed boolean")
    r = spark.createDataFrame([("p", n, i) for i, n in enumerate(roots)], "project string, node string, root_order long")
    want = _plain_walk(edges, roots, 2)
    got = [(x["source"], x["reference_id"], x["depth"], x["traversal_status"]) for x in graph.label(e, r, depth_cap=2).orderBy("edge_id").collect()]
    assert got == want and len(want) > 5
    capped = graph.label(e, r, depth_cap=2, edge_cap=5).orderBy("edge_id").collect()
    assert [(x["source"], x["reference_id"]) for x in capped] == [w[:2] for w in want[:5]] and {x["rejected"] for x in capped} == {True}


def test_one_task_walks_only_nodes_with_edges(spark, monkeypatch):
    """Edges that lead no further never meet in the walk's task."""
    e = spark.createDataFrame([("p", "top", i, 0, f"leaf{i % 7}", None, False) for i in range(1, 501)], "project string, source string, reference_id long, configuration long, target string, requested array<long>, is_suppressed boolean")
    r = spark.createDataFrame([("p", "top", 0)], "project string, node string, root_order long")
    met, walk = spark.sparkContext.accumulator(0), graph._walk

    def counted(*options):
        run = walk(*options)

        def inner(frame):
            met.add(len(frame))
            return run(frame)

        return inner

    monkeypatch.setattr(graph, "_walk", counted)
    assert graph.label(e, r).groupBy("traversal_status").count().count() == 2
    assert met.value <= 4
