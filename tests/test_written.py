"""Facts that are asked for by name, and what reading them leaves on disk."""

from __future__ import annotations

import glob
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lathe import engine
from lathe.operators.numbering import scratch
from lathe.plans import catalog

from . import fixtures as fx
from .compare import TABLES, differences


@pytest.fixture(scope="module")
def documents(spark):
    odd = fx.chunk_file(fx.block("docProps/ISolidWorksInformation.xml", fx.SYSTEM_XML), fx.block("docProps/Config-2-Properties.xml", fx.CUSTOM_XML), fx.block("swXmlContents/KeyWords", b"<broken"))
    given = {"top": fx.document(), "bad": b"PK\x03\x04", "odd": odd, "none": b"", "text": b"no container"}
    return spark.createDataFrame([(k, bytearray(v)) for k, v in given.items()], "path string, content binary")


def test_named_facts_are_those_of_a_whole_parse(spark, documents):
    whole, some = engine.parse(documents), engine.parse(documents, only=[*engine.FACTS])
    for name in engine.FACTS:
        assert some[name].columns == whole[name].columns, name
        assert Counter(map(str, some[name].collect())) == Counter(map(str, whole[name].collect())), name
    assert {r["parse_status"] for r in some["parse_status"].collect()} >= {"parsed", "malformed", "partial", "unsupported"}
    assert some.entries.count() == whole.entries.count() and some.diagnostics.count() == whole.diagnostics.count()


@pytest.mark.parametrize("name", ["features", "sheets", "documents", "references", "units"])
def test_streams_are_not_written(spark, sf_dir, name):
    """The bytes of all streams, packed and unpacked, are several times the tables that the query reads them for."""
    folder = scratch(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/*"))
    assert differences(catalog.QUERIES[f"written_{name}"](spark, sf_dir), sf_dir, catalog.SQL[f"written_{name}"]) == ""
    left = set(glob.glob(f"{folder}/*")) - before
    assert len(left) == 1
    assert not {"stored", "decoded", "drawing_records"} & {*spark.read.parquet(*left).columns}


def test_equal_references_are_resolved_once(spark, monkeypatch):
    """A part that many assemblies of a folder use is one question; a virtual component is one for each document."""
    from lathe.operators import project, resolve

    files = spark.createDataFrame([("file:/p/a.sldprt", "a.sldprt", None, None, "file:/p/a.sldprt"), (None, "t1.sldasm#v", "file:/p/t1.sldasm", "v", "file:/p/t1.sldasm#v")], "host_path string, label string, container string, embedded_name string, doc_id string")
    rows = [(f"file:/p/t{n}.sldasm", k, path, virtual) for n in range(3) for k, (path, virtual) in enumerate([("a.sldprt", False), ("a.sldprt", None), ("v.sldprt", True), ("", False), (None, None)], 1)]
    rows.append(("file:/q/t.sldasm", 1, "a.sldprt", False))
    references = spark.createDataFrame(rows, "doc_id string, reference_id long, stored_path string, is_virtual boolean")
    asked, cascade = [], resolve.cascade
    monkeypatch.setattr(resolve, "cascade", lambda given, *more: asked.append(given.count()) or cascade(given, *more))
    out = project.resolved(files, references, project.ProjectOptions("/p")).collect()
    got = {(r["doc_id"][6:], r["reference_id"]): (r["resolution_status"], r["resolution_basis"], r["target"]) for r in out}
    found, blank = ("resolved", "document_relative", "file:/p/a.sldprt"), ("no_stored_path", None, None)
    assert len(out) == len(got) == len(rows)
    for n in range(3):
        inner = ("resolved", "embedded_virtual_component", "file:/p/t1.sldasm#v") if n == 1 else ("missing", None, None)
        assert [got[f"p/t{n}.sldasm", k] for k in range(1, 6)] == [found, found, inner, blank, blank]
    assert got["q/t.sldasm", 1] == ("resolved", "project_root_relative", "file:/p/a.sldprt")
    assert asked == [6]


def test_documents_are_written_from_a_stream_of_lines(spark, sf_dir, tmp_path, monkeypatch):
    """No list of an assembly's lines is gathered before its document is written; lines may span batches, lack their assembly or be missing."""
    given, parse = [], engine.parse
    monkeypatch.setattr(engine, "parse", lambda documents, *more, **named: given.append(documents) or parse(documents, *more, **named))
    for t in TABLES:
        if t not in ("supplier", "lineitem"):
            (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    made = {"supplier": "SELECT * FROM t WHERE s_suppkey % 3 <> 1", "lineitem": "SELECT * REPLACE (CASE WHEN l_suppkey % 3 = 2 THEN NULL WHEN l_partkey % 5 > 0 THEN 3 ELSE l_suppkey END AS l_suppkey) FROM t"}
    for t, sql in made.items():
        duckdb.sql(f"COPY (WITH t AS (FROM '{sf_dir}/{t}.parquet') {sql}) TO '{tmp_path}/{t}.parquet'")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for name in ("written_components", "written_units", "written_documents"):
            assert differences(catalog.QUERIES[name](spark, str(tmp_path)), str(tmp_path), catalog.SQL[name]) == "", name
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert len(given) == 3
    assert not [d for d in given if "collect_list" in d._jdf.queryExecution().toString()]


def test_references_of_a_project_are_written_once(spark, sf_dir):
    """Of tables with a row for each edge only the references come to disk, without what no label asks for."""
    folder = scratch(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/*"))
    edges = catalog.QUERIES["scanned_edges"](spark, sf_dir)
    n = edges.count()
    large = [spark.read.parquet(d) for d in set(glob.glob(f"{folder}/*")) - before if spark.read.parquet(d).count() >= n]
    assert len(large) == 1
    assert large[0].select("stored_references.*").columns == ["reference_id", "place", "kind", "configuration_index", "stored_path", "document_kind", "referenced_configuration", "suppressed", "virtual"]


@pytest.mark.parametrize("follow", [False, True])
@pytest.mark.parametrize("order", ["before", "after"])
def test_flat_projects_are_as_a_walk_gives_them(spark, monkeypatch, follow, order):
    """Assemblies of parts only: places come from sums, not from a walk, and labels are the same wherever the parts stand among the roots."""
    from lathe.operators import project

    from .test_project import assembly

    name = {"before": "a%d.sldprt", "after": "z%d.sldprt"}[order]
    uses = lambda k: [(name % (n % 3), "PART", 'swSuppressed="yes"' * (n % 4 == k)) for n in range(5)] + [("none.sldprt", "PART", "")]
    given = {f"file:/p/m{k}.sldasm": assembly(f"/p/m{k}.sldasm", uses(k)) for k in range(3)} | {f"file:/p/{name % n}": assembly(name % n, [], "PART") for n in range(3)}
    documents = spark.createDataFrame([(k, bytearray(fx.chunk_file(v))) for k, v in given.items()], "path string, content binary")
    facts = engine.parse(documents, "desktop", only=[*project.FACTS])
    none = F.lit(None).cast("string")
    held = facts["parse_status"].select(F.col("doc_id").alias("path"), none.alias("container"), none.alias("embedded_name"))

    def rows(roots):
        graph = project.scan(facts, held, project.ProjectOptions("/p", follow_suppressed=follow), roots)
        return graph.status, *(sorted(map(str, t.select(sorted(t.columns)).collect())) for t in (graph.edges, graph.nodes, graph.report, graph.diagnostics))

    for roots in (None, ["file:/p/m2.sldasm", "file:/p/m0.sldasm"]):
        flat = rows(roots)
        starts = spark.createDataFrame([("project", r, i) for i, r in enumerate(roots or sorted(given))], "project string, node string, root_order long")

        def walked(stored, references, answers, first, files, options, limits, starts=starts):
            return project._walked(references.drop("leads", "target_order", "place"), starts, None, files, None, options, limits)[:2]

        with monkeypatch.context() as m:
            m.setattr(project, "_flat", walked)
            assert rows(roots) == flat
        assert len(flat[1]) == 6 * (3 if roots is None else 2)


def test_report_counts_what_tables_hold(spark, documents):
    from lathe.operators import project, resolve

    facts = engine.parse(documents, "desktop", only=[*project.FACTS])
    none = F.lit(None).cast("string")
    held = facts["parse_status"].select(F.concat(F.lit("file:/p/"), "doc_id", F.lit(".sldasm")).alias("path"), none.alias("container"), none.alias("embedded_name"))
    tables = {name: facts[name].withColumn("doc_id", F.concat(F.lit("file:/p/"), "doc_id", F.lit(".sldasm"))) for name in project.FACTS}
    graph = project.scan(tables, held, project.ProjectOptions("/p"))
    want = resolve.status_report(graph.nodes, graph.edges, graph.diagnostics)
    assert sorted(map(tuple, graph.report.collect())) == sorted(map(tuple, want.collect()))
    assert graph.status == "rejected" and graph.edges.count() > 0


def test_trees_without_ranges_read_the_same():
    from lathe.facts import xmltree

    def seen(read, data, *caps):
        try:
            root = read(data, *caps)
        except xmltree.XmlFault as fault:
            return str(fault)
        return [(n.tag, n.attributes, n.first_text(), [c.tag for c in n.children], len(n.named("a"))) for n in root.walk()]

    bodies = [
        b"<a x='1'>t<b/>u<a>v</a></a>", b"junk<a/>\0\0", b"", b"no", b"<a", b"<a></b>", b"<p:a p:x='1'/>", b"<a xmlns:p='u'><p:b p:y='2'/></a>", b"<a xml:space='preserve'> </a>", b"<!DOCTYPE a><a/>", b"<a>x<!-- c -->y<![CDATA[<z>]]></a>",
        b"<?xml version='1.0' encoding='latin-1'?><a>\xc3\xa9</a>", b"<a>\xff</a>", b"<a>&lt;&#65;</a>", b"<a>&no;</a>", b"<a/><a/>", b"<a><b><a/></b></a>", b"<a><b/><b/><b/></a>", b"<a x='1' x='2'/>", b"<a>x<?q r?>y</a>",
    ]
    for data in bodies:
        for caps in ((1 << 20, 1000, 256), (1 << 20, 3, 256), (1 << 20, 1000, 2), (4, 1000, 256)):
            assert seen(xmltree.light, data, *caps) == seen(xmltree.parse, data, *caps), (data, caps)
