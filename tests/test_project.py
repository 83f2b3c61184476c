"""From container bytes to a graph and a bill of materials."""

from __future__ import annotations

import json

import pytest

from lathe import __main__ as command
from lathe import engine
from lathe.sources.limits import PROFILES

from . import fixtures as fx


def assembly(own: str, parts: list[tuple], kind: str = "ASSEMBLY") -> bytes:
    """A document with references (stored path, kind, attributes of the reference)."""
    stored = {p: n for n, p in enumerate(dict.fromkeys(p for p, _, _ in parts), 1)}
    kinds = {p: k for p, k, _ in parts}
    files = f'<swFile id="f0" swPath="{own}" swDocType="{kind}"/>' + "".join(f'<swFile id="f{n}" swPath="{p}" swDocType="{kinds[p]}"/>' for p, n in stored.items())
    models = "".join(f'<swModel id="m{n}" swFileRef="f{n}"/>' for n in stored.values())
    references = "".join(f'<swReference swModelRef="m{stored[p]}" swName="c-{n}" {attributes}/>' for n, (p, _, attributes) in enumerate(parts))
    xml = f"<swDoc><swHeader>{files}</swHeader><swConfigurationList><swConfiguration swID=\"0\" swName=\"Default\" swModelRef=\"m0\"/></swConfigurationList><swModelList><swModel id=\"m0\" swFileRef=\"f0\" swConfigurationId=\"0\">{references}</swModel>{models}</swModelList></swDoc>"
    return fx.block("swXmlContents/COMPINSTANCETREE", xml.encode())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("projects")
    put = lambda path, *frames: ((top / path).parent.mkdir(parents=True, exist_ok=True), (top / path).write_bytes(fx.chunk_file(*frames)))
    part = lambda name: assembly(name, [], "PART")
    put(
        "p/top.sldasm",
        assembly("C:\\old\\top.sldasm", [
            ("C:\\old\\sub.sldasm", "ASSEMBLY", ""), ("C:\\old\\sub.sldasm", "ASSEMBLY", ""), ("C:\\old\\Bolt.SLDPRT", "PART", ""), ("W:\\lib\\nut.sldprt", "PART", ""), ("C:\\x\\none.sldprt", "PART", ""),
            ("C:\\x\\two.sldprt", "PART", ""), ("C:\\x\\Inner^top.sldprt", "PART", 'swIsVirtualComponent="yes"'), ("C:\\old\\spare.sldprt", "PART", 'swSuppressed="yes"'),
        ]),
        fx.block("VirtualComp/Inner^top.sldprt", fx.chunk_file(part("C:\\x\\Inner^top.sldprt"))),
    )
    put("p/sub.sldasm", assembly("C:\\old\\sub.sldasm", [("bolt.sldprt", "PART", ""), ("top.sldasm", "ASSEMBLY", "")]))
    for path in ("p/bolt.sldprt", "p/spare.sldprt", "lib/nut.sldprt", "s1/two.sldprt", "s2/two.sldprt", "p/else/lone.sldprt"):
        put(path, part(path.rpartition("/")[2]))
    return top


def test_scan_to_bom(spark, folder):
    given = {"search_directories": [str(folder / "s1"), str(folder / "s2")], "windows_prefix_mappings": {"W:\\lib": str(folder / "lib")}}
    graph = engine.scan_project(spark, str(folder / "p/top.sldasm"), **given)
    edges = [(r["source_node_id"], r["target_node_id"], r["resolution_basis"], r["resolution_status"], r["traversal_status"], r["candidate_count"]) for r in graph.edges.orderBy("id").collect()]
    assert edges == [
        ("top.sldasm", "sub.sldasm", "document_directory_basename", "resolved", "followed", 1), ("sub.sldasm", "bolt.sldprt", "document_relative", "resolved", "followed", 1), ("sub.sldasm", "top.sldasm", "document_relative", "resolved", "cycle", 1),
        ("top.sldasm", "sub.sldasm", "document_directory_basename", "resolved", "reused", 1), ("top.sldasm", "bolt.sldprt", "document_directory_basename", "resolved", "reused", 1), ("top.sldasm", "@mapping/0/nut.sldprt", "windows_prefix_mapping", "resolved", "followed", 1),
        ("top.sldasm", None, None, "missing", "unresolved", 0), ("top.sldasm", None, "search_directory_basename", "ambiguous", "unresolved", 2),
        ("top.sldasm", "top.sldasm#VirtualComp/Inner^top.sldprt", "embedded_virtual_component", "resolved", "followed", 1), ("top.sldasm", "spare.sldprt", "document_directory_basename", "resolved", "suppressed", 1),
    ]
    assert graph.status == "partial"
    assert sorted(r["code"] for r in graph.diagnostics.collect()) == ["project.reference_ambiguous", "project.reference_cycle", "project.reference_missing"]
    depth = {r["id"]: (r["minimum_depth"], r["is_root"], r["document_kind"]) for r in graph.nodes.collect()}
    assert depth["top.sldasm"] == (0, True, "assembly") and depth["bolt.sldprt"] == (1, False, "part") and "lone.sldprt" not in depth and "else/lone.sldprt" not in depth
    assert [r["id"] for r in graph.referencing("bolt.sldprt").orderBy("first_edge").collect()] == ["sub.sldasm", "top.sldasm"]
    made = engine.bom(graph.edges, graph.nodes, "top.sldasm")
    items = {r["node_id"] or r["unresolved_name"]: r["quantity"] for r in made["items"].collect()}
    assert items == {"sub.sldasm": 2, "bolt.sldprt": 3, "top.sldasm": 2, "@mapping/0/nut.sldprt": 1, "none.sldprt": 1, "two.sldprt": 1, "top.sldasm#VirtualComp/Inner^top.sldprt": 1, "spare.sldprt": 0}
    with pytest.raises(FileNotFoundError):
        engine.scan_project(spark, str(folder / "p/nothing.sldasm"))


def test_index_and_limits(spark, folder, monkeypatch):
    graph = engine.index_project(spark, str(folder / "p"))
    assert {r["id"] for r in graph.nodes.filter("is_root").collect()} == {"top.sldasm", "sub.sldasm", "bolt.sldprt", "spare.sldprt", "else/lone.sldprt"}
    assert graph.edges.count() == 10 and {(r["category"], r["value"]): r["n"] for r in graph.report.collect()}[("resolution", "missing")] == 3
    import dataclasses

    monkeypatch.setitem(PROFILES, "tight", dataclasses.replace(PROFILES["service"], edges=4))
    tight = engine.index_project(spark, str(folder / "p"), "tight")
    assert tight.status == "rejected" and tight.edges.count() == 4 and tight.diagnostics.filter("code = 'limit.project_edges'").count() == 1


def test_command_line(spark, folder, capsys):
    assert command.main(["bom", str(folder / "p/top.sldasm")]) == 1
    rows = [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert {r.get("node_id"): r["quantity"] for r in rows}["bolt.sldprt"] == 3
    assert command.main(["scan", str(folder / "p/sub.sldasm"), "--summary"]) == 1
    assert command.main(["scan", str(folder / "p/missing.sldasm")]) == 2
