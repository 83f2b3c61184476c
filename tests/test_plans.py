"""Plans: no pairwise joins, pruned scans, results independent of partitioning."""

from __future__ import annotations

import re

import pytest

from lathe.plans import catalog

from .compare import multiset


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["resolve_cascade", "prefix_longest_match", "kind_mismatch", "record_delta", "mesh_edge_uses", "grid_nearest", "closure_difference", "topology_fk_errors", "hierarchy_join"])
def test_no_nested_loops(spark, sf_dir, name):
    assert not re.search("NestedLoop|Cartesian", plan(catalog.QUERIES[name](spark, sf_dir)))


def test_scans_are_pruned_and_filtered(spark, sf_dir):
    text = plan(catalog.edges_to(spark, sf_dir))
    assert "PushedFilters: [IsNotNull(l_partkey), EqualTo(l_partkey,7)]" in text
    assert set(re.search(r"ReadSchema: struct<([^>]*)>", text)[1].replace(":", ",").split(",")[::2]) == {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"}
    assert "text" not in re.search(r"ReadSchema: struct<([^>]*)>", plan(catalog.semantic_coverage(spark, sf_dir)))[1]


@pytest.mark.parametrize("name", ["resolve_cascade", "bom_occurrences", "range_complement", "outline_edges", "ranked_name_merge", "view_delta"])
def test_results_do_not_depend_on_partitions(spark, sf_dir, name):
    got = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(multiset(catalog.QUERIES[name](spark, sf_dir).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


@pytest.mark.parametrize("name", ["candidate_truncation", "resolve_cascade", "resolve_status_counts"])
def test_cascade_is_never_broadcast(spark, sf_dir, name):
    """A small compressed file has many times its size in keys, more than a driver can send."""
    df = catalog.QUERIES[name](spark, sf_dir)
    df.collect()
    assert "BroadcastExchange" not in plan(df)


def test_scanned_project_is_whole(spark, sf_dir, monkeypatch):
    """The question is about all rows: a profile's caps on edges and files don't cut it."""
    from dataclasses import replace

    from lathe.sources import limits

    from .compare import differences

    monkeypatch.setattr(limits, "DESKTOP", replace(limits.DESKTOP, edges=50, files=20))
    assert differences(catalog.QUERIES["scanned_report"](spark, sf_dir), sf_dir, catalog.SQL["scanned_report"]) == ""
