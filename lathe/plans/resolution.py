"""Reference resolution, traversal and capped expansion on paths and trees made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.operators import bom, graph, resolve

from .registry import query, table

#: Each part is a file in one of ten folders (two thirds of them exist, and no project file of every third name) and a reference of one of eight forms; ten neighbours share a base name.
FOLDERS = ("/proj/a", "/proj/b", "/proj/a/sub", "/lib", "/lib/deep", "/s1", "/s2", "/s1/x", "/s2/x", "/other")
FORMS = ("P{}.sldprt", "sub\\P{}.SLDPRT", "b\\..\\a/./P{}.sldprt", "/s1/./P{}.sldprt", "W:\\LIB\\P{}.sldprt", "x/P{}.sldprt", "\\\\gone\\P{}.sldprt", "  ")
DOCUMENTS = ("/proj/a/top.sldasm", "/proj/c/sheet.slddrw", "/else/loose.sldasm")

_FILES = f"""files AS (SELECT CASE WHEN p_partkey % 13 = 5 THEN 'a/top.sldasm#' || p_partkey ELSE {list(FOLDERS)}[p_partkey % 10 + 1] || '/P' || p_partkey // 10 || '.SLDPRT' END AS label,
  CASE WHEN p_partkey % 13 <> 5 THEN lower({list(FOLDERS)}[p_partkey % 10 + 1] || '/p' || p_partkey // 10 || '.sldprt') END AS host, 'p' || p_partkey // 10 || '.sldprt' AS base,
  CASE WHEN p_partkey % 13 = 5 THEN 'p' || p_partkey // 10 END AS inner_name FROM part WHERE p_partkey * 7 % 3 <> 0 AND NOT (p_partkey % 10 < 3 AND p_partkey // 10 % 3 = 0))"""
_REFERENCES = f"""refs AS (SELECT p_partkey AS ref_id, p_size % 8 AS form, {list(DOCUMENTS)}[p_partkey % 3 + 1] AS doc, ['/proj/a', '/proj/c', '/else'][p_partkey % 3 + 1] AS home, 'p' || p_partkey // 10 AS stem, p_partkey % 2 = 0 AS virtual,
  ['', 'sub/', 'a/', 's1/', 'lib/', 'x/', 'gone/', ''][p_size % 8 + 1] || 'p' || p_partkey // 10 || '.sldprt' AS tail, 'p' || p_partkey // 10 || '.sldprt' AS base FROM part)"""
_RESOLVED = f"""
WITH {_FILES}, {_REFERENCES},
keys AS (
  SELECT ref_id, 1 AS step, home || '/' || tail AS key FROM refs WHERE form IN (0, 1, 2, 5) UNION ALL SELECT ref_id, 2, '/proj/' || tail FROM refs WHERE form IN (0, 1, 2, 5)
  UNION ALL SELECT ref_id, 3, '/s1/' || base FROM refs WHERE form = 3 UNION ALL SELECT ref_id, 4, t || base FROM refs, (SELECT unnest(['/lib/', '/lib/deep/']) AS t) WHERE form = 4
  UNION ALL SELECT ref_id, 5, s || tail FROM refs, (SELECT unnest(['/s1/', '/s2/']) AS s) WHERE form < 7 UNION ALL SELECT ref_id, 6, home || '/' || base FROM refs WHERE form < 7),
hits AS (
  SELECT ref_id, 0 AS step, label FROM refs JOIN files ON inner_name = stem WHERE virtual AND form < 7 AND doc = '/proj/a/top.sldasm'
  UNION ALL SELECT ref_id, step, label FROM keys JOIN files ON host = key
  UNION ALL SELECT ref_id, 7, label FROM refs JOIN files ON refs.base = files.base AND host LIKE '/proj/%' WHERE form < 7 UNION ALL SELECT ref_id, 8, label FROM refs JOIN files ON refs.base = files.base AND (host LIKE '/s1/%' OR host LIKE '/s2/%') WHERE form < 7),
best AS (SELECT ref_id, min(step) AS step FROM hits GROUP BY ref_id),
found AS (SELECT ref_id, step, CAST(count(DISTINCT label) AS BIGINT) AS candidate_count, list_sort(list(DISTINCT label)) AS labels FROM hits JOIN best USING (ref_id, step) GROUP BY ref_id, step),
resolved AS (SELECT ref_id, CASE WHEN form = 7 THEN 'no_stored_path' WHEN step IS NULL THEN 'missing' WHEN candidate_count = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
  CAST(step AS INTEGER) AS step, coalesce(candidate_count, 0) AS candidate_count, coalesce(labels, []) AS labels FROM refs LEFT JOIN found USING (ref_id))
"""


def _pick(choices, key) -> F.Column:
    return F.element_at(F.array(*map(F.lit, choices)), (key + 1).cast("int"))


def _resolution(spark, sf_dir, most: int = 1024) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("group", F.floor(F.col("p_partkey") / 10).cast("string"))
    key, inner = F.col("p_partkey"), F.col("p_partkey") % 13 == 5
    host = F.concat(_pick(FOLDERS, key % 10), F.lit("/P"), "group", F.lit(".SLDPRT"))
    files = part.filter((key * 7 % 3 != 0) & ~((key % 10 < 3) & (F.floor(key / 10) % 3 == 0))).select(
        F.when(~inner, F.concat(F.lit("file:"), host)).alias("host_path"), F.when(inner, F.concat(F.lit("a/top.sldasm#"), key.cast("string"))).otherwise(host).alias("label"),
        F.when(inner, DOCUMENTS[0]).alias("container"), F.when(inner, F.concat(F.lit("P"), "group")).alias("embedded_name"),
    )
    form = F.col("p_size") % 8
    stored = F.replace(_pick(FORMS, form), F.lit("{}"), F.col("group"))
    virtual = key % 2 == 0
    # Virtual components carry their owner behind a caret.
    stored = F.when(virtual & (form == 6), F.replace(stored, F.lit(".sldprt"), F.lit("^top.sldprt"))).otherwise(stored)
    references = part.select(key.alias("ref_id"), stored.alias("stored_path"), _pick(DOCUMENTS, key % 3).alias("document"), virtual.alias("is_virtual"))
    mappings = [("W:\\lib", "/lib"), ("W:/Lib/", "/lib/deep/"), ("W:\\", "/other")]
    keys, file_keys = resolve.path_steps(F.col("stored_path"), F.col("document"), ["/proj"], ["/s1", "/s2"], mappings, F.col("is_virtual"))
    return resolve.cascade(references, "ref_id", keys, resolve.keyed_files(files, file_keys), F.trim("stored_path") == "", most)


_CARET = _RESOLVED.replace("'p' || p_partkey // 10 || '.sldprt' AS base FROM part)", "CASE WHEN p_partkey % 2 = 0 AND p_size % 8 = 6 THEN 'p' || p_partkey // 10 || '^top.sldprt' ELSE 'p' || p_partkey // 10 || '.sldprt' END AS base FROM part)")
_BASIS = f"CASE WHEN step IS NOT NULL THEN {list(resolve.BASES)}[step + 1] END AS basis"


@query(_CARET + f"SELECT ref_id, status, {_BASIS}, candidate_count, CASE WHEN candidate_count = 1 THEN labels[1] END AS resolved FROM resolved")
def resolve_cascade(spark, sf_dir):
    return _resolution(spark, sf_dir).select("ref_id", "status", resolve.basis(F.col("step")).alias("basis"), "candidate_count", "resolved")


@query(_CARET + f"SELECT status, {_BASIS}, CAST(count(*) AS BIGINT) AS n FROM resolved GROUP BY status, step")
def resolve_status_counts(spark, sf_dir):
    return _resolution(spark, sf_dir).groupBy("status", "step").agg(F.count("*").alias("n")).select("status", resolve.basis(F.col("step")).alias("basis"), "n")


@query(_CARET + "SELECT ref_id, candidate_count, array_to_string(labels[1:2], ';') AS candidates FROM resolved")
def candidate_truncation(spark, sf_dir):
    return _resolution(spark, sf_dir, most=2).select("ref_id", "candidate_count", F.array_join("candidates", ";").alias("candidates"))


# ---- a deep, lopsided tree: each part hangs below an earlier one ------------------------

_PARENT = "CASE WHEN p_partkey % 5 = 0 THEN p_partkey // 7 WHEN p_partkey % 3 = 0 THEN p_partkey // 2 ELSE greatest(p_partkey * 7 // 8, 1) END"
_DEEP = f"""WITH RECURSIVE links AS (SELECT p_partkey AS node, {_PARENT} AS up FROM part WHERE p_partkey > 1),
edges AS (SELECT up, node, CAST(row_number() OVER (PARTITION BY up ORDER BY node) AS INTEGER) AS ordinal FROM links WHERE up >= 1 AND up < node),
tree AS (SELECT CAST(1 AS BIGINT) AS node, CAST([] AS INTEGER[]) AS above, CAST([] AS INTEGER[]) AS path, 0 AS depth UNION ALL SELECT e.node, t.path, list_append(t.path, e.ordinal), t.depth + 1 FROM tree t JOIN edges e ON e.up = t.node),
ranked AS (SELECT row_number() OVER (ORDER BY above, path) - 1 AS n, * FROM tree)
"""


def _deep(spark, sf_dir, most: int | None) -> DataFrame:
    key = F.col("p_partkey")
    up = F.when(key % 5 == 0, F.floor(key / 7)).when(key % 3 == 0, F.floor(key / 2)).otherwise(F.greatest(F.floor(key * 7 / 8), F.lit(1)))
    part = table(spark, sf_dir, "part")
    links = part.select(up.alias("source_node_id"), key.alias("target_node_id")).filter("target_node_id > 1 AND source_node_id >= 1 AND source_node_id < target_node_id")
    placed = bom.first_edge_order(links, ["source_node_id"], ["target_node_id"])
    no, none = F.lit(False), F.lit(None).cast("string")
    edges = placed.select(
        F.col("source_node_id").cast("string").alias("source_node_id"), F.col("target_node_id").cast("string").alias("target_node_id"), "ordinal", F.col("target_node_id").cast("string").alias("stored_path"), no.alias("is_suppressed"), no.alias("exclude_from_bom"),
        none.alias("referenced_configuration"), no.alias("is_virtual"), F.lit(0).cast("long").alias("source_configuration_index"), F.lit("followed").alias("traversal_status"), F.col("target_node_id").cast("string").alias("id"),
    )
    one = F.array(F.struct(F.lit(0).cast("long").alias("index"), F.lit("Default").alias("name")))
    nodes = part.select(key.cast("string").alias("id"), F.lit("assembly").alias("document_kind"), key.cast("string").alias("path"), one.alias("configurations"))
    return bom.expand(edges, nodes, "1", 0, bom.BomOptions(max_occurrences=most))


@query(_DEEP + "SELECT 'occ:' || lpad(CAST(n AS VARCHAR), 8, '0') AS id, CAST(node AS VARCHAR) AS node_id, CAST(depth AS INTEGER) AS depth, CASE WHEN path = (SELECT above FROM ranked WHERE n = 60) THEN 'limit_reached' ELSE 'expanded' END AS children_state FROM ranked WHERE n < 60")
def bom_limit_deep(spark, sf_dir):
    return _deep(spark, sf_dir, 60).select("id", "node_id", "depth", "children_state")


@query(_DEEP + "SELECT 'occ:' || lpad(CAST(n AS VARCHAR), 8, '0') AS id, CAST(node AS VARCHAR) AS node_id, CAST(depth AS INTEGER) AS depth FROM ranked")
def bom_deep(spark, sf_dir):
    return _deep(spark, sf_dir, None).select("id", "node_id", "depth")


# ---- traversal labels -------------------------------------------------------------------

#: Customers are projects; orders hang below each other by rank, and each also points back to the customer's first (a cycle), ahead to the next but one (reused) and to nothing.
_LABELLED = """WITH o AS (SELECT o_custkey AS c, o_orderkey AS node, row_number() OVER w AS k, lead(o_orderkey) OVER w AS ahead, first_value(o_orderkey) OVER w AS top FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
e AS (SELECT c, k, 1 AS r, node AS source, ahead AS target, 'followed' AS label FROM o WHERE ahead IS NOT NULL UNION ALL SELECT c, k, 2, node, top, 'cycle' FROM o UNION ALL SELECT c, k, 3, node, NULL, 'unresolved' FROM o
  UNION ALL SELECT c, k, 4, node, ahead, 'suppressed' FROM o WHERE ahead IS NOT NULL UNION ALL SELECT c, k, 5, node, ahead, 'reused' FROM o WHERE ahead IS NOT NULL)
SELECT CAST(c AS VARCHAR) AS project, 'edge:' || lpad(CAST(row_number() OVER (PARTITION BY c ORDER BY CASE WHEN r = 1 THEN k ELSE 1000000 - k END, r) - 1 AS VARCHAR), 8, '0') AS edge_id, CAST(source AS VARCHAR) AS source, CAST(target AS VARCHAR) AS target, CAST(k - 1 AS INTEGER) AS depth, label AS traversal_status FROM e"""


@query(_LABELLED)
def traversal_labels(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("project"), F.col("o_orderkey").cast("string").alias("source"), F.lead("o_orderkey").over(w).cast("string").alias("ahead"), F.min("o_orderkey").over(w).cast("string").alias("top"), F.row_number().over(w).alias("k")
    )
    kinds = F.explode(F.array(*(F.struct(F.lit(r).cast("long").alias("reference_id"), target.alias("target"), F.lit(hidden).alias("is_suppressed"), F.lit(r in (1, 4, 5)).alias("needed")) for r, target, hidden in (
        (1, F.col("ahead"), False), (2, F.col("top"), False), (3, F.lit(None).cast("string"), False), (4, F.col("ahead"), True), (5, F.col("ahead"), False),
    ))))
    edges = o.select("project", "source", kinds.alias("e")).select("project", "source", "e.*").filter(~F.col("needed") | F.col("target").isNotNull())
    edges = edges.withColumns({"configuration": F.lit(None).cast("long"), "requested": F.lit(None).cast("array<long>")})
    roots = o.filter("k = 1").select("project", F.col("source").alias("node"), F.lit(0).alias("root_order"))
    return graph.label(edges, roots).select("project", "edge_id", "source", "target", "depth", "traversal_status")
