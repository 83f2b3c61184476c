"""The engine's operators on the driver's tables, with the same question in SQL.

The tables are not engineering documents; each query maps one operator's
semantics onto columns of the same shape, over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.functions import paths, values
from lathe.operators import bom, conflicts, delta, graph, intervals, mesh, nearest, resolve, topology
from lathe.sources import probe

from .registry import QUERIES, SQL, query, table  # noqa: F401

# ---- container probing --------------------------------------------------------


# Every text gets one of nine beginnings, by its id: none, the three kinds of container (one behind other bytes), beginnings cut short, and one that comes too late.
_STARTS = ("", "D0CF11E0A1B11AE1", "504B0304", "504B0506", "140006000800", "6162637820140006000800", "D0CF11E0", "504B", "20" * 70 + "140006000800")
_KINDS = "['unknown', 'ole2_cfb', 'zip_opc', 'zip_opc', 'modern_chunk', 'modern_chunk', 'unknown', 'unknown', 'unknown']"
_PROBED = f"""SELECT '{{0}}' AS source, id, CASE WHEN id % 9 IN (1, 2, 3, 4, 5) THEN 'recognized' WHEN n = 0 OR whole IN ('D0CF11E0', '504B') THEN 'malformed' ELSE 'unrecognized' END AS status, n AS byte_len, {_KINDS}[id % 9 + 1] AS envelope
FROM (SELECT id, octet_length(encode(t)) + len(start) // 2 AS n, CASE WHEN octet_length(encode(t)) = 0 THEN start ELSE '' END AS whole FROM (SELECT {{1}} AS id, {{2}} AS t, {list(_STARTS)}[{{1}} % 9 + 1] AS start FROM {{0}}))"""


@query(_PROBED.format("documents", "doc_id", "text") + " UNION ALL " + _PROBED.format("pages", "page_id", "html"))
def probe_envelope(spark, sf_dir):
    start = F.element_at(F.array(*map(F.lit, _STARTS)), (F.col("id") % 9 + 1).cast("int"))

    def begun(name, key, text):
        rows = table(spark, sf_dir, name).select(F.lit(name).alias("source"), F.col(key).alias("id"), F.col(text).cast("binary").alias("raw"))
        return rows.select("source", "id", F.concat(F.unhex(start), "raw").alias("content"))

    return probe.probe(begun("documents", "doc_id", "text").unionByName(begun("pages", "page_id", "html"))).select("source", "id", "status", "byte_len", "envelope")


# The checksum's table of 256 entries, and one step for each byte.
_CRC = """WITH RECURSIVE shifted AS (SELECT range AS b, range AS v, 0 AS k FROM range(256) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM shifted WHERE k < 8),
t AS (SELECT list(v ORDER BY b) AS t FROM shifted WHERE k = 8), h AS (SELECT page_id, hex(encode(url)) AS h FROM pages)
SELECT page_id, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h) // 2 + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c, b) & 255 + 1])), 4294967295) AS crc32 FROM h, t"""


@query(_CRC.replace("t[xor(c, b) & 255 + 1]", "t[(xor(c, b) & 255) + 1]"))
def inventory_crc(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.crc32(F.col("url").cast("binary")).alias("crc32"))


@query("""
SELECT family, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE
  WHEN leaf LIKE '%-Properties' THEN 'property_set' WHEN leaf IN ('Preview', 'PreviewPNG') OR leaf LIKE '%-Preview%' THEN 'preview'
  WHEN leaf IN ('CMgr', 'CMgrHdr2', 'CnfgObjs') OR leaf LIKE 'Config-%' THEN 'configuration' WHEN leaf IN ('Header', 'Header2', 'ModelStamps') THEN 'document_header'
  WHEN path LIKE '%/\\_MO\\_VERSION\\_%' ESCAPE '\\' OR path LIKE '%/\\_DL\\_VERSION\\_%' ESCAPE '\\' THEN 'versioned_model'
  WHEN path LIKE '/swXmlContents/%' THEN 'xml_cache' WHEN path LIKE '/ThirdPty/%' OR path LIKE '/ThirdPtyStore/%' THEN 'third_party'
  WHEN leaf LIKE 'DisplayList%' THEN 'display_cache' ELSE 'other' END AS family
FROM (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS leaf FROM (SELECT url AS path FROM pages
  UNION ALL SELECT CASE page_id % 9 WHEN 0 THEN '/Config-1-Properties' WHEN 1 THEN '/PreviewPNG' WHEN 2 THEN '/x/Config-2' WHEN 3 THEN '/Header2' WHEN 4 THEN '/a/_MO_VERSION_9/b'
    WHEN 5 THEN '/swXmlContents/KeyWords' WHEN 6 THEN '/ThirdPty/x' WHEN 7 THEN '/DisplayLists' ELSE url END FROM pages))) GROUP BY family
""")
def stream_family(spark, sf_dir):
    fixed = ["/Config-1-Properties", "/PreviewPNG", "/x/Config-2", "/Header2", "/a/_MO_VERSION_9/b", "/swXmlContents/KeyWords", "/ThirdPty/x", "/DisplayLists"]
    pages = table(spark, sf_dir, "pages")
    k = F.col("page_id") % 9
    named = F.when(k < 8, F.element_at(F.array(*map(F.lit, fixed)), F.least(k, F.lit(7)).cast("int") + 1)).otherwise(F.col("url"))
    both = pages.select(F.col("url").alias("path")).unionByName(pages.select(named.alias("path")))
    return both.select(probe.stream_family(F.col("path")).alias("family")).groupBy("family").agg(F.count("*").alias("n"))


# ---- paths ---------------------------------------------------------------------

_URL = "SELECT page_id, string_split(replace(url, chr(92), '/'), '/') AS p FROM pages"


@query(f"SELECT page_id, array_to_string(list_filter(p, lambda x: x <> '' AND x <> '.'), '/') AS path FROM ({_URL})")
def path_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.normalize(F.col("url")).alias("path"))


@query(f"SELECT page_id, list_filter(p, lambda x: x <> '')[-1] AS name, lower(list_filter(p, lambda x: x <> '')[-1]) AS folded FROM ({_URL})")
def path_basename(spark, sf_dir):
    name = paths.basename(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"), paths.fold(name).alias("folded"))


@query(f"""SELECT page_id, array_to_string(CASE page_id % 3 WHEN 0 THEN list_append(q[1:-2], CAST(page_id AS VARCHAR)) WHEN 1 THEN q ELSE list_append([], CAST(page_id AS VARCHAR)) END, '/') AS path
FROM (SELECT page_id, list_filter(p, lambda x: x <> '' AND x <> '.') AS q FROM ({_URL}))""")
def path_lexical(spark, sf_dir):
    """Paths that go back one folder, none in sum, or beyond the top."""
    page, k = F.col("page_id").cast("string"), F.col("page_id") % 3
    odd = F.when(k == 0, F.concat("url", F.lit("/..//./"), page)).when(k == 1, F.concat("url", F.lit("/x/y/../.."))).otherwise(F.concat("url", F.lit("/.." * 40 + "/"), page))
    return table(spark, sf_dir, "pages").select("page_id", paths.lexical(odd).alias("path"))


_PART_PATH = "CASE p_partkey % 4 WHEN 0 THEN 'C:' || chr(92) WHEN 1 THEN chr(92) || chr(92) || 'srv' || chr(92) WHEN 2 THEN '//srv/' ELSE '' END || p_brand || '/' || p_name"


def _part_path() -> F.Column:
    k = F.col("p_partkey") % 4
    start = F.when(k == 0, "C:\\").when(k == 1, "\\\\srv\\").when(k == 2, "//srv/").otherwise("")
    return F.concat(start, "p_brand", F.lit("/"), "p_name")


@query(f"SELECT p_partkey, regexp_matches(path, '^([A-Za-z]:[\\\\/]|\\\\\\\\|//)') AS windows_absolute FROM (SELECT p_partkey, {_PART_PATH} AS path FROM part)")
def windows_absolute(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", paths.is_windows_absolute(_part_path()).alias("windows_absolute"))


@query("""
WITH paths AS (SELECT p_partkey, lower(p_brand || '/' || p_name || '/' || p_size) AS path FROM part),
prefixes AS (SELECT DISTINCT lower(p_brand) AS prefix FROM part UNION SELECT DISTINCT lower(p_brand || '/' || p_name) FROM part WHERE p_size > 40)
SELECT p_partkey, prefix FROM (
  SELECT p_partkey, prefix, rank() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC) AS place FROM paths JOIN prefixes ON path = prefix OR starts_with(path, prefix || '/')) WHERE place = 1
""")
def prefix_longest_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    refs = part.select("p_partkey", F.concat_ws("/", "p_brand", "p_name", "p_size").alias("path"))
    brands = part.select(F.lower("p_brand").alias("prefix"))
    names = part.filter("p_size > 40").select(F.lower(F.concat_ws("/", "p_brand", "p_name")).alias("prefix"))
    return resolve.longest_prefix(refs, "path", brands.unionByName(names).distinct()).select("p_partkey", "prefix")


# ---- reference resolution --------------------------------------------------------

@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, expected, p_type AS actual FROM (SELECT *, CASE l_linestatus WHEN 'O' THEN 'ECONOMY' WHEN 'F' THEN 'SMALL' END AS expected FROM lineitem)
JOIN part ON p_partkey = l_partkey WHERE expected <> p_type
""")
def kind_mismatch(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    expected = F.when(F.col("l_linestatus") == "O", "ECONOMY").when(F.col("l_linestatus") == "F", "SMALL")
    edges = line.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("target_node_id"), "l_suppkey", expected.alias("expected_document_kind"))
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("document_kind"))
    out = resolve.mismatched_kinds(edges, nodes)
    return out.select("l_orderkey", "l_linenumber", F.col("target_node_id").alias("l_partkey"), "l_suppkey", F.col("expected_document_kind").alias("expected"), "actual")


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem WHERE l_partkey = 7")
def edges_to(spark, sf_dir):
    return resolve.edges_to(table(spark, sf_dir, "lineitem"), F.col("l_partkey"), 7).select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


@query("""
SELECT s_suppkey AS id, s_name AS path, min(l_orderkey * 10 + l_linenumber) AS first_edge FROM supplier JOIN lineitem ON l_suppkey = s_suppkey
WHERE l_partkey = 7 AND l_returnflag = 'A' GROUP BY ALL
""")
def referencing_nodes(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("source_node_id"), F.col("l_partkey").alias("target_node_id"), F.col("l_returnflag").alias("kind"))
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("path"))
    return resolve.referencing(edges, nodes, F.col("target_node_id") == 7, "A").select("id", "path", "first_edge")


@query("SELECT o_custkey AS node, CAST(min(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END) AS INTEGER) AS minimum_depth, bool_or(o_orderstatus = 'O') AS is_root FROM orders GROUP BY o_custkey")
def node_min_depth(spark, sf_dir):
    status = F.col("o_orderstatus")
    visits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node"), F.when(status == "O", 0).when(status == "P", 1).otherwise(2).alias("depth"), (status == "O").alias("is_root"))
    return graph.least_depth(visits)


@query("""
WITH e AS (SELECT DISTINCT lower(p_name || '-' || p_size) AS folded, p_name || '-' || p_size AS name FROM part), a AS (SELECT DISTINCT lower(n) AS folded, n AS name FROM (
  SELECT CASE WHEN l_returnflag = 'A' THEN upper(p_name) ELSE p_name END || '-' || (p_size + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS n FROM lineitem JOIN part ON p_partkey = l_partkey))
SELECT DISTINCT folded, 'missing' AS fault FROM e WHERE folded NOT IN (SELECT folded FROM a) UNION ALL SELECT DISTINCT folded, 'unexpected' FROM a WHERE folded NOT IN (SELECT folded FROM e)
UNION ALL SELECT folded, 'collision_expected' FROM e GROUP BY folded HAVING count(DISTINCT name) > 1 UNION ALL SELECT folded, 'collision_actual' FROM a GROUP BY folded HAVING count(DISTINCT name) > 1
""")
def closure_difference(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    expected = part.select(F.concat_ws("-", "p_name", "p_size").alias("name"))
    used = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    name = F.when(F.col("l_returnflag") == "A", F.upper("p_name")).otherwise(F.col("p_name"))
    size = F.col("p_size") + F.when(F.col("l_linestatus") == "O", 1).otherwise(0)
    return resolve.closure(expected, used.select(F.concat_ws("-", name, size).alias("name")), "name")


@query("""
SELECT category, value, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'document_kind' AS category, p_type AS value FROM part UNION ALL SELECT 'parse_status', CASE WHEN p_size < 10 THEN 'partial' WHEN p_size < 40 THEN 'parsed' END FROM part
  UNION ALL SELECT 'resolution', event_type FROM events UNION ALL SELECT 'traversal', CASE WHEN value < 50 THEN 'followed' ELSE 'reused' END FROM events UNION ALL SELECT 'diagnostic', props FROM events)
WHERE value IS NOT NULL GROUP BY ALL
""")
def compat_report(spark, sf_dir):
    size, events = F.col("p_size"), table(spark, sf_dir, "events")
    nodes = table(spark, sf_dir, "part").select(F.col("p_type").alias("document_kind"), F.when(size < 10, "partial").when(size < 40, "parsed").alias("parse_status"))
    edges = events.select(F.col("event_type").alias("resolution_status"), F.when(F.col("value") < 50, "followed").otherwise("reused").alias("traversal_status"))
    return resolve.status_report(nodes, edges, events.select(F.col("props").alias("code")))


# ---- graph and bill of materials ------------------------------------------------


@query("""
WITH edges AS (SELECT 'r' || n_regionkey AS s, 'n' || n_nationkey AS t FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM (
  SELECT DISTINCT 'r' || r_regionkey AS node, 0 AS depth FROM region
  UNION SELECT t, 1 FROM edges WHERE s LIKE 'r%' UNION SELECT t, 2 FROM edges WHERE s LIKE 'n%' UNION SELECT t, 3 FROM edges WHERE s LIKE 'c%' UNION SELECT t, 4 FROM edges WHERE s LIKE 'o%') GROUP BY node
""")
def reach_depth(spark, sf_dir):
    name = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    edge = lambda t, s, sc, d, dc: table(spark, sf_dir, t).select(name(s, sc).alias("source"), name(d, dc).alias("target"))
    edges = edge("nation", "r", "n_regionkey", "n", "n_nationkey").unionByName(edge("customer", "n", "c_nationkey", "c", "c_custkey"))
    edges = edges.unionByName(edge("orders", "c", "o_custkey", "o", "o_orderkey")).unionByName(edge("lineitem", "o", "l_orderkey", "p", "l_partkey"))
    return graph.reach(table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("node")), edges)


_BOM = """
WITH sup AS (SELECT s_suppkey, s_nationkey, s_acctbal < 0 AS sup, s_acctbal > 9000 AS exc FROM supplier),
raw AS (
  SELECT 'world' AS src, CAST(row_number() OVER (ORDER BY r_regionkey) AS INTEGER) AS ordinal, 'r' || r_regionkey AS tgt, 'r' || r_regionkey AS stored, false AS sup, false AS exc FROM region
  UNION ALL SELECT 'r' || n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER), 'n' || n_nationkey, 'n' || n_nationkey, false, false FROM nation
  UNION ALL SELECT 'n' || s_nationkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER), 's' || s_suppkey, 's' || s_suppkey, sup, exc FROM sup
  UNION ALL SELECT 's' || l_suppkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INTEGER),
    CASE WHEN l_discount < 0.095 THEN 'p' || l_partkey END, 'lib\\' || 'P' || l_partkey, l_returnflag = 'R', l_linestatus = 'O' AND l_quantity > 45 FROM lineitem),
l1 AS (SELECT [ordinal] AS path, CAST([] AS INTEGER[]) AS up, 1 AS depth, * FROM raw WHERE src = 'world'),
l2 AS (SELECT list_append(l1.path, r.ordinal) AS path, l1.path AS up, 2 AS depth, r.* FROM l1 JOIN raw r ON r.src = l1.tgt),
l3 AS (SELECT list_append(l2.path, r.ordinal) AS path, l2.path AS up, 3 AS depth, r.* FROM l2 JOIN raw r ON r.src = l2.tgt),
l4 AS (SELECT list_append(l3.path, r.ordinal) AS path, l3.path AS up, 4 AS depth, r.ordinal, r.tgt, r.stored, r.sup, r.exc, l3.sup AS psup, l3.exc AS pexc FROM l3 JOIN raw r ON r.src = l3.tgt WHERE NOT l3.sup),
occ AS (
  SELECT CAST([] AS INTEGER[]) AS path, CAST([] AS INTEGER[]) AS up, 0 AS depth, 'world' AS node_id, 'expanded' AS state, true AS counted, false AS under, '' AS stored, 'world' AS document_path, 'assembly' AS kind
  UNION ALL SELECT path, up, depth, tgt, CASE WHEN sup THEN 'suppressed' ELSE 'expanded' END, NOT (sup OR exc), sup, stored, tgt, 'assembly' FROM (SELECT path, up, depth, tgt, stored, sup, exc FROM l1 UNION ALL SELECT path, up, depth, tgt, stored, sup, exc FROM l2 UNION ALL SELECT path, up, depth, tgt, stored, sup, exc FROM l3)
  UNION ALL SELECT path, up, depth, tgt, CASE WHEN tgt IS NULL THEN 'unresolved' WHEN sup THEN 'suppressed' ELSE 'leaf' END, NOT (sup OR exc OR psup OR pexc), sup OR psup, stored, tgt, CASE WHEN tgt IS NOT NULL THEN 'part' END FROM l4),
ranked AS (SELECT row_number() OVER (ORDER BY up, path) - 1 AS n, * FROM occ)
"""


def _graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges world, regions, nations, suppliers, parts; one edge for each line item."""
    text = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    t = lambda name: table(spark, sf_dir, name)
    no = F.lit(False)

    def edges(df, source, target, order, stored=None, suppressed=no, excluded=no):
        kept = df.select(source.alias("source_node_id"), target.alias("target_node_id"), (stored if stored is not None else target).alias("stored_path"), suppressed.alias("is_suppressed"), excluded.alias("exclude_from_bom"), *order)
        return bom.first_edge_order(kept, ["source_node_id"], order).drop(*order)

    line_order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    all_edges = (
        edges(t("region"), F.lit("world"), text("r", "r_regionkey"), ["r_regionkey"])
        .unionByName(edges(t("nation"), text("r", "n_regionkey"), text("n", "n_nationkey"), ["n_nationkey"]))
        .unionByName(edges(t("supplier"), text("n", "s_nationkey"), text("s", "s_suppkey"), ["s_suppkey"], None, F.col("s_acctbal") < 0, F.col("s_acctbal") > 9000))
        .unionByName(edges(t("lineitem"), text("s", "l_suppkey"), F.when(F.col("l_discount") < 0.095, text("p", "l_partkey")), line_order, text("lib\\P", "l_partkey"), F.col("l_returnflag") == "R", (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45)))
    )
    label = F.when(F.col("target_node_id").isNull(), "unresolved").when(F.col("is_suppressed"), "suppressed").otherwise("followed")
    all_edges = all_edges.select(
        "*", F.lit(None).cast("string").alias("referenced_configuration"), F.lit(None).cast("boolean").alias("is_virtual"), F.lit(0).cast("long").alias("source_configuration_index"), label.alias("traversal_status"),
        F.concat_ws("/", "source_node_id", F.col("ordinal").cast("string")).alias("id"),
    )
    one = F.array(F.struct(F.lit(0).cast("long").alias("index"), F.lit("Default").alias("name"))).alias("configurations")
    node = lambda df, column, kind: df.select(column.alias("id"), F.lit(kind).alias("document_kind"), column.alias("path"), one)
    nodes = node(spark.range(1), F.lit("world"), "assembly")
    for name, letter, key, kind in (("region", "r", "r_regionkey", "assembly"), ("nation", "n", "n_nationkey", "assembly"), ("supplier", "s", "s_suppkey", "assembly"), ("part", "p", "p_partkey", "part")):
        nodes = nodes.unionByName(node(t(name), text(letter, key), kind))
    return nodes, all_edges


def _occurrences(spark, sf_dir, most: int | None = None, numbered: bool = True) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return bom.expand(edges, nodes, "world", 0, bom.BomOptions(max_occurrences=most), numbered)


_OCC = "'occ:' || lpad(CAST(a.n AS VARCHAR), 8, '0') AS id, 'occ:' || lpad(CAST(b.n AS VARCHAR), 8, '0') AS parent_id"


@query(_BOM + f"SELECT {_OCC}, a.node_id, CAST(a.depth AS INTEGER) AS depth, a.state AS children_state, a.counted FROM ranked a LEFT JOIN ranked b ON a.depth > 0 AND b.path = a.up")
def bom_occurrences(spark, sf_dir):
    return _occurrences(spark, sf_dir).select("id", "parent_id", "node_id", "depth", "children_state", "counted")


_ITEMS = """SELECT node_id, CASE WHEN node_id IS NULL THEN lower(regexp_extract(stored, '([^\\\\/]*)$', 1)) END AS unresolved_name, CAST(sum(CAST(counted AS INTEGER)) AS BIGINT) AS quantity,
  CAST(count(*) FILTER (NOT counted AND under) AS BIGINT) AS suppressed_quantity, CAST(count(*) FILTER (NOT counted AND NOT under) AS BIGINT) AS excluded_quantity, CAST(min(depth) AS INTEGER) AS minimum_depth, max(kind) AS document_kind, max(document_path) AS document_path
FROM ranked WHERE depth > 0"""


@query(_BOM + _ITEMS + " GROUP BY 1, 2")
def bom_items(spark, sf_dir):
    out = bom.items(_occurrences(spark, sf_dir, numbered=False), ids=False)
    return out.select("node_id", "unresolved_name", "quantity", "suppressed_quantity", "excluded_quantity", "minimum_depth", "document_kind", "document_path")


@query(_BOM + "SELECT * FROM (" + _ITEMS + " GROUP BY 1, 2) WHERE document_kind = 'part'")
def bom_part_items(spark, sf_dir):
    return bom_items(spark, sf_dir).filter("document_kind = 'part'")


@query(_BOM + "SELECT state AS children_state, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(*) FILTER (counted) AS BIGINT) AS counted, CAST(max(depth) AS INTEGER) AS maximum_depth FROM ranked WHERE depth > 0 GROUP BY state")
def bom_summary(spark, sf_dir):
    return bom.summary(_occurrences(spark, sf_dir, numbered=False))


@query(_BOM + f"SELECT {_OCC}, a.node_id FROM ranked a JOIN ranked b ON b.path = a.up WHERE a.depth > 0 AND b.n = 1")
def bom_children(spark, sf_dir):
    return bom.children(_occurrences(spark, sf_dir), "occ:00000001").select("id", "parent_id", "node_id")


@query(_BOM + """SELECT 'occ:' || lpad(CAST(n AS VARCHAR), 8, '0') AS id, node_id, CASE WHEN path = (SELECT up FROM ranked WHERE n = 40) THEN 'limit_reached' ELSE state END AS children_state FROM ranked WHERE n < 40""")
def bom_limit(spark, sf_dir):
    return _occurrences(spark, sf_dir, most=40).select("id", "node_id", "children_state")


# ---- facts and conflicts ------------------------------------------------------------


@query("""
SELECT event_id, v AS raw_value, CASE WHEN v IS NULL THEN 'missing' WHEN event_type IN ('error') THEN 'unsupported_type' WHEN v = '' THEN 'empty' ELSE 'present' END AS value_state FROM (
  SELECT event_id, event_type, CASE WHEN event_type = 'signup' THEN NULL WHEN value < 20 THEN '' ELSE props END AS v FROM events)
""")
def property_state(spark, sf_dir):
    kind = F.col("event_type")
    v = F.when(kind == "signup", F.lit(None)).when(F.col("value") < 20, "").otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", v.alias("raw_value"), values.value_state(v, kind, ("view", "click", "purchase", "signup")).alias("value_state"))


@query("""
SELECT user_id, CASE WHEN count(DISTINCT v) = 1 THEN max(v) END AS value, CAST(count(DISTINCT v) AS BIGINT) AS distinct_values, count(DISTINCT v) > 1 AS withheld FROM (
  SELECT user_id % 5000 AS user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) // 60 AS v FROM events WHERE event_type = 'purchase') GROUP BY user_id
""")
def integer_property_withheld(spark, sf_dir):
    v = F.floor(values.strict_integer(F.regexp_extract("props", "([0-9]+)", 1)) / 60)
    rows = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select((F.col("user_id") % 5000).alias("user_id"), v.alias("v"))
    return conflicts.withheld(rows, ["user_id"], "v")


@query("""
SELECT p_brand, name, CAST(priority AS INTEGER) AS priority, arrival, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY priority, arrival) AS INTEGER) AS place FROM (
  SELECT p_brand, p_name AS name, min(CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'SMALL' THEN 1 ELSE 2 END) AS priority, min(p_partkey) AS arrival FROM part GROUP BY p_brand, p_name)
""")
def ranked_name_merge(spark, sf_dir):
    kind = F.col("p_type")
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("name"), F.when(kind == "ECONOMY", 0).when(kind == "SMALL", 1).otherwise(2).alias("p"), "p_partkey")
    return conflicts.ranked(rows, ["p_brand"], "name", "p", "p_partkey").select("p_brand", "name", "priority", "arrival", "place")


@query("""SELECT p_partkey,
  ['millimeter', 'centimeter', 'meter', 'inch', 'foot', 'feet_inches', 'angstrom', 'nanometer', 'micron', 'mil', 'microinch'][p_size % 15 + 1] AS length_unit,
  ['a_size', 'a_size_vertical', 'b_size', 'c_size', 'd_size', 'e_size', 'a4', 'a4_vertical', 'a3', 'a2', 'a1', 'a0', 'user_defined'][p_size % 20 + 1] AS paper_size,
  ['cgs', 'mks', 'ips', 'mmgs', 'custom'][nullif(p_size % 7, 0)] AS unit_system, ['degrees', 'degrees_minutes', 'degrees_minutes_seconds', 'radians'][p_size % 6 + 1] AS angle_unit, ['milligram', 'gram', 'kilogram', 'pound'][p_size % 5 + 1] AS mass_unit,
  ['cubic_angstrom', 'cubic_nanometer', 'cubic_micron', 'cubic_millimeter', 'cubic_centimeter', 'cubic_meter', 'cubic_microinch', 'cubic_mil', 'cubic_inch', 'cubic_foot'][p_size % 12 + 1] AS volume_unit FROM part""")
def unit_enum_join(spark, sf_dir):
    size = F.col("p_size")
    tables = {"length_unit": (15, values.LENGTH_UNIT), "unit_system": (7, values.UNIT_SYSTEM), "angle_unit": (6, values.ANGLE_UNIT), "mass_unit": (5, values.MASS_UNIT), "volume_unit": (12, values.VOLUME_UNIT)}
    return table(spark, sf_dir, "part").select("p_partkey", values.paper_size(size % 20).alias("paper_size"), *(values.enum_name(size % n, names).alias(c) for c, (n, names) in tables.items()))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 10 THEN true WHEN l_quantity < 20 THEN false WHEN l_quantity < 30 THEN NULL ELSE l_returnflag = 'A' END AS flag FROM lineitem""")
def tristate_bool(spark, sf_dir):
    q = F.col("l_quantity")
    spelled = F.when(q < 10, " YES ").when(q < 20, "False").when(q < 30, "maybe").when(F.col("l_returnflag") == "A", "1").otherwise("0")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", values.tristate(spelled).alias("flag"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 3 END AS n_tokens, p_size % 3 = 0 AS usable, CASE WHEN p_size % 3 = 0 THEN '1.5 ' || p_size || ' -2e3' END AS tokens FROM part")
def token_records(spark, sf_dir):
    k = F.col("p_size") % 3
    text = F.when(k == 0, F.concat(F.lit(" 1.5\t"), F.col("p_size").cast("string"), F.lit("  -2e3 "))).when(k == 1, "1 2 x").otherwise("1 2")
    found = values.tokens(text, 3)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(found.isNotNull(), F.size(found)).alias("n_tokens"), found.isNotNull().alias("usable"), F.array_join(found, " ").alias("tokens"))


_CLASSED = "SELECT d.doc_id, source, n_chars, CASE WHEN quality IS NULL THEN 'uninterpreted' WHEN toxic = 1 THEN 'malformed' WHEN quality = 1 THEN 'fully' ELSE 'partially' END AS class FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


def _classed(spark, sf_dir):
    q = F.col("quality")
    cls = F.when(q.isNull(), "uninterpreted").when(F.col("toxic") == 1, "malformed").when(q == 1, "fully").otherwise("partially")
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "source", "n_chars", cls.alias("class"))


@query("SELECT source, " + ", ".join(f"CAST(count(*) FILTER (class = '{c}') AS BIGINT) AS {c}_streams, CAST(coalesce(sum(n_chars) FILTER (class = '{c}'), 0) AS BIGINT) AS {c}_bytes" for c in conflicts.CLASSES) + f" FROM ({_CLASSED}) GROUP BY source")
def semantic_coverage(spark, sf_dir):
    return conflicts.coverage(_classed(spark, sf_dir), ["source"], "class", "n_chars")


@query(f"SELECT doc_id, class, n_chars FROM ({_CLASSED}) WHERE class <> 'fully'")
def unknown_records(spark, sf_dir):
    return _classed(spark, sf_dir).filter("class <> 'fully'").select("doc_id", "class", "n_chars")


@query(f"SELECT source, CASE max(CASE class WHEN 'uninterpreted' THEN 1 WHEN 'fully' THEN 2 WHEN 'partially' THEN 3 ELSE 4 END) WHEN 1 THEN 'uninterpreted' WHEN 2 THEN 'fully' WHEN 3 THEN 'partially' ELSE 'malformed' END AS class FROM ({_CLASSED}) GROUP BY source")
def class_upgrade(spark, sf_dir):
    return conflicts.upgraded(_classed(spark, sf_dir), ["source"], "class")


@query("SELECT event_type AS code, CAST(count(*) AS BIGINT) AS n, min(CASE WHEN value > 100 THEN 'error' ELSE 'warning' END) AS severity FROM events GROUP BY event_type")
def loss_book(spark, sf_dir):
    return conflicts.loss_book(table(spark, sf_dir, "events").select(F.col("event_type").alias("code"), F.when(F.col("value") > 100, "error").otherwise("warning").alias("severity")))


@query("""
WITH a AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part WHERE p_type = 'ECONOMY'), b AS (SELECT p_brand, p_partkey AS other, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part WHERE p_type = 'SMALL')
SELECT p_brand, CAST(k AS INTEGER) AS k, p_partkey, other FROM a JOIN b USING (p_brand, k)
""")
def kth_pairing(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    left, right = part.filter("p_type = 'ECONOMY'").select("p_brand", "p_partkey"), part.filter("p_type = 'SMALL'").select("p_brand", F.col("p_partkey").alias("other"))
    return conflicts.paired(left, right, "p_brand", "p_partkey", "other").select("p_brand", "k", "p_partkey", "other")


# ---- intervals ----------------------------------------------------------------------

_SPANS = "SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 60) AS BIGINT) * 1000000 AS e FROM events"
_ISLANDS = f"""WITH spans AS ({_SPANS}), marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM spans WHERE e > s),
placed AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked),
islands AS (SELECT user_id, min(s) AS "start", max(e) AS "end" FROM placed GROUP BY user_id, island),
bounds AS (SELECT user_id, min(s) - 1000000 AS lower, max(e) + 1000000 AS upper FROM spans GROUP BY user_id),
near AS (SELECT user_id, lower, upper, "start", "end", lag("end") OVER w AS b, lead("start") OVER w AS a FROM bounds LEFT JOIN islands USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY "start")),
gaps AS (SELECT * FROM (SELECT user_id, lower AS "start", coalesce("start", upper) AS "end" FROM near WHERE b IS NULL UNION ALL SELECT user_id, "end", coalesce(a, upper) FROM near) WHERE "end" > "start")
"""


def _spans(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = table(spark, sf_dir, "events").select("user_id", micros.alias("start"), (micros + F.floor(F.col("value") * 60).cast("long") * 1_000_000).alias("end"))
    return spans, spans.groupBy("user_id").agg((F.min("start") - 1_000_000).alias("lower"), (F.max("end") + 1_000_000).alias("upper"))


@query(_ISLANDS + "SELECT * FROM islands")
def range_union(spark, sf_dir):
    return intervals.union(_spans(spark, sf_dir)[0], ["user_id"])


@query(_ISLANDS + "SELECT * FROM gaps")
def range_complement(spark, sf_dir):
    spans, bounds = _spans(spark, sf_dir)
    return intervals.complement(intervals.union(spans, ["user_id"]), bounds, ["user_id"])


@query(_ISLANDS + """, parts AS (SELECT user_id, "start", "end", 'typed' AS classification FROM islands UNION ALL SELECT user_id, "start", "end", 'uninterpreted' FROM gaps), stored AS (SELECT user_id, "start", "end", 'typed' AS classification FROM islands)
SELECT user_id, "start", "end", classification, 'recomputed' AS side FROM (SELECT * FROM parts EXCEPT ALL SELECT * FROM stored)""")
def range_partition_audit(spark, sf_dir):
    spans, bounds = _spans(spark, sf_dir)
    stored = intervals.union(spans, ["user_id"]).withColumn("classification", F.lit("typed"))
    return intervals.audit(stored, spans, bounds, ["user_id"])


@query(f"""SELECT user_id, s AS "start", e AS "end", CASE WHEN e <= s THEN 'empty' ELSE 'outside' END AS reason FROM (SELECT *, (SELECT max(epoch_us(ts)) FROM events) AS upper FROM ({_SPANS})) WHERE e <= s OR e > upper""")
def range_faults(spark, sf_dir):
    spans, _ = _spans(spark, sf_dir)
    last = spans.agg(F.max("start").alias("upper")).first()["upper"]
    bounds = spans.select("user_id").distinct().withColumns({"lower": F.lit(0).cast("long"), "upper": F.lit(last).cast("long")})
    return intervals.faulty(spans, bounds, ["user_id"])


# ---- differences ----------------------------------------------------------------------

_SIDES = "a AS (SELECT lang, n_chars // 100 AS size_class, doc_id // 20 AS page, md5(text) AS content FROM documents WHERE doc_id % 2 = 0), b AS (SELECT lang, n_chars // 100 AS size_class, doc_id // 20 AS page, md5(text) AS content FROM documents WHERE doc_id % 2 = 1)"


def _sides(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.floor(F.col("n_chars") / 100).alias("size_class"), F.floor(F.col("doc_id") / 20).alias("page"), F.md5("text").alias("content"))
    return docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")


@query(f"""WITH {_SIDES}, ca AS (SELECT lang, size_class, count(*) AS n FROM a GROUP BY ALL), cb AS (SELECT lang, size_class, count(*) AS n FROM b GROUP BY ALL)
SELECT lang, size_class, CAST(least(coalesce(ca.n, 0), coalesce(cb.n, 0)) AS BIGINT) AS kept, CAST(greatest(coalesce(ca.n, 0) - coalesce(cb.n, 0), 0) AS BIGINT) AS removed, CAST(greatest(coalesce(cb.n, 0) - coalesce(ca.n, 0), 0) AS BIGINT) AS added
FROM ca FULL JOIN cb USING (lang, size_class)""")
def multiset_delta(spark, sf_dir):
    before, after = _sides(spark, sf_dir)
    return delta.multiset(before, after, ["lang", "size_class"])


@query(f"""WITH {_SIDES}, ca AS (SELECT lang, size_class, content, count(*) AS n FROM a GROUP BY ALL), cb AS (SELECT lang, size_class, content, count(*) AS n FROM b GROUP BY ALL),
j AS (SELECT lang, size_class, content, coalesce(ca.n, 0) AS x, coalesce(cb.n, 0) AS y FROM ca FULL JOIN cb USING (lang, size_class, content)),
k AS (SELECT lang, size_class, sum(x) AS nb, sum(y) AS na, sum(least(x, y)) AS same, sum(greatest(x - y, 0)) AS gone, sum(greatest(y - x, 0)) AS new FROM j GROUP BY ALL)
SELECT lang, size_class, CAST(same AS BIGINT) AS preserved, CAST(CASE WHEN nb = 1 AND na = 1 AND same = 0 THEN 1 ELSE 0 END AS INTEGER) AS changed, CAST(CASE WHEN nb = 1 AND na = 1 THEN 0 ELSE gone END AS BIGINT) AS removed, CAST(CASE WHEN nb = 1 AND na = 1 THEN 0 ELSE new END AS BIGINT) AS added FROM k""")
def record_delta(spark, sf_dir):
    before, after = _sides(spark, sf_dir)
    return delta.records(before, after, ["lang", "size_class"], "content")


@query("""WITH a AS (SELECT conv_id, turn, role, length(text) AS size FROM conversations WHERE conv_id % 2 = 0), b AS (SELECT conv_id - 1 AS conv_id, turn, role, length(text) AS size FROM conversations WHERE conv_id % 2 = 1)
SELECT conv_id, turn, CASE WHEN b.role IS NULL THEN 'removed' WHEN a.role IS NULL THEN 'added' WHEN a.role = b.role AND a.size = b.size THEN 'preserved' ELSE 'changed' END AS status FROM a FULL JOIN b USING (conv_id, turn)""")
def carrier_delta(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.char_length("text").alias("size"))
    return delta.carriers(c.filter("conv_id % 2 = 0"), c.filter("conv_id % 2 = 1").withColumn("conv_id", F.col("conv_id") - 1), ["conv_id", "turn"], ["role", "size"])


@query("""WITH v AS (SELECT c.conv_id, c.turn, c.role, p.role AS sheet FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1),
ca AS (SELECT sheet, role, turn, count(*) AS n FROM v WHERE conv_id % 2 = 0 GROUP BY ALL), cb AS (SELECT sheet, role, turn, count(*) AS n FROM v WHERE conv_id % 2 = 1 GROUP BY ALL)
SELECT sheet, role, turn, CAST(sum(least(x, y)) AS BIGINT) AS kept, CAST(sum(greatest(x - y, 0)) AS BIGINT) AS removed, CAST(sum(greatest(y - x, 0)) AS BIGINT) AS added FROM (
  SELECT sheet, role, turn, sum(x) AS x, sum(y) AS y FROM (SELECT sheet, role, turn, n AS x, 0 AS y FROM ca UNION ALL SELECT sheet, role, turn, 0, n FROM cb) GROUP BY ALL) GROUP BY ALL""")
def view_delta(spark, sf_dir):
    v = _with_parent(spark, sf_dir).select("conv_id", "turn", "role", F.col("parent_shown").alias("sheet"))
    return delta.multiset(v.filter("conv_id % 2 = 0"), v.filter("conv_id % 2 = 1"), ["sheet", "role", "turn"])


def _with_parent(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.col("conv_id") * 10_000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 10_000 + F.col("turn") - 1).alias("parent"))
    return delta.hierarchy(c, "id", "parent", "role")


@query("SELECT c.conv_id, c.turn, c.role, p.role AS parent_role FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")
def hierarchy_join(spark, sf_dir):
    return _with_parent(spark, sf_dir).select("conv_id", "turn", "role", F.col("parent_shown").alias("parent_role"))


# ---- meshes -------------------------------------------------------------------------
# Each embedding's first nine values are one triangle of the mesh named by its label; coordinates are whole thousandths, so that sums are exact.

_TRI = "SELECT label AS mesh_id, vec_id, " + ", ".join(f"CAST(floor(CAST(embedding[{i + 1}] AS DOUBLE) * 1000) AS DOUBLE) AS c{i}" for i in range(9)) + " FROM embeddings"
_N = "(c4-c1)*(c8-c2)-(c5-c2)*(c7-c1) AS nx, (c5-c2)*(c6-c0)-(c3-c0)*(c8-c2) AS ny, (c3-c0)*(c7-c1)-(c4-c1)*(c6-c0) AS nz"


def _mesh(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    value = lambda i: F.floor(F.element_at("embedding", i + 1).cast("double") * 1000).cast("double")
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("mesh_id"), "vec_id", *(value(i).alias(f"c{i}") for i in range(9)))
    v = e.select("mesh_id", F.explode(F.array(*(F.struct((F.col("vec_id") * 3 + k).alias("vertex"), F.col(f"c{3 * k}").alias("x"), F.col(f"c{3 * k + 1}").alias("y"), F.col(f"c{3 * k + 2}").alias("z")) for k in range(3)))).alias("v")).select("mesh_id", "v.*")
    t = e.select("mesh_id", F.col("vec_id").alias("triangle"), (F.col("vec_id") * 3).alias("a"), (F.col("vec_id") * 3 + 1).alias("b"), (F.col("vec_id") * 3 + 2).alias("c"))
    return v, t


@query(f"""SELECT mesh_id, CAST(count(*) AS BIGINT) AS triangles, CAST(sum(CAST(floor(sqrt(nx*nx+ny*ny+nz*nz) / 2) AS BIGINT)) AS BIGINT) AS area, CAST(sum(CAST(floor((c0*(c4*c8-c5*c7)+c1*(c5*c6-c3*c8)+c2*(c3*c7-c4*c6)) / 6) AS BIGINT)) AS BIGINT) AS signed_volume
FROM (SELECT *, {_N} FROM ({_TRI})) GROUP BY mesh_id""")
def mesh_area_volume(spark, sf_dir):
    v, t = _mesh(spark, sf_dir)
    m = mesh.measured(mesh.corners(t, v))
    return m.groupBy("mesh_id").agg(F.count("*").alias("triangles"), F.sum(F.floor("area").cast("long")).alias("area"), F.sum(F.floor("volume").cast("long")).alias("signed_volume"))


@query(f"""WITH t AS ({_TRI}), w AS (SELECT mesh_id, vec_id * 3 AS a, vec_id * 3 + 1 AS b, vec_id * 3 + 2 AS c FROM t), s AS (SELECT mesh_id, a AS p, b AS q FROM w UNION ALL SELECT mesh_id, b, c FROM w UNION ALL SELECT mesh_id, c, a FROM w)
SELECT mesh_id, least(p, q) AS lo, greatest(p, q) AS hi, CAST(count(*) AS BIGINT) AS uses, count(*) = 1 AS boundary FROM s GROUP BY ALL""")
def mesh_edge_uses(spark, sf_dir):
    v, t = _mesh(spark, sf_dir)
    return mesh.edge_kinds(mesh.edge_uses(mesh.measured(mesh.corners(t, v)))).select("mesh_id", "lo", "hi", "uses", "boundary")


_V = f"SELECT mesh_id, vec_id * 3 AS vertex, c0 AS x, c1 AS y, c2 AS z FROM ({_TRI}) UNION ALL SELECT mesh_id, vec_id * 3 + 1, c3, c4, c5 FROM ({_TRI}) UNION ALL SELECT mesh_id, vec_id * 3 + 2, c6, c7, c8 FROM ({_TRI})"


@query(f"SELECT mesh_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, CAST(count(*) AS BIGINT) AS points, bool_and(x < 300) AS exact FROM ({_V}) GROUP BY mesh_id")
def mesh_bounds(spark, sf_dir):
    v, _ = _mesh(spark, sf_dir)
    return mesh.bounds(v.withColumn("ok", F.col("x") < 300), ["mesh_id"], "ok")


@query(f"""WITH v AS (SELECT mesh_id, vertex, floor(x / 100) AS x, floor(y / 100) AS y FROM ({_V})), m AS (SELECT mesh_id, vertex, min(vertex) OVER (PARTITION BY mesh_id, x, y) AS canon FROM v),
t AS (SELECT label AS mesh_id, vec_id FROM embeddings), w AS (SELECT t.mesh_id, vec_id, a.canon AS a, b.canon AS b, c.canon AS c FROM t JOIN m a ON a.mesh_id = t.mesh_id AND a.vertex = vec_id * 3 JOIN m b ON b.mesh_id = t.mesh_id AND b.vertex = vec_id * 3 + 1 JOIN m c ON c.mesh_id = t.mesh_id AND c.vertex = vec_id * 3 + 2),
s AS (SELECT mesh_id, vec_id * 3 AS seq, a AS p, b AS q FROM w UNION ALL SELECT mesh_id, vec_id * 3 + 1, b, c FROM w UNION ALL SELECT mesh_id, vec_id * 3 + 2, c, a FROM w),
o AS (SELECT mesh_id, least(p, q) AS lo, greatest(p, q) AS hi, count(*) AS n, min(seq) AS seq FROM s WHERE p <> q GROUP BY 1, 2, 3)
SELECT mesh_id, lo, hi, CAST(row_number() OVER (PARTITION BY mesh_id ORDER BY seq) AS INTEGER) AS place FROM o WHERE n = 1""")
def outline_edges(spark, sf_dir):
    v, t = _mesh(spark, sf_dir)
    coarse = v.select("mesh_id", "vertex", F.floor(F.col("x") / 100).alias("x"), F.floor(F.col("y") / 100).alias("y"), F.lit(0).alias("z"))
    return mesh.outline(t, coarse)


@query(f"""SELECT mesh_id, vertex, CAST(round(CASE WHEN s > 0 THEN nx / s ELSE 0 END, 6) + 0.0 AS DOUBLE) AS nx, CAST(round(CASE WHEN s > 0 THEN ny / s ELSE 0 END, 6) + 0.0 AS DOUBLE) AS ny, CAST(round(CASE WHEN s > 0 THEN nz / s ELSE 1 END, 6) + 0.0 AS DOUBLE) AS nz
FROM (SELECT mesh_id, unnest([vec_id * 3, vec_id * 3 + 1, vec_id * 3 + 2]) AS vertex, nx, ny, nz, sqrt(nx*nx+ny*ny+nz*nz) AS s FROM (SELECT *, {_N} FROM ({_TRI})))""")
def derived_normals(spark, sf_dir):
    v, t = _mesh(spark, sf_dir)
    return mesh.normals(t, v).select("mesh_id", "vertex", *((F.round(f"n{k}", 6) + 0.0).alias(f"n{k}") for k in "xyz"))


@query("SELECT label AS mesh_id, vec_id AS part, CAST(coalesce(sum(vec_id % 7 + 1) OVER w, 0) AS BIGINT) AS vertices_offset, CAST(coalesce(sum(vec_id % 5 + 1) OVER w, 0) AS BIGINT) AS triangles_offset FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def packed_offsets(spark, sf_dir):
    parts = table(spark, sf_dir, "embeddings").select(F.col("label").alias("mesh_id"), F.col("vec_id").alias("part"), (F.col("vec_id") % 7 + 1).alias("vertices"), (F.col("vec_id") % 5 + 1).alias("triangles"))
    return mesh.packed_offsets(parts, "part", ["vertices", "triangles"], ["mesh_id"]).drop("vertices", "triangles")


# ---- evaluation, topology, geometry ---------------------------------------------------


@query("""SELECT 1 AS doc_id, 'lineitem' AS "table", CAST(l_orderkey AS VARCHAR) AS id, 'l_partkey' AS "column", 'part' AS parent, CAST(l_partkey AS VARCHAR) AS missing FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 45)
UNION ALL SELECT 1, 'orders', CAST(o_orderkey AS VARCHAR), 'o_custkey', 'customer', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def topology_fk_errors(spark, sf_dir):
    one = F.lit(1).alias("doc_id")
    line = table(spark, sf_dir, "lineitem").select(one, F.col("l_orderkey").alias("id"), "l_partkey")
    part = table(spark, sf_dir, "part").filter("p_size < 45").select(one, F.col("p_partkey").alias("id"))
    orders = table(spark, sf_dir, "orders").select(one, F.col("o_orderkey").alias("id"), "o_custkey")
    customer = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(one, F.col("c_custkey").alias("id"))
    return topology.dangling(line, "l_partkey", part, "lineitem", "part").unionByName(topology.dangling(orders, "o_custkey", customer, "orders", "customer"))


@query("""WITH rows AS (SELECT r_regionkey AS body, n_nationkey AS face, s_suppkey AS loop, l_orderkey AS edge, l_partkey AS v, l_partkey // 2 AS w FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey),
f AS (SELECT body, face, count(DISTINCT loop) AS n FROM rows GROUP BY ALL), d AS (SELECT body, bool_and(n = 1) AS disks, count(*) AS faces, sum(n) AS loops FROM f GROUP BY body)
SELECT body, CAST(faces AS BIGINT) AS faces, CAST(loops AS BIGINT) AS loops, CAST((SELECT count(DISTINCT edge) FROM rows r WHERE r.body = d.body) AS BIGINT) AS edges, CAST((SELECT count(DISTINCT x) FROM (SELECT v AS x FROM rows r WHERE r.body = d.body UNION ALL SELECT w FROM rows r WHERE r.body = d.body)) AS BIGINT) AS vertices, disks FROM d""")
def topology_census(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    one = F.lit(1).alias("doc_id")
    line = t("lineitem").select(F.col("l_orderkey").alias("edge"), F.col("l_suppkey").alias("loop"), F.col("l_partkey").alias("v"), F.monotonically_increasing_id().alias("c"))
    tables = {
        "regions": t("nation").select(one, F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("body")),
        "shells": t("nation").select(one, F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("region")),
        "faces": t("supplier").select(one, F.col("s_nationkey").alias("id"), F.col("s_nationkey").alias("shell")).distinct(),
        "loops": t("supplier").select(one, F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("face")),
        "coedges": line.select(one, F.concat_ws("/", "edge", "loop", "v").alias("id"), "loop", F.concat_ws("/", "edge", "v").alias("edge")).distinct(),
        "edges": line.select(one, F.concat_ws("/", "edge", "v").alias("id"), F.col("v").alias("start"), F.floor(F.col("v") / 2).alias("end")).distinct(),
    }
    whole = topology.census(tables).select("body", "faces", "loops", "vertices", "disks")
    nation = t("nation").select("n_nationkey", F.col("n_regionkey").alias("body"))
    loops = t("supplier").select(F.col("s_suppkey").alias("loop"), "s_nationkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("loop", "body")
    edges = line.join(loops, "loop").groupBy("body").agg(F.count_distinct("edge").alias("edges"))
    return whole.join(edges, "body").select("body", "faces", "loops", "edges", "vertices", "disks")


@query("""SELECT p_partkey, CAST(i AS INTEGER) AS i, round(r * cos(2 * pi() * i / n), 4) + 0.0 AS x, round(r * sin(2 * pi() * i / n), 4) + 0.0 AS y FROM (
  SELECT p_partkey, r, n, unnest(range(n + 1)) AS i FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS r, CAST(least(greatest(ceil(round(2 * pi() / least(2 * acos(greatest(-1.0, 1 - 0.5 / p_size)), pi() / 2), 9)), 1), 512) AS INTEGER) AS n FROM part))""")
def conic_sampling(spark, sf_dir):
    from lathe.operators import curves

    return curves.circle_points(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("r")), "r", 0.5).select("p_partkey", "i", F.col("x"), F.col("y"))


@query("SELECT s_suppkey, round(abs(s_acctbal) * (1 - cos(pi() / (s_suppkey % 7 + 3))), 3) AS sagitta FROM supplier")
def chord_distance(spark, sf_dir):
    turn = F.pi() / (F.col("s_suppkey") % 7 + 3)
    r = F.abs("s_acctbal")
    middle, a, b = [r, F.lit(0.0)], [r * F.cos(turn), r * F.sin(turn)], [r * F.cos(turn), -r * F.sin(turn)]
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(nearest.to_segment(middle, a, b), 3).alias("sagitta"))


@query("SELECT p_partkey, abs(p_retailprice - (900 + p_partkey * 0.1)) <= greatest(0.05, 0.001 * abs(900 + p_partkey * 0.1)) AS within FROM part")
def tolerance_compare(spark, sf_dir):
    expected = F.lit(900) + F.col("p_partkey") * 0.1
    return table(spark, sf_dir, "part").select("p_partkey", values.within(F.col("p_retailprice"), expected, 0.05, 0.001).alias("within"))


@query("SELECT a.vec_id, list_max(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) <= 0.25 AS within FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_compare(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", values.vector_within(F.col("embedding"), F.col("other"), 0.25).alias("within"))


@query("""WITH s AS (SELECT vec_id, embedding FROM embeddings WHERE label < 3), p AS (SELECT vec_id AS id, embedding AS e FROM embeddings WHERE label >= 3),
d AS (SELECT id, vec_id, sqrt(pow(CAST(e[1] AS DOUBLE) - CAST(embedding[1] AS DOUBLE), 2) + pow(CAST(e[2] AS DOUBLE) - CAST(embedding[2] AS DOUBLE), 2)) AS dist FROM p JOIN s ON abs(floor(CAST(e[1] AS DOUBLE) / 0.05) - floor(CAST(embedding[1] AS DOUBLE) / 0.05)) <= 2 AND abs(floor(CAST(e[2] AS DOUBLE) / 0.05) - floor(CAST(embedding[2] AS DOUBLE) / 0.05)) <= 2)
SELECT p.id, round(min(dist), 6) AS distance FROM p LEFT JOIN d ON d.id = p.id GROUP BY p.id""")
def grid_nearest(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    x = lambda i: F.element_at("embedding", i).cast("double")
    points = e.filter("label >= 3").select(F.col("vec_id").alias("id"), x(1).alias("x"), x(2).alias("y"))
    dots = e.filter("label < 3").select(F.col("vec_id").alias("segment"), x(1).alias("ax"), x(2).alias("ay"), x(1).alias("bx"), x(2).alias("by"))
    return nearest.grid_nearest(points, dots, 0.05, axes="xy").select("id", F.round("distance", 6).alias("distance"))


@query("SELECT o_orderpriority, round(avg(CASE WHEN o_totalprice <= 200000 THEN 1.0 ELSE 0.0 END), 6) AS fraction, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority")
def fraction_within(spark, sf_dir):
    out = nearest.fraction_within(table(spark, sf_dir, "orders"), "o_totalprice", 200000.0, ["o_orderpriority"])
    return out.select("o_orderpriority", F.round("fraction", 6).alias("fraction"), "n")


@query("""WITH r AS (SELECT o_orderpriority, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, min(v) AS minimum, max(CASE WHEN k = CAST(ceil(n * 0.5) AS BIGINT) THEN v END) AS median, max(CASE WHEN k = CAST(ceil(n * 0.95) AS BIGINT) THEN v END) AS p95, max(v) AS maximum, CAST(max(n) AS BIGINT) AS n FROM r GROUP BY o_orderpriority""")
def nearest_rank_distribution(spark, sf_dir):
    return nearest.distribution(table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice"), "o_totalprice", ["o_orderpriority"])


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'face' WHEN p_size % 2 = 0 THEN 'feature' ELSE 'body' END AS color FROM part")
def color_precedence(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", values.color(F.when(size % 3 == 0, "face"), F.when(size % 2 == 0, "feature"), F.lit("body")).alias("color"))


@query("SELECT s_suppkey, round((v & 255) / 255.0, 6) AS red, round(((v >> 8) & 255) / 255.0, 6) AS green, round(((v >> 16) & 255) / 255.0, 6) AS blue, CAST(1 AS DOUBLE) AS alpha FROM (SELECT s_suppkey, (s_suppkey * 2654435761) & 4294967295 AS v FROM supplier)")
def packed_rgba(spark, sf_dir):
    v = (F.col("s_suppkey") * F.lit(2654435761)).bitwiseAND(F.lit(4294967295))
    rgba = values.packed_rgba(v)
    return table(spark, sf_dir, "supplier").select("s_suppkey", *(F.round(rgba[i], 6).alias(n) for i, n in enumerate(("red", "green", "blue", "alpha"))))


@query("SELECT s_suppkey, s_nationkey, min(CASE WHEN s_acctbal > 5000 THEN s_suppkey END) OVER (PARTITION BY s_nationkey) AS owner FROM supplier")
def instance_owner(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.lit(1).alias("doc_id"), F.col("s_nationkey").alias("id"), F.col("s_suppkey").alias("ordinal"), (F.col("s_acctbal") > 5000).alias("owns_tables"))
    return topology.instance_owner(rows).select(F.col("ordinal").alias("s_suppkey"), F.col("id").alias("s_nationkey"), "owner")
