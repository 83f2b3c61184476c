"""Bill of materials: occurrences, grouped items, summary.

Expansion goes level by level: the open occurrences of a level join the edges of
their (node, configuration). Each occurrence carries the ordinals of its
ancestors and three flags of its chain, so no ancestor is looked up again. In
source order all children of an occurrence are numbered before the first of them
is expanded; that is the order (ancestors' ordinals, own ordinal), so ids are
given by one distributed sort at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import cut, number


@dataclass(frozen=True)
class BomOptions:
    include_suppressed: bool = False
    include_excluded: bool = False
    #: None: no cap.
    max_occurrences: int | None = 1_000_000
    max_depth: int = 256


#: Columns that edges need: id, source_node_id, source_configuration_index, ordinal, target_node_id, traversal_status, referenced_configuration, stored_path, is_suppressed, exclude_from_bom, is_virtual.
#: Columns that nodes need: id, document_kind, path, configurations array<struct<index,name>>.


def _chosen_configuration() -> Column:
    """Index of the one configuration that the edge names, or of the only one."""
    fits = F.filter("configurations", lambda c: F.col("referenced_configuration").isNull() | (c["name"] == F.col("referenced_configuration")))
    return F.when(F.size(fits) == 1, F.element_at(fits, 1)["index"])


def root_configuration(nodes: DataFrame, root: str, name: str | None) -> int:
    """The root's configuration: the named one, or the only one."""
    row = nodes.filter(F.col("id") == root).select("configurations").first()
    found = [c["index"] for c in row["configurations"] if name is None or c["name"] == name] if row else []
    if len(found) != 1:
        raise ValueError(f"root {root!r} has {len(found)} configurations that fit {name!r}")
    return found[0]


def expand(edges: DataFrame, nodes: DataFrame, root: str, configuration: int, options: BomOptions = BomOptions(), numbered: bool = True) -> DataFrame:  # noqa: B008
    """Occurrence rows; the root is row 0.

    Not ``numbered``: without id and parent_id, which spares the sort, where the
    cap isn't met; items and their counts need neither. Beyond the cap the rows
    are the first in source order; the parent of the first row left out has the
    state ``limit_reached``, as have rows that ``max_depth`` keeps from growing.
    """
    spark = edges.sparkSession
    facts = nodes.select(F.col("id").alias("target_node_id"), "document_kind", F.col("path").alias("document_path"), "configurations")
    joined = edges.join(facts, "target_node_id", "left")
    suppressed = F.coalesce(F.col("is_suppressed"), F.lit(False)) & F.lit(not options.include_suppressed)
    excluded = F.coalesce(F.col("exclude_from_bom"), F.lit(False)) & F.lit(not options.include_excluded)
    goes_on = F.col("traversal_status").isin("followed", "reused")
    chosen = _chosen_configuration()
    state = (
        F.when(F.col("target_node_id").isNull(), "unresolved")
        .when(F.col("traversal_status") == "suppressed", F.lit("suppressed") if not options.include_suppressed else F.when(F.coalesce(F.col("document_kind") == "assembly", F.lit(False)), "not_traversed").otherwise("leaf"))
        .when(~F.coalesce(F.col("document_kind") == "assembly", F.lit(False)), "leaf")
        .when(goes_on, F.when(chosen.isNotNull(), "expanded").otherwise("configuration_unresolved"))
        .otherwise("not_traversed")
    )
    children = cut(
        joined.select(
            F.col("source_node_id").alias("from_node"), F.col("source_configuration_index").alias("from_configuration"), "ordinal", F.col("target_node_id").alias("node_id"), F.col("id").alias("edge_id"),
            "stored_path", "referenced_configuration", "document_kind", "document_path", "is_suppressed", "exclude_from_bom", "is_virtual", state.alias("children_state"),
            F.when(state == "expanded", chosen).alias("configuration_index"), suppressed.alias("cut_suppressed"), excluded.alias("cut_excluded"), F.coalesce("is_suppressed", F.lit(False)).alias("own_suppressed"),
        )
    )
    kinds = {f.name: f.dataType for f in children.schema}
    null = lambda name: F.lit(None).cast(kinds[name]).alias(name)
    level = spark.range(1).select(
        F.array().cast("array<int>").alias("parent_path"), F.array().cast("array<int>").alias("path"), F.lit(0).alias("depth"), F.lit(root).alias("node_id"), null("edge_id"), null("stored_path"), null("referenced_configuration"),
        null("is_suppressed"), null("exclude_from_bom"), null("is_virtual"), F.lit("expanded").alias("children_state"), F.lit(configuration).cast("long").alias("configuration_index"),
        F.lit(False).alias("chain_suppressed"), F.lit(False).alias("chain_excluded"), F.lit(False).alias("under_suppressed"), F.lit(True).alias("counted"),
    ).join(nodes.select(F.col("id").alias("node_id"), "document_kind", F.col("path").alias("document_path")), "node_id", "left")
    columns = [
        "parent_path", "path", "depth", "node_id", "edge_id", "stored_path", "referenced_configuration", "document_kind", "document_path", "is_suppressed", "exclude_from_bom", "is_virtual", "children_state", "configuration_index",
        "chain_suppressed", "chain_excluded", "under_suppressed", "counted",
    ]
    done = level = cut(level.select(columns))
    rows, most, edge = 1, options.max_occurrences, None
    for depth in range(options.max_depth + 1):
        up = level.filter("children_state = 'expanded'").select(
            F.col("path").alias("up_path"), F.col("depth").alias("up_depth"), F.col("node_id").alias("from_node"), F.col("configuration_index").alias("from_configuration"),
            F.col("chain_suppressed").alias("up_suppressed"), F.col("chain_excluded").alias("up_excluded"), F.col("under_suppressed").alias("up_under"),
        )
        down = up.join(children, ["from_node", "from_configuration"]).select(
            F.col("up_path").alias("parent_path"), F.concat("up_path", F.array("ordinal")).alias("path"), (F.col("up_depth") + 1).alias("depth"), "node_id", "edge_id", "stored_path", "referenced_configuration", "document_kind", "document_path",
            "is_suppressed", "exclude_from_bom", "is_virtual", "children_state", "configuration_index",
            (F.col("up_suppressed") | F.col("cut_suppressed")).alias("chain_suppressed"), (F.col("up_excluded") | F.col("cut_excluded")).alias("chain_excluded"), (F.col("up_under") | F.col("own_suppressed")).alias("under_suppressed"),
        ).withColumn("counted", ~(F.col("chain_suppressed") | F.col("chain_excluded")))
        if depth == options.max_depth:
            # Rows that would still grow say so.
            cut_off = down.select(F.col("parent_path").alias("path"), F.lit(True).alias("grows")).distinct()
            done = done.join(cut_off, "path", "left").withColumn("children_state", F.when(F.col("grows"), "limit_reached").otherwise(F.col("children_state"))).select(columns)
            break
        level = cut(down.select(columns))
        found = level.count()
        if not found:
            break
        done = done.unionByName(level)
        rows += found
        if most is not None and rows > most:
            # Only the first rows in source order are wanted, and one more, behind which expansion stops.
            edge = _place(done, most)
            done = done.filter(_key("parent_path", "path") <= edge)
            level = level.filter(F.col("path") < edge["parent_path"])
    if not numbered and edge is None:
        return done.drop("parent_path", "path", "chain_suppressed", "chain_excluded")
    return _identify(done, most)


def _key(parent: str, own: str) -> Column:
    """Source order: ancestors' ordinals, then the own ones."""
    return F.struct(F.col(parent).alias("parent_path"), F.col(own).alias("path"))


def _place(rows: DataFrame, n: int) -> Column:
    """Key of row ``n`` (from 0) in source order, as a literal."""
    row = number(rows.select("parent_path", "path"), ["parent_path", "path"], "n").filter(F.col("n") == n).first()
    ordinals = lambda path: F.array(*map(F.lit, path)).cast("array<int>")
    return F.struct(ordinals(row["parent_path"]).alias("parent_path"), ordinals(row["path"]).alias("path"))


def _identify(rows: DataFrame, most: int | None) -> DataFrame:
    """Ids in source order, parents' ids, and the cap."""
    numbered = number(rows, ["parent_path", "path"], "n")
    if most is not None:
        # The parent of the first row beyond the cap is where expansion stopped.
        over = numbered.filter(F.col("n") == most).select(F.col("parent_path").alias("stopped"))
        numbered = numbered.filter(F.col("n") < most).join(F.broadcast(over), F.col("path") == F.col("stopped"), "left")
        numbered = numbered.withColumn("children_state", F.when(F.col("stopped").isNotNull(), "limit_reached").otherwise(F.col("children_state"))).drop("stopped")
    ids = numbered.select(F.col("path").alias("parent_path"), F.col("n").alias("parent_n"))
    named = lambda n: F.concat(F.lit("occ:"), F.lpad(n.cast("string"), 8, "0"))
    out = numbered.join(ids, "parent_path", "left")
    return out.select(named(F.col("n")).alias("id"), F.when(F.col("depth") > 0, named(F.col("parent_n"))).alias("parent_id"), *(c for c in rows.columns if c not in ("parent_path", "path", "chain_suppressed", "chain_excluded")))


def items(occurrences: DataFrame, ids: bool = True) -> DataFrame:
    """Occurrences grouped by node (or by folded base name where unresolved) and configuration."""
    from lathe.functions import paths

    rows = occurrences.filter("depth > 0")
    name = F.when(F.col("node_id").isNull(), paths.fold(paths.basename(F.col("stored_path"))))
    one = F.count_distinct(F.coalesce(F.col("is_virtual").cast("string"), F.lit("null"))) == 1
    aggs = [
        F.count_if("counted").alias("quantity"),
        F.count_if(~F.col("counted") & F.col("under_suppressed")).alias("suppressed_quantity"),
        F.count_if(~F.col("counted") & ~F.col("under_suppressed")).alias("excluded_quantity"),
        F.min("depth").alias("minimum_depth"),
        F.when(one, F.first("is_virtual", ignorenulls=True)).alias("is_virtual"),
        F.first("document_kind", ignorenulls=True).alias("document_kind"),
        F.first("document_path", ignorenulls=True).alias("document_path"),
    ]
    if ids:
        # One list for each item: fit for what one reads, not for items that occur by the billion.
        aggs.append(F.array_sort(F.collect_list("id")).alias("occurrence_ids"))
    return rows.groupBy("node_id", name.alias("unresolved_name"), F.col("referenced_configuration").alias("configuration")).agg(*aggs)


def item_occurrences(occurrences: DataFrame) -> DataFrame:
    """(item columns, id): the places of each item as rows, for any number of them."""
    from lathe.functions import paths

    name = F.when(F.col("node_id").isNull(), paths.fold(paths.basename(F.col("stored_path"))))
    return occurrences.filter("depth > 0").select("node_id", name.alias("unresolved_name"), F.col("referenced_configuration").alias("configuration"), "id")


def ordered(items_rows: DataFrame) -> DataFrame:
    """Items by document path, unresolved name and configuration, nulls first."""
    return items_rows.orderBy(*(F.asc_nulls_first(c) for c in ("document_path", "unresolved_name", "configuration")))


def summary(occurrences: DataFrame) -> DataFrame:
    """Counts of occurrences by their state."""
    rows = occurrences.filter("depth > 0")
    return rows.groupBy("children_state").agg(F.count("*").alias("occurrences"), F.count_if("counted").alias("counted"), F.max("depth").alias("maximum_depth"))


def children(occurrences: DataFrame, parent: str) -> DataFrame:
    return occurrences.filter(F.col("parent_id") == parent)


def first_edge_order(edges: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Edges with their ordinal among the edges of one (source, configuration)."""
    return edges.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
