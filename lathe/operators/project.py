"""Project scan: from parsed documents to a graph of nodes and labelled edges.

Documents are parsed as one set; every stored reference of every document is
resolved by one cascade of joins; only the traversal labels, which depend on
depth-first order, are given project by project. Unlike a reader that opens a
file when the walk meets it, all files below the roots are parsed at once, which
is what a cluster does best; files that the walk doesn't reach are left out of
the graph afterwards.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.functions import paths
from lathe.sources.files import SUFFIXES
from lathe.sources.limits import SERVICE, Limits

from . import graph, resolve
from .numbering import cut, number, running


#: What a scan needs of parsed documents.
FACTS = ("stored_references", "configurations", "document_kinds", "parse_status")

#: Columns of a document's stored references (``streams.WHOLE``) that neither resolution nor labels nor the report ask for.
NOT_ASKED = ("source_name", "hidden", "excluded", "instance_number")


@dataclass(frozen=True)
class ProjectOptions:
    """Folders are host paths; mappings are (stored prefix, target folder)."""

    project_root: str
    search_directories: tuple[str, ...] = ()
    windows_prefix_mappings: tuple[tuple[str, str], ...] = ()
    follow_suppressed: bool = False
    configuration: str | None = None


@dataclass
class Graph:
    """status (complete, partial or rejected), nodes, edges, diagnostics and report, each made when it is first asked for.

    ``links`` are the edges with what the report asks of them, computed anew at each use;
    ``edges`` are kept. ``met`` gives the nodes.
    """

    links: DataFrame
    met: Callable[[], DataFrame]
    limits: Limits
    rejected: bool
    too_many: bool
    roots: list[str] = field(default_factory=list)

    @cached_property
    def _edges(self) -> DataFrame:
        return cut(self.links)

    @cached_property
    def edges(self) -> DataFrame:
        return self._edges.drop(*_OF_REPORT)

    @cached_property
    def nodes(self) -> DataFrame:
        return cut(self.met())

    @cached_property
    def _found(self) -> DataFrame:
        return cut(_diagnostics(self.nodes, self._edges, self.limits))

    @cached_property
    def diagnostics(self) -> DataFrame:
        if not self.too_many:
            return self._found
        return self._found.unionByName(self._found.sparkSession.createDataFrame([("limit.project_files", "error", None, f"limit {self.limits.files}")], self._found.schema))

    @cached_property
    def status(self) -> str:
        if self.too_many or self.rejected or not self._found.filter("severity = 'error'").isEmpty():
            return "rejected"
        return "complete" if self._found.filter("code NOT IN ('project.reference_cycle', 'limit.reference_candidates')").isEmpty() else "partial"

    @cached_property
    def report(self) -> DataFrame:
        """(category, value, n) as ``resolve.status_report`` counts them, from one pass over edges and nodes."""
        return cut(_report(self.met(), self.links, self.limits, self.too_many))

    def edges_to(self, node: str) -> DataFrame:
        return resolve.edges_to(self.edges, F.col("target_node_id"), node)

    def node_by_path(self, path: str) -> DataFrame:
        """The node of that label; no row if there is none."""
        return self.nodes.filter(F.col("path") == path).orderBy("id").limit(1)

    def ordered(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges by id."""
        return self.nodes.orderBy("id"), self.edges.orderBy("id")

    def referencing(self, node: str, kind: str | None = None) -> DataFrame:
        return resolve.referencing(self.edges, self.nodes, F.col("target_node_id") == node, kind)


def folders(options: ProjectOptions) -> list[tuple[str, str]]:
    """(folded folder, label prefix) of each root, the project's first; a folder that is given twice is one root."""
    out = {paths.host_text(options.project_root): ""}
    named = [(target, f"@mapping/{i}/") for i, (prefix, target) in enumerate(options.windows_prefix_mappings) if paths.normalized(prefix)]
    named += [(folder, f"@search/{i}/") for i, folder in enumerate(options.search_directories)]
    for folder, prefix in named:
        out.setdefault(paths.host_text(folder), prefix)
    return list(out.items())


def labelled(documents: DataFrame, options: ProjectOptions) -> DataFrame:
    """host_path, label, container, embedded_name and doc_id of each document file below a root.

    documents: path, and container and embedded_name for documents inside others.
    A label is the path below the first root that holds the file.
    """
    own = F.col("_own")
    below = lambda folder: F.col("_folded").startswith(f"{folder}/") if folder else F.lit(True)
    inside = [F.when(below(folder), F.concat(F.lit(prefix), F.substr(own, F.lit(len(folder) + 2 if folder else 1)))) for folder, prefix in folders(options)]
    inner = F.col("container").isNotNull()
    rest = F.regexp_extract("path", "(#.*)$", 1)
    # Both are computed once, however many roots there are.
    named = documents.withColumn("_own", paths.lexical(paths.host(F.regexp_extract("path", "^([^#]*)", 1)))).withColumn("_folded", paths.fold(own))
    rows = named.withColumn("label", F.concat(F.coalesce(*inside), rest)).filter("label IS NOT NULL").filter(inner | paths.has_suffix(F.col("path"), SUFFIXES))
    return rows.select(F.when(~inner, F.col("path")).alias("host_path"), "label", "container", "embedded_name", F.col("path").alias("doc_id"))


def stored_references(facts) -> DataFrame:
    """All references of all documents in the order in which a walk meets them (``reference_id`` from 1 for each document, ``place`` from 0 among those of one configuration)."""
    parts = [
        facts["components"].select(
            "doc_id", F.lit("assembly_component").alias("kind"), "configuration_index", F.lit(2).alias("rank"), F.lit(None).cast("int").alias("sheet"), "ordinal", F.col("instance_name").alias("source_name"), "stored_path", "document_kind",
            "referenced_configuration", "is_suppressed", "is_hidden", "exclude_from_bom", "is_virtual", "instance_number",
        ),
        facts["external_references"].select("doc_id", "kind", F.lit(0).alias("rank"), "ordinal", "stored_path", "document_kind"),
        facts["view_references"].select("doc_id", "kind", F.lit(1).alias("rank"), "sheet", "ordinal", "source_name", "stored_path", F.col("configuration").alias("referenced_configuration")),
    ]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    order = Window.partitionBy("doc_id").orderBy("rank", "configuration_index", "sheet", "ordinal", "stored_path")
    numbered = every.withColumn("reference_id", F.row_number().over(order).cast("long")).drop("rank", "sheet", "ordinal")
    return numbered.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "configuration_index").orderBy("reference_id")).cast("long") - 1)


def _requested(references: DataFrame, configurations: DataFrame) -> DataFrame:
    """``requested``: indices of the target's configurations that a walk enters; null for all, empty where the name fits none or several."""
    names = F.array_compact(F.concat(F.array("name"), F.coalesce("alternate_names", F.array().cast("array<string>"))))
    known = configurations.select(F.col("doc_id").alias("target"), "configuration_index", F.explode(F.array_distinct(names)).alias("referenced_configuration"))
    by_name = known.groupBy("target", "referenced_configuration").agg(F.sort_array(F.collect_set("configuration_index")).alias("fits"))
    none = F.array().cast("array<long>")
    met = references.join(by_name, ["target", "referenced_configuration"], "left")
    return met.withColumn("requested", F.when(F.col("referenced_configuration").isNotNull(), F.when(F.size("fits") == 1, F.col("fits").cast("array<long>")).otherwise(none))).withColumn("named", F.coalesce(F.size("fits"), F.lit(0))).drop("fits")


def _question(references: DataFrame) -> dict[str, Column]:
    """What decides: the folder of the outermost document as it is written, for virtual components the document, and the stored path."""
    own = {"_home": paths.above(F.substring_index("doc_id", "#", 1)), "_holder": F.when(F.col("is_virtual"), F.col("doc_id")), "_stored": F.col("stored_path")}
    return {name: F.coalesce(value, F.lit("")) for name, value in own.items()}


def _answers(questions: DataFrame, files: DataFrame, options: ProjectOptions, limits: Limits) -> DataFrame:
    """The columns of ``_question`` of each distinct question with its resolution."""
    own = ["_home", "_holder", "_stored"]
    keys, file_keys = resolve.path_steps(
        F.col("_stored"), F.concat("_home", F.lit("_")), [options.project_root], list(options.search_directories), list(options.windows_prefix_mappings), F.col("_holder") != "", F.col("_holder")
    )
    ref = F.concat_ws("\x1f", F.length("_home").cast("string"), F.length("_holder").cast("string"), *own)
    # Keys are computed once: the cascade reads them several times.
    asked = cut(questions.select(*own).distinct().withColumns({"ref": ref} | {f"_key{step}": key for step, key in keys.items()}))
    keys = {step: F.col(f"_key{step}") for step in keys}
    found = resolve.cascade(asked, "ref", keys, resolve.keyed_files(files, file_keys), F.trim("_stored") == "", limits.candidates)
    named = found.select("ref", F.col("status").alias("resolution_status"), resolve.basis(F.col("step")).alias("resolution_basis"), "candidate_count", F.col("candidates").alias("candidate_paths"), F.col("resolved").alias("resolved_path"))
    targets = files.select(F.col("label").alias("resolved_path"), F.col("doc_id").alias("target"))
    return asked.select("ref", *own).join(named.hint("merge"), "ref").join(targets.hint("merge"), "resolved_path", "left").drop("ref")


def resolved(files: DataFrame, references: DataFrame, options: ProjectOptions, limits: Limits = SERVICE) -> DataFrame:
    """References with resolution_status, resolution_basis, candidate_count, candidate_paths and target (a doc_id). Each question is asked once."""
    own = _question(references)
    keyed = cut(references.withColumns(own))
    return keyed.join(_answers(keyed, files, options, limits).hint("merge"), [*own]).drop(*own)


def _diagnostic(rows: DataFrame, code: Column | str, severity: str, source: str, *detail: Column) -> DataFrame:
    return rows.select((F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(severity).alias("severity"), F.col(source).alias("doc_id"), F.concat_ws("; ", *detail).alias("detail"))


def scan(facts, documents: DataFrame, options: ProjectOptions, roots: list[str] | None = None, limits: Limits = SERVICE, kept: bool = False) -> Graph:
    """The graph of one project.

    facts: the parsed tables of ``documents`` (``engine.parse`` with embedded
    documents). roots: doc_ids of the root documents; None for every file, in
    order of their labels. The graph is ``rejected`` if there are more files or
    edges than the limits allow, or a root cannot be read. kept: the stored
    references are on disk, reading them again costs little.
    """
    spark = documents.sparkSession
    asked = 1 + len(options.search_directories) + len(options.windows_prefix_mappings)
    if asked > limits.roots:
        raise ValueError(f"{asked} root folders, at most {limits.roots}")
    files = cut(labelled(documents, options))
    held = files.filter("host_path IS NOT NULL")
    too_many = held.count() > limits.files
    stored = facts["stored_references"] if kept else cut(facts["stored_references"])
    # Equal questions, here with the configuration that is asked for, are answered once; what the answers need of their targets joins there, too.
    own = _question(stored)
    keyed = stored.withColumns(own | {"_named": F.coalesce(F.concat(F.lit("="), "referenced_configuration"), F.lit(""))})
    questions = cut(keyed.select(*own, "_named", "referenced_configuration").distinct())
    if roots is None:
        placed = number(held.select("doc_id", "label"), ["label"], "root_order").filter(F.col("root_order") < limits.files)
        starts = placed.select(F.lit("project").alias("project"), F.col("doc_id").alias("node"), "root_order")
    else:
        starts = spark.createDataFrame([("project", r, i) for i, r in enumerate(roots)], "project string, node string, root_order long")
    first = starts.groupBy("node").agg(F.min("root_order").alias("root_order"))
    about = first.select(F.col("node").alias("target"), F.col("root_order").alias("target_order")).join(facts["document_kinds"].select(F.col("doc_id").alias("target"), F.col("document_kind").alias("actual")).hint("merge"), "target", "full")
    leading = stored.select(F.col("doc_id").alias("target"), F.lit(True).alias("leads")).distinct()
    answers = _requested(questions.join(_answers(questions, files, options, limits).hint("merge"), [*own]), facts["configurations"])
    answers = cut(answers.join(about.hint("merge"), "target", "left").join(leading.hint("merge"), "target", "left").drop("referenced_configuration"))
    references = keyed.join(answers.hint("shuffle_hash"), [*own, "_named"]).drop(*own, "_named")
    if answers.filter("leads").isEmpty() and options.configuration is None:
        links, rejected = _flat(stored, references, answers, first, files, options, limits)
        every = roots is None and not too_many and files.filter("host_path IS NULL").isEmpty()
        walked = None if every else links.select("target", "depth")
    else:
        links, rejected, walked = _walked(references.drop("leads", "target_order", "place"), starts, facts["configurations"], files, roots, options, limits)
    return Graph(links, lambda: _nodes(facts, files, starts, walked), limits, rejected, too_many, list(roots or []))


#: What the report asks of edges besides their own columns.
_OF_REPORT = ("named", "actual", "target", "rejected")


def _edges(met: DataFrame, edge_id: Column, ordinal: Column) -> DataFrame:
    return met.select(
        edge_id.alias("id"), "source_node_id", "target_node_id", "reference_id", ordinal.alias("ordinal"), "kind", F.col("configuration_index").cast("long").alias("source_configuration_index"), "source_name", "stored_path", "referenced_configuration",
        F.col("document_kind").alias("expected_document_kind"), "is_suppressed", "is_hidden", "exclude_from_bom", "is_virtual", "instance_number", "resolution_status", "resolution_basis", "candidate_count", "candidate_paths",
        "resolved_path", "traversal_status", "depth", *_OF_REPORT,
    )


def _walked(references: DataFrame, starts: DataFrame, configurations: DataFrame, files: DataFrame, roots: list[str] | None, options: ProjectOptions, limits: Limits) -> tuple[DataFrame, bool, DataFrame]:
    """Edges as a walk meets them, whether there are too many, and the walk."""
    references = cut(references)
    if options.configuration is not None and roots is not None:
        references = _entered(references, configurations, roots, options.configuration)
    links = references.select(F.lit("project").alias("project"), F.col("doc_id").alias("source"), "reference_id", F.col("configuration_index").cast("long").alias("configuration"), "target", "requested", F.coalesce("is_suppressed", F.lit(False)).alias("is_suppressed"))
    walked = cut(graph.label(links, starts, options.follow_suppressed, limits.reference_depth, limits.edges))
    label_of = files.select("doc_id", "label")
    met = walked.filter("edge_id IS NOT NULL").join(references.withColumnRenamed("doc_id", "source").drop("target", "requested").hint("merge"), ["source", "reference_id"])
    met = met.join(label_of.select(F.col("doc_id").alias("source"), F.col("label").alias("source_node_id")), "source").join(label_of.select(F.col("doc_id").alias("target"), F.col("label").alias("target_node_id")), "target", "left")
    place = F.row_number().over(Window.partitionBy("source", "configuration_index").orderBy("edge_id")) - 1
    return cut(_edges(met, F.col("edge_id"), place)), not walked.filter("rejected").isEmpty(), walked


def _flat(stored: DataFrame, references: DataFrame, answers: DataFrame, first: DataFrame, files: DataFrame, options: ProjectOptions, limits: Limits) -> tuple[DataFrame, bool]:
    """Edges, and whether there are too many, of a project in which no document that is referred to has references.

    A walk then goes from root to root and from a root's configuration to the next;
    the place of an edge is its place there and the number of edges before.
    """
    source = F.col("doc_id").alias("node")
    blocks = stored.groupBy(source, F.col("configuration_index").alias("block")).agg(F.count("*").alias("n")).join(first, "node").join(files.select(source, F.col("label").alias("source_node_id")), "node")
    blocks = cut(running(blocks, [F.col("root_order"), F.asc_nulls_first("block")], "n", "base"))
    about = blocks.agg(F.sum("n"), F.min("root_order")).first()
    rejected = (about[0] or 0) > limits.edges
    met = references.join(blocks.drop("n").hint("shuffle_hash"), (F.col("doc_id") == F.col("node")) & F.col("configuration_index").eqNullSafe(F.col("block"))).withColumn("at", F.col("base") + F.col("place")).drop("node", "block", "base")
    suppressed = F.lit(False) if options.follow_suppressed else F.coalesce("is_suppressed", F.lit(False))
    fixed = F.when(F.col("target").isNull(), "unresolved").when(suppressed, "suppressed").when(F.lit(limits.reference_depth <= 0), "depth_limited")
    latest = answers.filter("target IS NOT NULL").agg(F.max(F.coalesce("target_order", F.lit((1 << 63) - 1)))).first()[0]
    if latest is None or about[1] is None or latest < about[1]:
        # Each target is a root before all roots with references.
        met = met.withColumn("traversal_status", F.coalesce(fixed, F.lit("reused")))
    else:
        met = cut(met.withColumn("fixed", fixed))
        loads = met.filter("fixed IS NULL").select("target", "root_order", "at").unionByName(first.select(F.col("node").alias("target"), "root_order", F.lit(-1).cast("long").alias("at")))
        loaded = loads.groupBy("target").agg(F.min(F.struct("root_order", "at")).alias("load"))
        label = F.when(F.col("load.at") == F.col("at"), "followed").otherwise("reused")
        met = met.join(loaded.hint("merge"), "target", "left").withColumn("traversal_status", F.coalesce("fixed", label)).drop("fixed", "load")
    if rejected:
        met = met.filter(F.col("at") < limits.edges)
    shown = met.withColumns({"target_node_id": F.when(F.col("target").isNotNull(), F.col("resolved_path")), "depth": F.lit(0), "rejected": F.lit(rejected)})
    return _edges(shown, graph.edge_id(F.col("at")), F.col("place").cast("int")), rejected


def _entered(references: DataFrame, configurations: DataFrame, roots: list[str], name: str) -> DataFrame:
    """References of root documents only for the one configuration that is asked for."""
    names = F.array_compact(F.concat(F.array("name"), F.coalesce("alternate_names", F.array().cast("array<string>"))))
    fits = configurations.filter(F.col("doc_id").isin(*roots) & F.array_contains(names, name)).groupBy("doc_id").agg(F.collect_set("configuration_index").alias("own")).filter(F.size("own") == 1)
    met = references.join(fits, "doc_id", "left")
    is_root = F.col("doc_id").isin(*roots)
    return met.filter(~is_root | F.col("configuration_index").isNull() | F.coalesce(F.array_contains("own", F.col("configuration_index")), F.lit(False))).drop("own")


def _nodes(facts, files: DataFrame, starts: DataFrame, walked: DataFrame | None) -> DataFrame:
    """Documents that the walk met: id (label), path, minimum_depth, is_root, document_kind, parse_status, configurations. walked: target and depth of edges; none if every file is a root."""
    visits = starts.select(F.col("node"), F.lit(0).alias("depth"), F.lit(True).alias("is_root"))
    if walked is not None:
        visits = visits.unionByName(walked.filter("target IS NOT NULL").select(F.col("target").alias("node"), (F.col("depth") + 1).alias("depth"), F.lit(False).alias("is_root")))
    met = graph.least_depth(visits)
    configurations = facts["configurations"].groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("configuration_index").cast("long").alias("index"), "name"))).alias("configurations"))
    kinds = facts["document_kinds"].select("doc_id", "document_kind")
    status = facts["parse_status"]
    rows = met.withColumnRenamed("node", "doc_id").join(files.select("doc_id", "label", "host_path"), "doc_id")
    rows = rows.join(configurations, "doc_id", "left").join(kinds, "doc_id", "left").join(status, "doc_id", "left")
    none = F.array().cast("array<struct<index:bigint,name:string>>")
    return rows.select(
        F.col("label").alias("id"), F.col("label").alias("path"), "doc_id", F.col("minimum_depth"), "is_root", "document_kind", F.coalesce("parse_status", F.lit("unsupported")).alias("parse_status"), F.coalesce("configurations", none).alias("configurations")
    )


def _by_status(status: Column) -> Column:
    """Code of an edge that isn't resolved."""
    return F.create_map(*map(F.lit, ("missing", "project.reference_missing", "ambiguous", "project.reference_ambiguous", "no_stored_path", "project.reference_path_missing")))[status]


def _diagnostics(nodes: DataFrame, edges: DataFrame, limits: Limits) -> DataFrame:
    open_edges = edges.filter("resolution_status <> 'resolved'")
    kinds = resolve.mismatched_kinds(edges.drop("actual"), nodes)
    followed = edges.filter("traversal_status IN ('followed', 'reused') AND referenced_configuration IS NOT NULL AND named <> 1")
    unread = nodes.filter("parse_status NOT IN ('parsed', 'partial')")
    stored = F.concat(F.lit("stored_path="), F.coalesce("stored_path", F.lit("")))
    target = F.concat(F.lit("target="), F.col("target_node_id"))
    parts = [
        _diagnostic(open_edges, _by_status(F.col("resolution_status")), "warning", "source_node_id", stored, F.concat(F.lit("candidates="), F.col("candidate_count").cast("string"))),
        _diagnostic(open_edges.filter("is_virtual"), "project.virtual_component_unresolved", "warning", "source_node_id", stored),
        _diagnostic(edges.filter(F.col("candidate_count") > limits.candidates), "limit.reference_candidates", "warning", "source_node_id", stored),
        _diagnostic(edges.filter("traversal_status = 'cycle'"), "project.reference_cycle", "warning", "source_node_id", target),
        _diagnostic(edges.filter("traversal_status = 'depth_limited'"), "limit.reference_depth", "warning", "source_node_id", target),
        _diagnostic(kinds, "project.reference_document_kind_mismatch", "warning", "source_node_id", F.concat(F.lit("expected="), F.col("expected_document_kind")), F.concat(F.lit("actual="), F.col("actual"))),
        _diagnostic(followed, F.when(F.col("named") == 0, "project.configuration_missing").otherwise("project.configuration_ambiguous"), "warning", "target_node_id", F.concat(F.lit("requested="), F.col("referenced_configuration"))),
        _diagnostic(unread.filter("NOT is_root"), "project.node_parse_incomplete", "warning", "id", F.concat(F.lit("parse_status="), F.col("parse_status"))),
        _diagnostic(unread.filter("is_root"), "project.root_parse_unavailable", "error", "id", F.concat(F.lit("parse_status="), F.col("parse_status"))),
        _diagnostic(edges.filter("rejected").limit(1), "limit.project_edges", "error", "source_node_id", F.lit(f"limit={limits.edges}")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _report(nodes: DataFrame, edges: DataFrame, limits: Limits, too_many: bool) -> DataFrame:
    """(category, value, n) of nodes, edges and the codes that ``_diagnostics`` gives; rows are counted by their values first."""
    entry = lambda category, value: F.struct(F.lit(category).alias("category"), value.alias("value"))
    code = lambda found, name: entry("diagnostic", F.when(found, name if isinstance(name, Column) else F.lit(name)))
    status, label, asked = F.col("resolution_status"), F.col("traversal_status"), F.col("referenced_configuration").isNotNull()
    flags = {
        "virtual": (status != "resolved") & F.col("is_virtual"), "many": F.col("candidate_count") > limits.candidates, "differs": F.col("expected_document_kind") != F.col("actual"),
        "odd": F.when(label.isin("followed", "reused") & asked & (F.col("named") != 1), F.when(F.col("named") == 0, "project.configuration_missing").otherwise("project.configuration_ambiguous")),
    }
    links = edges.groupBy(status, label, "rejected", *(value.alias(name) for name, value in flags.items())).agg(F.count("*").alias("n"))
    of_edge = [
        entry("resolution", status), entry("traversal", label), code(status != "resolved", _by_status(status)), code(F.col("virtual"), "project.virtual_component_unresolved"), code(F.col("many"), "limit.reference_candidates"),
        code(label == "cycle", "project.reference_cycle"), code(label == "depth_limited", "limit.reference_depth"), code(F.col("differs"), "project.reference_document_kind_mismatch"), entry("diagnostic", F.col("odd")),
    ]
    unread = ~F.col("parse_status").isin("parsed", "partial")
    documents = nodes.groupBy("document_kind", "parse_status", "is_root").agg(F.count("*").alias("n"))
    of_node = [entry("document_kind", F.col("document_kind")), entry("parse_status", F.col("parse_status")), code(unread & ~F.col("is_root"), "project.node_parse_incomplete"), code(unread & F.col("is_root"), "project.root_parse_unavailable")]
    parts = [counts.select(F.explode(F.array(*entries)).alias("e"), "n").select("e.*", "n") for counts, entries in ((links, of_edge), (documents, of_node))]
    once = lambda name: (F.lit("diagnostic").alias("category"), F.lit(name).alias("value"), F.lit(1).cast("long").alias("n"))
    parts.append(edges.filter("rejected").limit(1).select(*once("limit.project_edges")))
    if too_many:
        parts.append(edges.sparkSession.range(1).select(*once("limit.project_files")))
    return reduce(DataFrame.unionByName, parts).filter("value IS NOT NULL").groupBy("category", "value").agg(F.sum("n").alias("n"))


def host_folders(options: ProjectOptions) -> list[str]:
    """Folders to read for a project; one below another is read with it."""
    every = [options.project_root, *(t for p, t in options.windows_prefix_mappings if paths.normalized(p)), *options.search_directories]
    named = {paths.host_text(f): f for f in reversed(every)}
    return [f for key, f in named.items() if not any(key != other and (not other or key.startswith(f"{other}/")) for other in named)]
