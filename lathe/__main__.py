"""python -m lathe VERB PATH [...]: probe, inspect, extract, parse, drawing, display, evaluate, index, scan and bom as JSON lines.

Exit codes: 0 complete, 1 partial, 2 rejected, malformed or not found.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

STATUS_CODES = {"complete": 0, "partial": 1, "rejected": 2}


def _mapping(text: str) -> tuple[str, str]:
    prefix, sign, target = text.partition("=")
    if not (sign and prefix and target):
        raise argparse.ArgumentTypeError("SOURCE=TARGET is asked for")
    return prefix, target


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lathe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    verbs = parser.add_subparsers(dest="verb", required=True)
    every = {}
    for name in ("probe", "inspect", "extract", "parse", "drawing", "display", "evaluate", "index", "scan", "bom"):
        every[name] = verb = verbs.add_parser(name)
        verb.add_argument("path")
        verb.add_argument("--profile", choices=["desktop", "service"], default="service")
        verb.add_argument("--strict", action="store_true")
    every["parse"].add_argument("--table", default="properties", help="fact table")
    every["extract"].add_argument("--entry", required=True)
    every["extract"].add_argument("--output", required=True)
    every["extract"].add_argument("--force", action="store_true")
    every["evaluate"].add_argument("--feature-degrees", type=float, default=30.0, help="path holds Parquet tables vertices and triangles")
    for name in ("index", "scan", "bom"):
        every[name].add_argument("--search-dir", action="append", default=[])
        every[name].add_argument("--windows-prefix-map", action="append", default=[], type=_mapping, metavar="SOURCE=TARGET")
        every[name].add_argument("--follow-suppressed", action="store_true")
        every[name].add_argument("--summary", action="store_true", help="counts only")
    for name in ("scan", "bom"):
        every[name].add_argument("--project-root")
        every[name].add_argument("--configuration")
    for name in ("include-suppressed", "include-excluded", "occurrences"):
        every["bom"].add_argument(f"--{name}", action="store_true")
    return parser


def _graph(spark, given):
    from lathe import engine

    options = {"search_directories": given.search_dir, "windows_prefix_mappings": given.windows_prefix_map, "follow_suppressed": given.follow_suppressed}
    if given.verb == "index":
        return engine.index_project(spark, given.path, given.profile, **options)
    return engine.scan_project(spark, given.path, given.project_root, given.profile, configuration=given.configuration, **options)


def _project(spark, given) -> tuple[list, int]:
    """(tables to print, exit code)."""
    from lathe import engine

    graph = _graph(spark, given)
    code = STATUS_CODES[graph.status]
    if given.verb != "bom":
        return [graph.report] if given.summary else [graph.nodes, graph.edges, graph.diagnostics], code
    if code == 2:
        return [graph.diagnostics], code
    root = graph.nodes.filter("is_root").first()["id"]
    made = engine.bom(graph.edges, graph.nodes, root, given.configuration, include_suppressed=given.include_suppressed, include_excluded=given.include_excluded)
    chosen = "summary" if given.summary else "occurrences" if given.occurrences else "items"
    return [made[chosen]], code


def _documents(spark, given) -> tuple[list, int]:
    from lathe import engine
    from lathe.sources import files

    if given.verb == "evaluate":
        tables = [spark.read.parquet(f"{given.path}/{t}") for t in ("vertices", "triangles")]
        return [engine.evaluate_meshes(*tables, given.feature_degrees)], 0
    documents = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(given.path).select("path", "content")
    if given.verb == "extract":
        files.write_bytes(engine.extract(documents, given.entry, profile=given.profile), given.output, given.force)
        return [], 0
    if given.verb == "probe":
        rows = engine.probe(documents, given.profile)
        return [rows], 0 if rows.filter(F.col("status") != "recognized").isEmpty() else 2
    rows = {
        "inspect": lambda: engine.inventory(documents, given.profile, given.strict).drop("stored", "decoded"), "parse": lambda: engine.parse(documents, given.profile, given.strict)[given.table],
        "drawing": lambda: engine.drawing_structure(documents, given.profile), "display": lambda: engine.display_mesh(documents, profile=given.profile),
    }[given.verb]()
    return [rows], 0


def main(arguments: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from lathe import engine

    given = _parser().parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    try:
        tables, code = (_project if given.verb in ("index", "scan", "bom") else _documents)(spark, given)
    except (engine.StrictError, FileNotFoundError, LookupError, ValueError) as fault:
        print(fault, file=sys.stderr)
        return 2
    for table in tables:
        for line in table.toJSON().toLocalIterator():
            print(line)
    return 1 if code == 1 else 2 if code else 0


if __name__ == "__main__":
    sys.exit(main())
