"""Reference resolution: an ordered cascade of key lookups.

Each step gives a reference and a file keys. Files are first reduced to one row
for each (step, key): how many files have it, and the first label. A reference
then meets at most one narrow row for each of its keys, so a base name that a
third of all files share costs one row, not a pair with each. The lowest step
with a hit decides: one file is resolved, several are ambiguous, and the search
ends there. Lists of labels join last, and only to ambiguous references.

All folders of one rule (several search folders, say) are keys of one step, so
hits in two folders are ambiguous. Keys of one step never name the same file
twice: a file has one host path, and one base-name key for each rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.functions import paths

#: Steps in order of precedence; a step's number is its place from 0.
BASES = (
    "embedded_virtual_component", "document_relative", "project_root_relative", "host_absolute", "windows_prefix_mapping", "search_directory_relative",
    "document_directory_basename", "project_root_basename", "search_directory_basename",
)

#: Parts in which the first labels of one key are ranked, so that no task sorts all files of a common name.
LABEL_SALTS = 64


def _keyed(rows: DataFrame, keys: dict[int, Column], *kept: Column) -> DataFrame:
    """(kept, step, key): one row for each key that isn't null. A step may give a key or an array of keys."""
    types = rows.select(*(k.alias(str(s)) for s, k in keys.items())).schema

    def entry(step: int, key: Column) -> Column:
        several = key if types[str(step)].dataType.typeName() == "array" else F.array(key)
        return F.transform(F.coalesce(F.array_distinct(several), F.array().cast("array<string>")), lambda x: F.struct(F.lit(step).alias("step"), x.alias("key")))

    entries = F.concat(*(entry(step, key) for step, key in keys.items()))
    wanted = rows.select(*kept, F.explode(F.filter(entries, lambda e: e["key"].isNotNull())).alias("e"))
    return wanted.select(*(c for c in wanted.columns if c != "e"), "e.step", "e.key")


def keyed_files(files: DataFrame, keys: dict[int, Column], label: str = "label") -> DataFrame:
    """(step, key, label): files by key, each once."""
    return _keyed(files, keys, F.col(label).alias("label")).distinct()


def first_labels(by_key: DataFrame, most: int) -> DataFrame:
    """(step, key, labels): the first ``most`` labels of each key in order, found in parts and then among the parts' winners."""
    salted = by_key.withColumn("salt", F.pmod(F.xxhash64("label"), F.lit(LABEL_SALTS)))
    for keys in (["step", "key", "salt"], ["step", "key"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("label"))
        salted = salted.withColumn("place", place).filter(F.col("place") <= most).drop("place")
    return salted.groupBy("step", "key").agg(F.array_sort(F.collect_list("label")).alias("labels"))


def _shuffled(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that is never broadcast: several keys for each row of a compressed file are many times what the planner takes their size for."""
    return left.join(right.hint("merge"), on, how)


def cascade(references: DataFrame, id_col: str, keys: dict[int, Column], by_key: DataFrame, blank: Column, most: int = 1024) -> DataFrame:
    """id, status, step, candidate_count, candidates (the first ``most``), resolved for each reference.

    A null key matches nothing; a blank reference (``blank`` true or null) is ``no_stored_path``.
    """
    is_blank = F.coalesce(blank, F.lit(True))
    every = references.select(F.col(id_col).alias("id"), is_blank.alias("blank"))
    asked = _keyed(references.filter(~is_blank), keys, F.col(id_col).alias("id"))
    counts = by_key.groupBy("step", "key").agg(F.count("*").alias("found"), F.min("label").alias("first"))
    hits = _shuffled(asked, counts, ["step", "key"])
    steps = sorted(keys)
    sums = hits.groupBy("id").agg(F.min(F.struct("step", "first")).alias("best"), *(F.sum(F.when(F.col("step") == s, F.col("found"))).alias(f"found_{s}") for s in steps))
    decided = sums.select("id", F.col("best.step").alias("step"), F.col("best.first").alias("first"), F.coalesce(*(f"found_{s}" for s in steps)).alias("found"))
    # Lists travel only to references with several candidates.
    unsure = _shuffled(asked, decided.filter("found > 1").select("id", "step"), ["id", "step"])
    named = unsure.select("step", "key").distinct()
    firsts = first_labels(_shuffled(by_key, named, ["step", "key"], "left_semi"), most)
    lists = _shuffled(unsure, firsts, ["step", "key"]).groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("labels"))), 1, most).alias("labels"))
    out = _shuffled(_shuffled(every, decided, "id", "left"), lists, "id", "left")
    status = F.when(F.col("blank"), "no_stored_path").when(F.col("found").isNull(), "missing").when(F.col("found") == 1, "resolved").otherwise("ambiguous")
    return out.select(
        F.col("id").alias(id_col), status.alias("status"), "step", F.coalesce("found", F.lit(0)).alias("candidate_count"),
        F.coalesce(F.when(F.col("found") == 1, F.array("first")), F.col("labels"), F.array().cast("array<string>")).alias("candidates"), F.when(F.col("found") == 1, F.col("first")).alias("resolved"),
    )


def basis(step: Column) -> Column:
    """Name of a step; null for none."""
    return F.when(step.isNotNull(), F.get(F.array(*map(F.lit, BASES)), step))


def path_steps(stored: Column, document: Column, roots: list[str], searches: list[str], mappings: list[tuple[str, str]], is_virtual: Column | None = None, holder: Column | None = None) -> tuple[dict[int, Column], dict[int, Column]]:
    """Keys of references and keys of files of the whole cascade, steps numbered as in ``BASES``.

    Files have host_path and label; for a document inside another, host_path is
    null, ``container`` names the outer one and ``embedded_name`` is its name there
    (both null otherwise). ``document`` is the host path of the document that holds
    the reference (of the outermost one for an embedded document), ``holder`` its
    name as in ``container`` (by default its host path). ``roots``, ``searches`` and ``mappings`` (prefix,
    target folder) are configuration: a few folders.
    """
    text = F.trim(stored)
    windows, host = paths.is_windows_absolute(stored), paths.is_host_absolute(stored)
    relative = ~(windows | host)
    mine = paths.fold(paths.source_basename(text))
    home = paths.folder(paths.host(document))
    below = lambda base: paths.host_key(paths.join(base, text))
    none = F.lit(None).cast("string")
    several = lambda folders, key: F.array(*(key(F.lit(x)) for x in folders)) if folders else F.array(none)
    plain = paths.normalize(text)
    fits = []
    for prefix, target in mappings:
        start = paths.normalized(prefix)
        if start:
            rest = F.substr(plain, F.lit(len(start) + 1))
            hit = windows & paths.has_prefix(paths.fold(plain), F.lit(start.lower()))
            fits.append(F.when(hit, F.struct(F.lit(len(start)).alias("length"), paths.host_key(paths.join(F.lit(target), rest)).alias("key"))))
    longest = F.lit(None).cast("array<string>")
    if fits:
        met = F.array_compact(F.array(*fits))
        longest = F.transform(F.filter(met, lambda m: m["length"] == F.array_max(F.transform(met, lambda x: x["length"]))), lambda m: m["key"])
    stem = F.regexp_replace(paths.source_basename(text), r"\.[^.]*$", "")
    inner = lambda name: paths.fold(F.concat(F.col("container"), F.lit("|"), name))
    ref = {
        1: F.when(relative, below(home)),
        2: F.when(relative, several(roots, below)),
        3: F.when(host, paths.host_key(stored)),
        4: longest,
        5: several(searches, below),
        6: F.when(mine.isNotNull(), paths.host_key(F.concat(home, F.lit("/"), mine))),
        7: mine,
        8: mine,
    }
    own = paths.host_key(F.col("host_path"))
    name = paths.fold(paths.source_basename(F.col("host_path")))
    inside = lambda folders: F.exists(F.array(*(F.lit(f"{paths.host_text(x)}/") for x in folders)), lambda f: own.startswith(f)) if folders else F.lit(False)
    files = {step: own for step in range(1, 7)} | {7: F.when(inside(roots), name), 8: F.when(inside(searches), name)}
    if is_virtual is not None:
        names = F.array(stem, F.element_at(F.split(stem, r"\^"), 1))
        ref = {0: F.when(is_virtual, F.transform(names, lambda n: paths.fold(F.concat(document if holder is None else holder, F.lit("|"), n))))} | ref
        files = {0: F.when(F.col("container").isNotNull(), inner(F.col("embedded_name")))} | files
    return ref, files


def longest_prefix(references: DataFrame, path: str, mappings: DataFrame) -> DataFrame:
    """Each reference with its longest matching prefix (columns prefix, target of ``mappings``, a small configuration table); ties all stay.

    Every component border of a path is a possible prefix, so this is an
    equi-join on folded prefixes and needs no comparison of each pair.
    """
    table = mappings.withColumn("try", paths.fold(paths.normalize(F.col("prefix"))))
    # Each distinct path is matched once, however many references share it, and only its text travels.
    known = references.select(F.col(path).alias("whole")).distinct().withColumn("p", paths.parts(F.col("whole")))
    rows = known.filter(F.size("p") > 0).select("whole", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: paths.fold(F.array_join(F.slice("p", 1, n), "/")))).alias("try"))
    best = rows.join(table.select("try").distinct(), "try").groupBy("whole").agg(F.max_by("try", F.length("try")).alias("try"))
    return references.join(best, F.col(path) == F.col("whole")).join(table, "try").drop("whole", "try")


def mismatched_kinds(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose expected kind differs from their target's; unknown kinds never differ."""
    target = nodes.select(F.col("id").alias("target_node_id"), F.col("document_kind").alias("actual"))
    return edges.join(target, "target_node_id").filter(F.col("expected_document_kind") != F.col("actual"))


def edges_to(edges: DataFrame, target: Column, node) -> DataFrame:
    """Edges whose target is the node; the predicate reaches the scan."""
    return edges.filter(target == node)


def referencing(edges: DataFrame, nodes: DataFrame, target: Column, kind: str | None = None) -> DataFrame:
    """Nodes with an edge to the target, once each, in order of their first edge."""
    chosen = edges.filter(target if kind is None else target & (F.col("kind") == kind))
    first = chosen.groupBy("source_node_id").agg(F.min("id").alias("first_edge"))
    return nodes.join(first, nodes["id"] == first["source_node_id"]).drop("source_node_id")


def closure(expected: DataFrame, actual: DataFrame, column: str) -> DataFrame:
    """Folded names that only one side has, and names of one side that fold together."""
    sides = []
    for side, df in (("expected", expected), ("actual", actual)):
        named = df.select(F.col(column).alias("name"), F.lower(column).alias("folded"))
        sides.append((side, named))
    (_, e), (_, a) = sides
    missing = e.join(a, "folded", "left_anti").select("folded", F.lit("missing").alias("fault"))
    extra = a.join(e, "folded", "left_anti").select("folded", F.lit("unexpected").alias("fault"))
    clash = [n.groupBy("folded").agg(F.count_distinct("name").alias("n")).filter("n > 1").select("folded", F.lit(f"collision_{s}").alias("fault")) for s, n in sides]
    return missing.distinct().unionByName(extra.distinct()).unionByName(clash[0]).unionByName(clash[1])


def status_report(nodes: DataFrame, edges: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(category, value, n): nodes by kind and parse status, edges by resolution and traversal, diagnostic codes; nulls are not counted."""
    pick = lambda df, column, category: df.select(F.lit(category).alias("category"), F.col(column).alias("value"))
    rows = pick(nodes, "document_kind", "document_kind").unionByName(pick(nodes, "parse_status", "parse_status"))
    rows = rows.unionByName(pick(edges, "resolution_status", "resolution")).unionByName(pick(edges, "traversal_status", "traversal")).unionByName(pick(diagnostics, "code", "diagnostic"))
    return rows.filter(F.col("value").isNotNull()).groupBy("category", "value").agg(F.count("*").alias("n"))
