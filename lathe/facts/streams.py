"""Rows of facts from XML streams: one small reader for each table.

``rows(streams, table)`` takes streams (doc_id, entry_id, path, decoded), lets
only those through whose path the table reads, and parses them in Arrow batches;
``tables(streams)`` gives all tables from one pass, ``read_tables(documents, only)``
some of them without the bytes of streams on disk.
Rows stay close to the source; joining, ranking and settling conflicts is done
on the tables (``facts.resolve``).
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from itertools import batched, chain
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.operators.numbering import cut
from lathe.sources import containers
from lathe.sources.limits import SERVICE, Limits

from .xmltree import Light, Node, XmlFault, light, parse

# ---- fixed values of the document format -------------------------------------
CUSTOM, CORE, SYSTEM = "docProps/custom.xml", "docProps/core.xml", "docProps/ISolidWorksInformation.xml"
FEATURES, TREE, KEYWORDS = "swXmlContents/Features", "swXmlContents/COMPINSTANCETREE", "swXmlContents/KeyWords"
CONFIGURATION_PROPERTIES = r"^docProps/Config-[0-9]+-Properties\.xml$"
PROPERTY_TYPES = ("lpstr", "lpwstr", "i4", "i2", "ui4", "ui2", "r8", "bool", "date", "filetime")
USER_SECTION = "UserDefinedProperties"
KINDS = {"PART": "part", "ASSEMBLY": "assembly", "DRAWING": "drawing"}
NO_FEATURES = ("Configuration", "Sheet", "View", "Layer")
CLASSES = {"Keywords": "root", "root": "root", "Attribute": "attribute", "Feature": "feature", "Layer": "layer", "Note": "note", "Reference": "reference", "Sheet": "sheet", "View": "view", "Sketch": "sketch"}
# --------------------------------------------------------------------------------


def _kind(text: str | None) -> str | None:
    return None if text is None else KINDS.get(text.upper(), "unknown")


def _properties(root: Node, path: str, _entry: str, _data: bytes):
    if path == CORE:
        for n, node in enumerate(root.children):
            value = node.first_text()
            yield n, node.tag, value, "xml_text", "empty" if not value else "present", "core", "global", None
        return
    system = path == SYSTEM
    index = None if path in (CUSTOM, SYSTEM) else int(path.removeprefix("docProps/Config-").split("-")[0])
    n = 0
    for section in root.walk():
        if section.tag != "propertySection" or (not system and section.attributes.get("name") != USER_SECTION):
            continue
        for p in section.named("property"):
            if name := p.attributes.get("name"):
                value = p.children[0] if p.children else None
                state = "missing" if value is None else "unsupported_type" if value.tag not in PROPERTY_TYPES else "present" if value.first_text() else "empty"
                yield n, name, None if value is None else value.first_text(), None if value is None else value.tag, state, "system" if system else "custom", "global" if index is None else "configuration", index
                n += 1


def _kinds(root: Node, _path: str, _entry: str, _data: bytes):
    header = root.first("swHeader")
    own = header.named("swFile")[0] if header and header.named("swFile") else None
    if own and own.attributes.get("swDocType"):
        yield _kind(own.attributes["swDocType"]), own.attributes["swDocType"]


def _whole(text: str | None) -> int | None:
    digits = (text or "").removeprefix("-").removeprefix("+")
    return int(text) if digits.isascii() and digits.isdigit() and abs(int(text)) < 2**63 else None


def _configurations(root: Node, _path: str, _entry: str, _data: bytes):
    forms = {"swConfiguration": ("swID", "swName", 0), "Configuration": ("id", "Name", 1)}
    for n, node in enumerate(root.walk()):
        if node.tag not in forms or (node.tag == "Configuration" and node.attributes.get("Type") != "ConfigurationManager"):
            continue
        by, name, priority = forms[node.tag]
        a = node.attributes
        index = _whole(a.get(by))
        if index is not None:
            parent = next((a[k] for k in ("swParentConfigurationName", "swParentName", "ParentName") if k in a), None)
            yield n, index, a.get(name), priority, parent, next((_whole(a[k]) for k in ("swParentConfigurationId", "swParentID", "ParentId") if k in a), None), a.get("Material")


def _header(root: Node) -> list[Node]:
    return [f for h in root.named("swHeader") for f in h.named("swFile")]


def _files(root: Node, _path: str, _entry: str, _data: bytes):
    for n, f in enumerate(_header(root)):
        if "id" in f.attributes:
            yield n, f.attributes["id"], f.attributes.get("swPath"), _kind(f.attributes.get("swDocType"))


def _models(root: Node, _path: str, _entry: str, _data: bytes):
    for models in root.named("swModelList")[:1]:
        for n, m in enumerate(models.named("swModel")):
            yield n, m.attributes.get("id"), m.attributes.get("swFileRef"), m.attributes.get("swConfigurationName"), _whole(m.attributes.get("swConfigurationId")), m.attributes.get("swBoundingBox")


def _roots(root: Node, _path: str, _entry: str, _data: bytes):
    for configurations in root.named("swConfigurationList")[:1]:
        for c in configurations.named("swConfiguration"):
            if _whole(c.attributes.get("swID")) is not None and "swModelRef" in c.attributes:
                yield _whole(c.attributes["swID"]), c.attributes["swModelRef"]


def _references(root: Node, _path: str, _entry: str, _data: bytes):
    for models in root.named("swModelList")[:1]:
        for n, m in enumerate(models.named("swModel")):
            for k, r in enumerate(m.named("swReference")):
                a = r.attributes
                yield (
                    n, k, a.get("swModelRef"), a.get("swName"), a.get("swConfigurationName"), a.get("swComponentReference"), a.get("swSuppressed"), a.get("swHidden"), a.get("swExcludeFromBOM"), a.get("swIsVirtualComponent"),
                    a.get("swFlexible"), a.get("swReferenceNumber"), a.get("swID"), a.get("swTransform"), json.dumps(a, sort_keys=True),
                )


def _features(root: Node, path: str, _entry: str, _data: bytes):
    for n, f in enumerate(root.children):
        if f.tag in NO_FEATURES or "id" not in f.attributes:
            continue
        a = f.attributes
        inner = [x.strip() for x in a.get("DissectableChildren", "").split(",") if x.strip()]
        sizes = [{"name": d.attributes.get("Name"), "raw_value": d.first_text()} for d in f.named("Dimension")]
        yield n, f.tag, a["id"], a.get("Name"), a.get("Type"), a.get("Dissectable"), a.get("DissectableRoot"), inner, sizes, json.dumps(a, sort_keys=True)


def _sheet_nodes(root: Node) -> list[tuple[Node, bool]]:
    """Sheets, and whether they are declared as such or only have views."""
    return [(s, s.attributes.get("Type") == "Sheet") for s in root.children if s.tag == "Sheet" and (s.attributes.get("Type") == "Sheet" or s.named("View"))]


def _sheets(root: Node, _path: str, _entry: str, _data: bytes):
    text = lambda s, tag: next((t for c in s.named(tag)[:1] if (t := c.first_text().strip())), None)
    for n, (s, declared) in enumerate(_sheet_nodes(root)):
        view = s.named("CustomPropertyView")
        yield n, s.attributes.get("id"), s.attributes.get("Name"), declared, text(s, "PaperSize"), text(s, "ScaleNumerator"), text(s, "ScaleDenominator"), text(s, "TemplateName"), view[0].attributes.get("Name") if view else None


def _views(root: Node, _path: str, _entry: str, _data: bytes):
    for n, (s, _) in enumerate(_sheet_nodes(root)):
        for k, v in enumerate(s.named("View")):
            yield n, k, v.attributes.get("id"), v.attributes.get("Name"), v.first_text().strip() or None, v.attributes.get("Description")


def record_id(entry: str, offset: int, raw: bytes) -> str:
    """Name of a record by its entry, exact range and content."""
    mix = hashlib.sha256(entry.encode() + b"\0" + offset.to_bytes(8, "little") + len(raw).to_bytes(8, "little") + hashlib.sha256(raw).digest())
    return f"drawing:record:{mix.hexdigest()}"


def _records(root: Node, _path: str, entry: str, data: bytes):
    ids = {}
    for n, node in enumerate(root.walk()):
        raw = data[node.start : node.end]
        ids[id(node)] = name = record_id(entry, node.start, raw)
        parent = node.parent
        kind = CLASSES.get(node.tag) or ("field" if parent is not None and parent.tag == "Sheet" else "other")
        text = "".join(node.texts).strip() or None
        a = node.attributes
        yield n, name, kind, node.tag, ids[id(parent)] if parent is not None else None, a.get("id"), a.get("Name"), a.get("Type"), a, text, node.start, len(raw), hashlib.sha256(raw).hexdigest()


#: table: (path pattern, columns, reader)
TABLES = {
    "properties": (f"^({CUSTOM}|{CORE}|{SYSTEM})$|{CONFIGURATION_PROPERTIES}", "ordinal int, name string, raw_value string, value_type string, value_state string, kind string, scope string, configuration_index long", _properties),
    "kind_candidates": (f"^({FEATURES}|{TREE}|{KEYWORDS})$", "document_kind string, raw_kind string", _kinds),
    "config_candidates": (f"^({FEATURES}|{TREE}|{KEYWORDS})$", "ordinal int, configuration_index long, name string, priority int, parent_name string, parent_index long, material string", _configurations),
    "header_files": (f"^({FEATURES}|{TREE})$", "ordinal int, file_id string, stored_path string, document_kind string", _files),
    "models": (f"^{TREE}$", "ordinal int, model_id string, file_ref string, configuration_name string, configuration_index long, bounding_box string", _models),
    "root_models": (f"^{TREE}$", "configuration_index long, model_id string", _roots),
    "model_references": (
        f"^{TREE}$",
        "model int, ordinal int, model_ref string, instance_name string, configuration string, component_reference string, suppressed string, hidden string, excluded string, virtual string, flexible string, instance_number string, component_id string, transform string, raw_attributes string",
        _references,
    ),
    "features": (f"^{KEYWORDS}$", "ordinal int, source_tag string, source_id string, name string, source_type string, dissectable string, dissectable_root string, children array<string>, dimensions array<struct<name:string,raw_value:string>>, raw_attributes string", _features),
    "sheets": (f"^{KEYWORDS}$", "ordinal int, source_id string, name string, declared boolean, paper_size string, scale_numerator string, scale_denominator string, sheet_format_path string, custom_property_view string", _sheets),
    "views": (f"^{KEYWORDS}$", "sheet int, ordinal int, source_id string, name string, referenced_document string, referenced_configuration string", _views),
    "drawing_records": (f"^{KEYWORDS}$", "ordinal int, id string, class string, source_tag string, parent_id string, source_id string, name string, source_type string, source_attributes map<string,string>, direct_text string, decoded_offset long, byte_len long, sha256 string", _records),
}


#: Columns of stored references that are attributes of a component's occurrence.
OCCURRENCE = {"source_name": "swName", "suppressed": "swSuppressed", "hidden": "swHidden", "excluded": "swExcludeFromBOM", "virtual": "swIsVirtualComponent", "instance_number": "swReferenceNumber"}


def _stored_references(streams: list[tuple[str, Node | Light]], without: tuple[str, ...] = ()) -> list[tuple]:
    """References of one document in the order in which a walk meets them: external ones, views, components.

    The same rows as ``operators.project.stored_references`` makes of the tables of
    ``facts.resolve``; which models are roots, and which of equal ids counts, is told
    there (``components``).
    """
    columns = [c for c in OCCURRENCE if c not in without]
    attributes, none = [OCCURRENCE[c] for c in columns], (None,) * len(columns)
    external, views, files, models, named = [], [], [], [], {}
    for path, root in streams:
        if path == FEATURES:
            external += [(n, stored is not None, stored or "", stored, kind) for n, _, stored, kind in _files(root, path, "", b"") if n > 0]
        elif path == KEYWORDS:
            views += [(n, k, stored is not None, stored or "", name, stored, configuration) for n, k, _, name, stored, configuration in _views(root, path, "", b"")]
        elif path == TREE:
            files += [(n, a["id"], a.get("swPath"), a.get("swDocType")) for n, f in enumerate(_header(root)) if "id" in (a := f.attributes)]
            models += [(n, m, m.attributes) for found in root.named("swModelList")[:1] for n, m in enumerate(found.named("swModel"))]
            for index, model in _roots(root, path, "", b""):
                named.setdefault(index, set()).add(model)
    files.sort(key=itemgetter(0))
    models.sort(key=itemgetter(0))
    rows = [(n, n - 1, "external_feature", None, stored, kind, None, *none) for n, (*_, stored, kind) in enumerate(sorted(external, key=itemgetter(0, 1, 2)), 1)]
    for *_, name, stored, configuration in sorted(views, key=itemgetter(0, 1, 2, 3)):
        rows.append((len(rows) + 1, len(rows), "drawing_view", None, stored, None, configuration, *(name if c == "source_name" else None for c in columns)))
    stored_by = {file: (stored, _kind(kind)) for _, file, stored, kind in files}
    target, nothing = {}, (None, None, None)
    for _, _, a in models:
        if (name := a.get("id")) is not None:
            target[name] = (*stored_by.get(a.get("swFileRef"), nothing[:2]), a.get("swConfigurationName"))
    roots: dict[int, list[int]] = {}
    for n, _, a in models:
        index = _whole(a["swConfigurationId"]) if "swConfigurationId" in a else None
        if index is not None and (len(named[index]) == 1 and a.get("id") in named[index] if index in named else not files or a.get("swFileRef") == files[0][1]):
            roots.setdefault(n, []).append(index)
    found: dict[int, list] = {}
    for n, m, _ in models if roots else ():
        for index in roots.get(n, ()):
            found.setdefault(index, []).append(m)
    for index in sorted(found):
        before = len(rows)
        for m in found[index]:
            for r in m.named("swReference"):
                get = r.attributes.get
                stored, kind, configuration = target.get(get("swModelRef"), nothing)
                own = get("swConfigurationName")
                n = len(rows)
                rows.append((n + 1, n - before, "assembly_component", index, stored, kind, configuration if own is None else own, *map(get, attributes)))
    return rows


#: Tables of whole documents, as ``TABLES``; their readers take (path, tree) of all streams of a document that fit, and columns to leave out. Given by ``read_tables`` only.
WHOLE = {
    "stored_references": (
        f"^({FEATURES}|{TREE}|{KEYWORDS})$", "reference_id long, place long, kind string, configuration_index long, stored_path string, document_kind string, referenced_configuration string, " + ", ".join(f"{c} string" for c in OCCURRENCE), _stored_references,
    ),
}
_ALL = TABLES | WHOLE


def _names(columns: str) -> list[str]:
    out, depth, word = [], 0, ""
    for c in columns + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += c
    return out


#: Rows of facts that a task holds before it hands them on: a batch of streams has thousands of times as many.
ROWS_HELD = 4096


def _arrow(schema: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return to_arrow_type(StructType.fromDDL(schema))


def _structs(found: list[tuple], kind: pa.DataType) -> pa.StructArray:
    """Rows as one Arrow column."""
    plain = lambda f, column: [None if x is None else list(x.items()) for x in column] if pa.types.is_map(f.type) else list(column)
    columns = zip(*found, strict=True) if found else [()] * kind.num_fields
    return pa.StructArray.from_arrays([pa.array(plain(f, c), f.type) for f, c in zip(kind, columns, strict=True)], fields=list(kind))


def _tree(raw: bytes, limits: Limits, read=parse) -> Node | Light | XmlFault:
    try:
        return read(raw, limits.xml_bytes, limits.xml_nodes, limits.depth)
    except XmlFault as fault:
        return fault


def _parsed(batch: pa.RecordBatch, limits: Limits):
    """(doc, entry, path, data, root or fault) of each stream of a batch, one at a time."""
    for doc, entry, path, data in zip(*(batch.column(n) for n in ("doc_id", "entry_id", "path", "decoded")), strict=True):
        raw = data.as_py()
        yield doc.as_py(), entry.as_py(), path.as_py(), raw, _tree(raw, limits)


def rows(streams: DataFrame, table: str, limits: Limits = SERVICE) -> DataFrame:
    """Rows of one table from the streams that it reads; streams that cannot be parsed give none (see ``tables``)."""
    pattern, columns, reader = TABLES[table]
    schema = f"doc_id string, stream_path string, {columns}"
    kind = _arrow(schema)

    def run(batches):
        for batch in batches:
            out = []
            for doc, entry, path, raw, root in _parsed(batch, limits):
                if isinstance(root, XmlFault):
                    continue
                for row in reader(root, path, entry, raw):
                    out.append((doc, path, *row))
                    if len(out) >= ROWS_HELD:
                        yield pa.RecordBatch.from_struct_array(_structs(out, kind))
                        out = []
            yield pa.RecordBatch.from_struct_array(_structs(out, kind))

    chosen = streams.filter(F.col("path").rlike(pattern) & F.col("decoded").isNotNull()).select("doc_id", "entry_id", "path", "decoded")
    return chosen.mapInArrow(run, schema)


def _tagged(only: list[str], found, limits: Limits, without: tuple[str, ...] = ()):
    """(schema, task function) of rows tagged by table, each in its table's own struct column.

    ``found(batch)`` gives (doc_id, entry_id, path, content, tree or fault) of each
    stream, one at a time, and (doc_id, code) for a row of tag ``files``. Documents
    of many rows, and batches of many documents, are handed on in parts. Columns
    ``without`` of tables of whole documents are left out.
    """
    patterns = {name: re.compile(_ALL[name][0]) for name in only}
    by_stream, by_document = [n for n in only if n in TABLES], [n for n in only if n in WHOLE]
    columns = {name: ", ".join(c for c in WHOLE[name][1].split(", ") if c.split()[0] not in without) for name in by_document} | {name: TABLES[name][1] for name in by_stream}
    head = "tag string, doc_id string, stream_path string, code string"
    schema = ", ".join([head, *(f"{name} struct<{_struct(columns[name])}>" for name in only)])
    kind = _arrow(schema)

    def whole(held: dict[str, list]) -> pa.RecordBatch:
        """The held rows, table by table: a table's own column has values at its rows only."""
        n, at, columns = sum(map(len, held.values())), 0, []
        columns.append(pa.array([name for name, found in held.items() for _ in found], pa.string()))
        columns += [pa.array([row[i] for found in held.values() for row in found], pa.string()) for i in range(3)]
        for name, found in held.items():
            own = kind.field(name).type if name in patterns else None
            if own is not None:
                columns.append(pa.concat_arrays([pa.nulls(at, own), _structs([row for *_, row in found], own), pa.nulls(n - at - len(found), own)]))
            at += len(found)
        return pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(kind)))

    def run(batches):
        # A tree is many objects that go with their last use; looking for circles among them is left to every 100,000th.
        gc.set_threshold(100_000)
        empty = lambda: {name: [] for name in (*only, "faults", "files")}
        for batch in batches:
            held, n = empty(), 0
            before: dict[str, list] = {name: [] for name in by_document}
            last = None
            for doc, *stream in chain(found(batch), [(None, None)]):
                if len(stream) == 1:
                    for name, trees in before.items():
                        for rows in batched(WHOLE[name][2](trees, without) if trees else (), ROWS_HELD):
                            held[name] += [(last, None, None, row) for row in rows]
                            n += len(rows)
                            if n >= ROWS_HELD:
                                yield whole(held)
                                held, n = empty(), 0
                        trees.clear()
                    if doc is not None or stream[0] is not None:
                        held["files"].append((doc, None, stream[0], None))
                        n += 1
                        if n >= ROWS_HELD:
                            yield whole(held)
                            held, n = empty(), 0
                    last = doc
                    continue
                entry, path, raw, root = stream
                if isinstance(root, XmlFault):
                    held["faults"].append((doc, path, str(root), None))
                    n += 1
                    continue
                for name in by_document:
                    if patterns[name].search(path):
                        before[name].append((path, root))
                for name in by_stream:
                    if patterns[name].search(path):
                        for row in TABLES[name][2](root, path, entry, raw):
                            held[name].append((doc, path, None, row))
                            n += 1
                            if n >= ROWS_HELD:
                                yield whole(held)
                                held, n = empty(), 0
            yield whole(held)

    return schema, run


def _by_tag(tagged: DataFrame, only: list[str]) -> dict[str, DataFrame]:
    """Each table, ``faults`` and ``files``: a filter and one column of the tagged rows."""
    found = {name: tagged.filter(F.col("tag") == name).select("doc_id", "stream_path", f"{name}.*") for name in only}
    return found | {"faults": tagged.filter("tag = 'faults'").select("doc_id", "stream_path", "code"), "files": tagged.filter("tag = 'files'").select("doc_id", "code")}


def tables(streams: DataFrame, limits: Limits = SERVICE) -> dict[str, DataFrame]:
    """All tables and ``faults``, from one pass in which each stream is parsed once."""
    schema, run = _tagged([*TABLES], lambda batch: _parsed(batch, limits), limits)
    chosen = streams.filter(F.col("path").rlike("|".join(p for p, _, _ in TABLES.values())) & F.col("decoded").isNotNull()).select("doc_id", "entry_id", "path", "decoded")
    found = _by_tag(cut(chosen.mapInArrow(run, schema)), [*TABLES])
    return {name: df for name, df in found.items() if name != "files"}


def read_tables(documents: DataFrame, only: list[str], kept: list[str], limits: Limits = SERVICE, faults: bool = True, without: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The tables ``only`` of documents (path, content), and ``faults`` and ``files``, from one pass.

    Containers and streams are read in the same task, one document at a time: the
    bytes of streams are neither written nor sent. ``files`` has a row for each
    document; its code holds E if the container has an error and R if any stream is
    decoded whose path is in ``kept``. Without ``faults`` only streams that the
    tables read are parsed. ``without``: columns of ``WHOLE`` that aren't asked for.
    """
    chosen = re.compile("|".join(p for p, _, _ in (TABLES.values() if faults else (_ALL[name] for name in only))))
    read_tree = parse if "drawing_records" in only else light
    patterns = [re.compile(p) for p in kept]
    wanted = lambda path, entry: any(p.search(path or "") or p.fullmatch(entry) for p in patterns)

    def found(batch):
        for name, data in zip(batch.column("doc_id"), batch.column("content"), strict=True):
            doc, scan = name.as_py(), containers.scan_bytes(data.as_py() or b"", limits, wanted, digests=False)
            read = [e for e in scan.entries if e["decoded"] is not None]
            yield doc, "E" * any(severity == "error" for _, severity, _ in scan.notes) + "R" * bool(read)
            for e in read:
                if chosen.search(e["path"] or ""):
                    yield doc, e["entry_id"], e["path"], e["decoded"], _tree(e["decoded"], limits, read_tree)

    schema, run = _tagged(only, found, limits, without)
    given = documents.select(F.col("path").alias("doc_id"), F.col("content").cast("binary").alias("content"))
    return _by_tag(cut(given.mapInArrow(run, schema)), only)


def _struct(columns: str) -> str:
    """Column definitions as fields of a struct type."""
    out, depth, start = [], 0, 0
    for at, c in enumerate(columns + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = columns[start:at].strip().partition(" ")
            out.append(f"`{name}`: {kind}")
            start = at + 1
    return ", ".join(out)
