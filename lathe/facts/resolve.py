"""Settled facts from candidate rows; tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathe.functions import values
from lathe.operators import conflicts

from . import streams

# ---- fixed values of the document format -------------------------------------
UNIT_SETTINGS = {
    "SW_UnitSystem": ("unit_system", values.UNIT_SYSTEM), "SW_UnitsLinear": ("length", values.LENGTH_UNIT), "SW_UnitsDualLinear": ("dual_length", values.LENGTH_UNIT), "SW_UnitsAngular": ("angle", values.ANGLE_UNIT),
    "SW_UnitsMassPropLength": ("mass_property_length", values.LENGTH_UNIT), "SW_UnitsMassPropMass": ("mass", values.MASS_UNIT), "SW_UnitsMassPropVolume": ("volume", values.VOLUME_UNIT),
}
UNIT_PLACES = {
    "SW_UnitsLinearDecimalPlaces": "length_decimal_places", "SW_UnitsDualLinearDecimalPlaces": "dual_length_decimal_places", "SW_UnitsAngularDecimalPlaces": "angle_decimal_places", "SW_UnitsMassPropDecimalPlaces": "mass_property_decimal_places",
}
SHEET_FIELDS = 10
# --------------------------------------------------------------------------------


def components(header_files: DataFrame, models: DataFrame, root_models: DataFrame, references: DataFrame) -> DataFrame:
    """Component occurrences of each configuration's root model.

    A configuration's root model is the one that its list names, if just one; for
    a configuration without an entry, each model of the document's own file (the
    first in the header).
    """
    tree = header_files.filter(F.col("stream_path") == streams.TREE)
    own = tree.groupBy("doc_id").agg(F.min_by("file_id", "ordinal").alias("own_file"))
    named = root_models.groupBy("doc_id", "configuration_index").agg(F.count_distinct("model_id").alias("n"), F.min("model_id").alias("root_model"))
    m = models.filter(F.col("configuration_index").isNotNull()).join(own, "doc_id", "left").join(named, ["doc_id", "configuration_index"], "left")
    by_list = (F.col("n") == 1) & (F.col("model_id") == F.col("root_model"))
    by_file = F.col("n").isNull() & (F.col("own_file").isNull() | F.col("file_ref").eqNullSafe(F.col("own_file")))
    roots = m.filter(F.coalesce(by_list, F.lit(False)) | by_file).select("doc_id", F.col("ordinal").alias("model"), "configuration_index")
    # Where an id repeats, the last one counts.
    last = lambda df, key: df.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", key).orderBy(F.desc("ordinal")))).filter("_k = 1").drop("_k")
    target = last(models.filter("model_id IS NOT NULL"), "model_id").select("doc_id", F.col("model_id").alias("model_ref"), "file_ref", "configuration_name")
    files = last(tree, "file_id").select("doc_id", F.col("file_id").alias("file_ref"), "stored_path", "document_kind")
    rows = references.join(roots, ["doc_id", "model"]).join(target, ["doc_id", "model_ref"], "left").join(files, ["doc_id", "file_ref"], "left")
    flag = lambda c: values.tristate(F.col(c))
    return rows.select(
        "doc_id", "configuration_index", F.row_number().over(Window.partitionBy("doc_id", "configuration_index").orderBy("model", "ordinal")).alias("ordinal"), "instance_name", "stored_path", "document_kind",
        F.coalesce("configuration", "configuration_name").alias("referenced_configuration"), "component_reference", flag("suppressed").alias("is_suppressed"), flag("hidden").alias("is_hidden"), flag("excluded").alias("exclude_from_bom"),
        flag("virtual").alias("is_virtual"), flag("flexible").alias("is_flexible"), values.trimmed_integer(F.col("instance_number")).alias("instance_number"), values.trimmed_integer(F.col("component_id")).alias("component_id"),
        values.tokens(F.col("transform"), 16).alias("raw_transform"), F.col("model_ref").alias("source_model_ref"), "raw_attributes",
    )


def external_references(header_files: DataFrame) -> DataFrame:
    """All header files of the feature stream but the document's own (the first)."""
    return header_files.filter((F.col("stream_path") == streams.FEATURES) & (F.col("ordinal") > 0)).select("doc_id", "ordinal", F.lit("external_feature").alias("kind"), "stored_path", "document_kind")


def view_references(views: DataFrame) -> DataFrame:
    return views.select("doc_id", "sheet", "ordinal", F.lit("drawing_view").alias("kind"), F.col("name").alias("source_name"), F.col("referenced_document").alias("stored_path"), F.col("referenced_configuration").alias("configuration"))


def stored_references(rows: DataFrame) -> DataFrame:
    """References that a document's reader has put in order, with flags and numbers; columns that it left out are null."""
    held = {c: F.col(c) for c in rows.columns}
    text = lambda c: held.get(c, F.lit(None).cast("string"))
    flag = lambda c, name: (values.tristate(held[c]) if c in held else F.lit(None).cast("boolean")).alias(name)
    return rows.select(
        "doc_id", "kind", "configuration_index", text("source_name").alias("source_name"), "stored_path", "document_kind", "referenced_configuration", flag("suppressed", "is_suppressed"), flag("hidden", "is_hidden"),
        flag("excluded", "exclude_from_bom"), flag("virtual", "is_virtual"), values.trimmed_integer(text("instance_number")).alias("instance_number"), "reference_id", "place",
    )


def references(component_rows: DataFrame, header_files: DataFrame, views: DataFrame) -> DataFrame:
    """All stored references of each document."""
    c = component_rows.select("doc_id", F.lit("assembly_component").alias("kind"), F.col("instance_name").alias("source_name"), "stored_path", "document_kind", F.col("referenced_configuration").alias("configuration"), "configuration_index")
    e = external_references(header_files).select("doc_id", "kind", "stored_path", "document_kind")
    v = view_references(views).select("doc_id", "kind", "source_name", "stored_path", "configuration")
    return c.unionByName(e, allowMissingColumns=True).unionByName(v, allowMissingColumns=True)


def document_kinds(candidates: DataFrame) -> DataFrame:
    """The kind that all evidence gives; withheld where it differs."""
    return conflicts.withheld(candidates, ["doc_id"], "document_kind", "stream_path").select("doc_id", F.col("value").alias("document_kind"), "withheld", "evidence")


def versions(entries: DataFrame) -> DataFrame:
    """Version number that stream paths carry, if they agree."""
    number = F.regexp_extract("path", "_MO_VERSION_([0-9]+)/", 1)
    found = entries.select("doc_id", F.when(number != "", number.try_cast("bigint")).alias("v")).filter("v IS NOT NULL")
    return conflicts.withheld(found, ["doc_id"], "v").select("doc_id", F.col("value").alias("internal_version"), "withheld")


def configurations(candidates: DataFrame) -> DataFrame:
    """One row for each configuration: name, alternates, parent and material, each withheld on conflict."""
    names = conflicts.ranked(candidates.filter("name IS NOT NULL"), ["doc_id", "configuration_index"], "name", "priority", "ordinal")
    listed = names.groupBy("doc_id", "configuration_index").agg(
        F.max(F.when(F.col("place") == 1, F.col("name"))).alias("name"), F.transform(F.array_sort(F.collect_list(F.when(F.col("place") > 1, F.struct("place", "name")))), lambda s: s["name"]).alias("alternate_names")
    )
    one = lambda c: conflicts.agreed(F.col(c))
    facts = candidates.groupBy("doc_id", "configuration_index").agg(one("parent_name").alias("parent_name"), one("parent_index").alias("parent_index"), one("material").alias("material"), (F.count_distinct("material") > 1).alias("material_withheld"))
    return facts.join(listed, ["doc_id", "configuration_index"], "left")


def units(properties: DataFrame) -> DataFrame:
    """Seven settings with names and four numbers of places; documents without any have no row; conflicting values are withheld."""
    wanted = properties.filter((F.col("kind") == "system") & F.col("name").isin(*UNIT_SETTINGS, *UNIT_PLACES))
    number = wanted.select("doc_id", "name", values.trimmed_integer(F.col("raw_value")).alias("v"))
    by_name = conflicts.withheld(number.filter("v IS NOT NULL"), ["doc_id", "name"], "v")
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    aggs = []
    for name, (shown, table) in UNIT_SETTINGS.items():
        aggs += [pick(name).alias(f"{shown}_code"), values.enum_name(pick(name), table).alias(shown)]
    aggs += [pick(name).alias(shown) for name, shown in UNIT_PLACES.items()]
    return by_name.groupBy("doc_id").agg(*aggs, F.bool_or("withheld").alias("withheld"))


def mass_properties(properties: DataFrame, name: str) -> DataFrame:
    rows = properties.filter((F.col("kind") == "system") & (F.col("name") == name))
    return rows.select("doc_id", "configuration_index", values.mass_properties(F.col("raw_value")).alias("mass"))


def sheet_formats(properties: DataFrame, sheets: DataFrame, name: str) -> DataFrame:
    """The k-th format record of a sheet name goes to the k-th sheet of that name.

    Records are fields between ``@``, ten each, with two empty ones at the end.
    """
    tokens = F.split("raw_value", "@", -1)
    n = F.size(tokens)
    sound = (n >= SHEET_FIELDS + 2) & ((n - 2) % SHEET_FIELDS == 0) & (F.element_at(tokens, -1) == "") & (F.element_at(tokens, -2) == "")
    rows = properties.filter((F.col("kind") == "system") & (F.col("name") == name)).filter(sound)
    starts = F.posexplode(F.sequence(F.lit(0), ((n - 2) / SHEET_FIELDS).cast("int") - 1))
    records = rows.select("doc_id", tokens.alias("t"), starts.alias("record", "k")).select("doc_id", "record", F.slice("t", F.col("k") * SHEET_FIELDS + 1, SHEET_FIELDS).alias("fields"))
    records = records.withColumn("name", F.element_at("fields", 1))
    k = lambda df, order: df.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "name").orderBy(order)))
    return k(sheets, "ordinal").join(k(records, "record"), ["doc_id", "name", "_k"], "left").drop("_k", "record")


def sheets(rows: DataFrame) -> DataFrame:
    """Sheets with the paper size's code and name."""
    code = values.trimmed_integer(F.col("paper_size"))
    return rows.withColumns({"paper_size_code": code, "paper_size_name": values.paper_size(code)})


def stream_coverage(entries: DataFrame, faults: DataFrame) -> DataFrame:
    """Streams and bytes by how far they were interpreted."""
    read = "|".join(p for p, _, _ in streams.TABLES.values())
    bad = faults.select("doc_id", F.col("stream_path").alias("path"), F.lit(True).alias("bad")).distinct()
    state = F.when(F.col("bad"), "malformed").when(F.col("path").rlike(read), "partially").otherwise("uninterpreted")
    rows = entries.filter("decoded_size IS NOT NULL").join(bad, ["doc_id", "path"], "left").withColumn("class", state)
    return conflicts.coverage(rows, ["doc_id"], "class", "decoded_size")


def with_name_fallbacks(candidates: DataFrame, properties: DataFrame) -> DataFrame:
    """Configuration candidates, and names that properties give.

    A configuration's own ``Configuration`` property is a name of rank 2. If a
    document has one configuration and nothing names it, the active
    configuration's system property does, at rank 3.
    """
    present = properties.filter("value_state = 'present'")
    own = present.filter("kind = 'custom' AND name = 'Configuration' AND configuration_index IS NOT NULL").select("doc_id", "stream_path", "ordinal", "configuration_index", F.col("raw_value").alias("name"), F.lit(2).alias("priority"))
    every = candidates.unionByName(own, allowMissingColumns=True)
    single = every.groupBy("doc_id").agg(F.count_distinct("configuration_index").alias("n"), F.count("name").alias("named"), F.max("configuration_index").alias("configuration_index")).filter("n = 1 AND named = 0")
    active = present.filter("kind = 'system' AND name = 'SW-Configuration Name'").groupBy("doc_id").agg(F.min_by("raw_value", "ordinal").alias("name"), F.min("ordinal").alias("ordinal"))
    derived = single.join(active, "doc_id").select("doc_id", "configuration_index", "name", F.lit(3).alias("priority"), "ordinal")
    return every.unionByName(derived, allowMissingColumns=True)


def selected_configurations(requests: DataFrame, configs: DataFrame) -> DataFrame:
    """Configurations that a request means: the one whose name or alternate fits, or all where none is named.

    requests: doc_id, requested (null: all). status: selected, missing or ambiguous.
    """
    names = F.array_compact(F.concat(F.array("name"), F.coalesce("alternate_names", F.array().cast("array<string>"))))
    rows = configs.select("doc_id", "configuration_index", names.alias("names"))
    met = requests.join(rows, "doc_id", "left").withColumn("fits", F.coalesce(F.col("requested").isNull() | F.array_contains("names", F.col("requested")), F.lit(False)))
    out = met.groupBy("doc_id", "requested").agg(F.array_sort(F.collect_set(F.when(F.col("fits"), F.col("configuration_index")))).alias("indices"))
    n = F.size("indices")
    status = F.when(F.col("requested").isNull() | (n == 1), "selected").when(n == 0, "missing").otherwise("ambiguous")
    return out.select("doc_id", "requested", status.alias("status"), F.when(status == "selected", F.col("indices")).otherwise(F.array().cast("array<bigint>")).alias("indices"))


def sheet_previews(sheet_rows: DataFrame, names: DataFrame, previews: DataFrame) -> DataFrame:
    """Sheets with their preview: by name to the last ordinal of that name; each preview goes to the first sheet that asks.

    names: doc_id, ordinal, name. previews: doc_id, ordinal, path.
    """
    last = names.groupBy("doc_id", "name").agg(F.max("ordinal").alias("preview_ordinal"))
    asked = sheet_rows.join(last, ["doc_id", "name"], "left")
    turn = F.row_number().over(Window.partitionBy("doc_id", "preview_ordinal").orderBy("ordinal"))
    first = asked.withColumn("_k", turn)
    images = previews.select("doc_id", F.col("ordinal").alias("preview_ordinal"), F.col("path").alias("preview"))
    joined = first.join(images, ["doc_id", "preview_ordinal"], "left")
    return joined.withColumn("preview", F.when(F.col("_k") == 1, F.col("preview"))).drop("_k", "preview_ordinal")


def extension_mismatches(kinds: DataFrame, path: str = "doc_id") -> DataFrame:
    """Documents whose suffix announces another kind than their content."""
    from lathe.sources.probe import kind_hint

    hint = kind_hint(F.col(path))
    return kinds.filter(hint.isNotNull() & F.col("document_kind").isNotNull() & (hint != F.col("document_kind"))).select("doc_id", hint.alias("announced"), "document_kind")


def drawing_coverage(records: DataFrame, sheets: DataFrame, views: DataFrame, carriers: DataFrame) -> DataFrame:
    """Counts of each document's drawing records: all, by class, sheets and views with and without an owner, distinct byte ranges, and streams that may hold more.

    records: doc_id, stream_path, class, decoded_offset, byte_len. carriers: doc_id, decoded_size.
    """
    by_class = records.groupBy("doc_id", "class").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "n")))).alias("classes"))
    ranges = records.groupBy("doc_id").agg(
        F.count("*").alias("records"), F.count_if(F.col("class") == "sheet").alias("sheet_records"), F.count_if(F.col("class") == "view").alias("view_records"),
        F.count_distinct(F.struct("stream_path", "decoded_offset", "byte_len")).alias("distinct_ranges"),
    )
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    held = carriers.groupBy("doc_id").agg(F.count("*").alias("candidate_streams"), F.sum("decoded_size").alias("candidate_bytes"))
    out = ranges.join(by_class, "doc_id", "left").join(count(sheets, "sheets"), "doc_id", "left").join(count(views, "views"), "doc_id", "left").join(held, "doc_id", "left")
    filled = out.fillna(0, ["sheets", "views", "candidate_streams", "candidate_bytes"])
    return filled.withColumn("unassigned_views", F.greatest(F.col("view_records") - F.col("views"), F.lit(0)))
