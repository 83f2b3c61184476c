"""License scans by diagonal voting, in JVM expressions only.

Every rolling k-gram hash of a document's words (k = 2, 3) is joined to the
positions of the same hash in the templates, with the words themselves compared
too, so a match is never a hash collision. A match at document word p and
template word t votes for the diagonal p - t. Votes are summed by diagonal, and
neighbouring diagonals of a template, at most DRIFT words apart from first to
last, make a span, where a copy has words added or left out. A span is verified
in the order of the template: only matches that stand one behind the other in
the document count, they must cover enough of the template's words, and all
words that are numbers (a license's version) must be among them. The bounded
drift also bounds the span's length by that of the template.

The base phrases are templates of their own: a phrase stands where one diagonal
has all of its k-grams. This file's templates are a few hundred k-grams; others
may be given as a table, which is broadcast only below a checked size.

Defined cases: null counts as empty (no words, score 0); documents without
votes keep one row; a document that repeats a license gives its label once;
repeated rows are scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gathered, read

DRIFT = 8
LEAST_COVER = 0.8
#: Largest table of template k-grams that is broadcast.
BROADCAST_GRAMS = 200_000
SIZES = (2, 3)
KELVIN = "\u212a"

#: Words that may stand in a template, by phrase; labels of the base.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Notices that announce common public licenses.
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "lgpl": "gnu lesser general public license",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

#: Short notices, (label, words), which count only whole: one word of them tells licenses apart.
SHORT = [
    ("mit", "under the mit license"),
    ("mit", "spdx license identifier mit"),
    ("bsd", "under the bsd license"),
    ("bsd", "bsd 2 clause license"),
    ("bsd", "bsd 3 clause license"),
    ("mpl-2.0", "mozilla public license version 2 0"),
    ("mpl-2.0", "mozilla public license v 2 0"),
    ("mpl-2.0", "mozilla public license 2 0"),
    ("apache-2.0", "apache license version 2 0"),
    ("apache-2.0", "apache license 2 0"),
]

#: Whole texts of short public licenses, (label, words).
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
]

_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def builtin() -> list[tuple[str, str, bool, float]]:
    """(label, words, is base, least cover) of the templates in this file."""
    return (
        [(label, text, True, 1.0) for label, text in PHRASES.items()] + [(label, text, False, LEAST_COVER) for label, text in NOTICES.items()]
        + [(label, text, False, LEAST_COVER) for label, text in TEXTS] + [(label, text, False, 1.0) for label, text in SHORT]
    )


def templates(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """One row for each k-gram of each template: those of this file, then those of ``more`` (label, text, least_cover)."""
    table = spark.createDataFrame([(n, *row) for n, row in enumerate(builtin())], "template long, label string, text string, base boolean, least double")
    if more is not None:
        ids = F.monotonically_increasing_id() + F.lit(len(builtin()))
        table = table.unionByName(more.select(ids.alias("template"), "label", "text", F.lit(False).alias("base"), F.col("least_cover").alias("least")))
    words = table.select("template", "label", "base", "least", _words(F.col("text")).alias("t")).filter(F.size("t") > 1)
    k = F.least(F.size("t"), F.lit(SIZES[-1]))
    # Words with a digit tell versions apart: a span without one of them isn't this license.
    places = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.get("t", i).rlike("^[0-9]+$"))
    sized = words.select("template", "label", "base", "least", F.size("t").alias("size"), k.alias("k"), places.alias("must"), "t")
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1), lambda i: F.array_join(F.slice("t", i, F.col("k")), " ")))
    return sized.select("template", "label", "base", "least", "size", "k", "must", at.alias("at", "gram")).withColumn("h", F.xxhash64("gram"))


def _words(text) -> F.Column:
    """Words of a text, A-Z lower-cased. The Kelvin sign alone lower-cases to an ASCII letter; it must not."""
    safe = F.when(F.contains(text, F.lit(KELVIN)), F.translate(text, KELVIN, "\u00e6")).otherwise(text)
    # Only the first and the last piece can be empty.
    return F.filter(F.split(F.lower(safe), _BREAK), lambda x: x != "")


def votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: DataFrame | None = None) -> DataFrame:
    """uid, doc_id, n_words and the template position of each match; one row without a match for each document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), _words(text).alias("w"))
    placed = rows.select("doc_id", "uid", F.size("w").alias("n_words"), "w", F.posexplode_outer("w").alias("pos", "word"))
    second, third = F.try_element_at("w", F.col("pos") + 2), F.try_element_at("w", F.col("pos") + 3)
    gram = F.explode(F.array(F.concat(F.col("word"), F.lit(" "), second), F.concat(F.col("word"), F.lit(" "), second, F.lit(" "), third)))
    grams = placed.select("doc_id", "uid", "n_words", "pos", gram.alias("gram"))
    table = templates(docs.sparkSession, more).withColumnRenamed("gram", "known")
    if more is None or table.count() <= BROADCAST_GRAMS:
        table = F.broadcast(table)
    met = grams.withColumn("gh", F.xxhash64("gram")).join(table, (F.col("gh") == F.col("h")) & (F.col("gram") == F.col("known")), "left")
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    return met.filter(F.col("template").isNotNull() | first).select("uid", "doc_id", "n_words", "pos", "template", "label", "base", "least", "size", "k", "must", "at")


def _covered() -> F.Column:
    """Number of template words that the matches of a span cover, and whether all words that must be there are.

    Matches (at, pos) are taken in the order of the template; one counts if it
    stands behind the last that did. The column ``near`` holds the matches of the
    diagonals of one span.
    """
    start = F.struct(F.lit(-1).alias("at"), F.lit(-1).alias("pos"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("seen"))
    k = F.col("k")

    def step(done, m):
        fresh = F.least(k, m["at"] - done["at"])
        moves = (m["pos"] > done["pos"]) & (m["at"] > done["at"])
        reach = F.filter("must", lambda w: (w >= m["at"]) & (w < m["at"] + k))
        one = F.struct(m["at"].alias("at"), m["pos"].alias("pos"), (done["n"] + F.when(done["at"] < 0, k).otherwise(fresh)).alias("n"), F.array_union(done["seen"], reach).alias("seen"))
        return F.when(moves, one).otherwise(done)

    return F.aggregate(F.array_sort("near"), start, step)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: DataFrame | None = None) -> DataFrame:
    """One row for each document: words, base places, labels and score.

    ``more``: further templates (label, text, least_cover), whole license texts
    say; they are broadcast up to ``BROADCAST_GRAMS`` k-grams, else they join by
    shuffle.
    """
    found = votes(docs, id_col, text_col, more).repartition("uid")
    diagonal = F.col("pos") - F.col("at")
    by_diagonal = found.groupBy("uid", "template", diagonal.alias("diagonal")).agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("least").alias("least"), F.first("size").alias("size"),
        F.first("k").alias("k"), F.first("must").alias("must"), F.count_distinct("at").alias("hits"), F.collect_set(F.struct("at", "pos")).alias("matches"),
    )
    # A span is a diagonal with those at most DRIFT words behind it: a copy may have words added or left out, but not everywhere.
    span = Window.partitionBy("uid", "template").orderBy("diagonal").rangeBetween(Window.currentRow, DRIFT)
    spans = by_diagonal.withColumn("near", F.flatten(F.collect_list("matches").over(span))).withColumn("got", F.when(F.col("template").isNotNull() & ~F.col("base"), _covered()))
    place = F.col("base") & (F.col("hits") == F.col("size") - F.col("k") + 1)
    cover = F.when(place, F.lit(1.0)).otherwise(F.col("got.n") / F.col("size"))
    own = place | (~F.col("base") & (cover >= F.col("least")) & (F.size(F.array_except("must", "got.seen")) == 0))
    labels = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    return spans.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"), F.count_if(place).cast("long").alias("n_base"),
        F.min(F.when(place, F.col("diagonal"))).cast("long").alias("first_word"), F.max(F.when(place, F.col("diagonal"))).cast("long").alias("last_word"),
        labels(place).alias("base_labels"), labels(own).alias("labels"), F.coalesce(F.max(F.when(own, F.least(cover, F.lit(1.0)))), F.lit(0.0)).alias("score"),
    ).drop("uid")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gathered(scan(read(spark, sf_dir, "documents")))
