"""Rows that repeat id and text take exactly their share of copies."""

from __future__ import annotations

from collections import Counter

from lathe.llm import mixing


def test_ties(spark):
    rows = [(None, "one two three four", "a" if i < 40 else "b", i % 3) for i in range(200)] + [(7, "five six", "b", 0)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(3)
    mix, mixed = mixing.mix(docs).collect(), mixing.mixed(docs)
    words = Counter()
    for r in mix:
        words[r["source"]] += r["size"] * r["copies"]
    assert all(abs(words[r["source"]] - r["target"]) <= 4 for r in mix) and len(mix) == len(rows)
    want = Counter((r["source"], r["size"]) for r in mix for _ in range(r["copies"]))
    assert Counter((r["source"], len(r["text"].split())) for r in mixed.collect()) == want
    assert mixed.columns == docs.columns
    # Of equal rows each is taken by its own count, and reruns agree.
    assert Counter(map(tuple, mixed.collect())) == Counter(map(tuple, mixing.mixed(docs.repartition(5)).collect()))


def test_empty_tables_stay_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, n int")
    assert mixing.mixed(docs).collect() == [] and mixing.mixed(docs).columns == docs.columns
