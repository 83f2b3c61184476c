"""One short notice of each kind."""

from __future__ import annotations

from lathe.llm import licenses

LINES = [
    ("Released under the MIT License.", "mit"),
    ("Licensed under the MIT license", "mit"),
    ("SPDX-License-Identifier: MIT", "mit"),
    ("Distributed under the BSD license.", "bsd"),
    ("Licensed under the BSD 3-Clause License", "bsd"),
    ("Under the terms of the BSD 2-clause license", "bsd"),
    ("Subject to the Mozilla Public License, version 2.0.", "mpl-2.0"),
    ("Subject to the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("Mozilla Public License 2.0", "mpl-2.0"),
    ("Apache License, Version 2.0", "apache-2.0"),
    ("Apache License 2.0", "apache-2.0"),
    ("under the GNU Lesser General Public License", "lgpl"),
    ("Mozilla Public License, version 1.1", ""),
    ("Apache License, Version 1.1", ""),
    ("Released under the old town bridge", ""),
]


def test_short_license_notices(spark):
    docs = spark.createDataFrame([(i, f"Some words before. {t}") for i, (t, _) in enumerate(LINES)], "doc_id long, text string")
    got = {r["doc_id"]: set(filter(None, r["labels"].split(","))) for r in licenses.scan(docs).collect()}
    assert {LINES[i][0]: got[i] - {"gpl"} for i in got} == {t: {label} - {""} for t, label in LINES}
