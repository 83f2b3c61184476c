"""Every query with SQL gives the SQL's rows and types."""

from __future__ import annotations

import pytest

from lathe.plans import catalog

from .compare import differences


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(catalog.QUERIES[name](spark, sf_dir), sf_dir, catalog.SQL[name]) == ""


def test_crc(spark, sf_dir):
    import zlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert {r["doc_id"]: r["crc32"] for r in catalog.inventory_crc(spark, sf_dir).collect()} == {i: zlib.crc32(t.encode()) for i, t in texts.items()}
