"""Queries of the training-data operators that SQL can express."""

from __future__ import annotations

import pytest

from lathe.llm import registry
from tests.compare import differences


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(registry.queries()[name](spark, sf_dir), sf_dir, registry.oracle_sql()[name]) == ""


def test_registered_queries_have_contract_columns(spark, sf_dir):
    want = {
        "op1_exact_dedup": "doc_id keep_id group_size kept text_sha256",
        "op2_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op3_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op5_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
        "op7_sharding": "doc_id size text_crc32 law shard slot grown_shard",
        "op8_mixing": "doc_id size source_size target taken",
        "op9_simhash": "doc_id fingerprint component_id",
        "op10_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    }
    for name, columns in want.items():
        assert set(columns.split()) <= set(registry.queries()[name](spark, sf_dir).columns), name
