"""Registered queries against their SQL on the smallest data."""

import os

import pytest

from sievework.catalog import load
from tests.compare import check, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
# one of each kind; tests/compare.py runs them all
CHECKED = (
    "clean_text_full", "format_output", "tone_rewrite", "dlp_strip", "masking_report", "chunk_fixed_collapsed",
    "chunk_word_pack", "chunk_paragraph_pack", "primary_entity", "chat_triage", "integrity_hash", "match_documents",
    "similarity_join_blocks", "search", "retrieve", "context_assemble", "answer_inputs", "memory_query", "text_source",
    "write_chunks", "upsert_by_id", "authorize_requests", "session_payload", "rate_limit", "rate_limit_stream",
    "session_state_stream", "stream_ingest", "search_mixed_scopes", "file_router", "memory_probe", "ingest_then_retrieve",
    "upsert_status", "memory_summary_numbered", "memory_summary_top3", "json_dir_source", "json_memory_source",
)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = connect(SF)
    *_, problem, wrong_types = check(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert problem is None
    assert not wrong_types


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
