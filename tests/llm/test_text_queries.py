"""Registered text queries: against SQL where there is some, else for their columns."""

import os
import sys

import pytest

from corpus_pipeline import STAGES, run
from weirgauge.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")

COLUMNS = {
    "op2_simhash": ["doc_id", "fingerprint", "component_id"],
    "op3_token_store": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op5_decontaminate": ["doc_id", "item_id", "n_equal", "n_aligned", "doc_at", "item_at"],
    "op6_html_text": ["page_id", "url", "text", "n_chars"],
    "op9_mix_sources": ["doc_id", "size", "source_size", "target", "copies", "taken"],
    "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.mark.parametrize("name", ORACLES)
def test_same_as_sql(spark, name):
    import check_queries

    good, note = check_queries.compare(spark, check_queries.connect(FOLDER), FOLDER, name)
    assert good, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_columns(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    assert frame.columns == COLUMNS[name]
    rows = spark.read.parquet(f"{FOLDER}/{'pages' if 'op6' in name else 'documents'}.parquet").count()
    assert frame.count() == rows or name == "op5_decontaminate"


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, docs
    for _, stage in STAGES[:-1]:
        kept = stage(spark, kept, FOLDER)
        assert kept.columns == columns
    got = run(spark, FOLDER).collect()
    assert len(got) == kept.count() > 0
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in kept.select("doc_id").collect())
