"""The queries at the smallest size: against DuckDB where SQL can tell, else their columns and row counts."""

import pytest
from harness import SF, compare, views

from quarry.llm import queries

QUERIES, ORACLE = queries.queries(), queries.oracle_sql()
COLUMNS = {
    "op1_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op5_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op6_token_counts": ["doc_id", "n_words", "n_tokens", "n_unknown"],
    "op8_class_lm": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
    "op9_pii": ["doc_id", "text", "n_entities", "kinds"],
    "op10_simhash": ["doc_id", "fingerprint", "component_id"],
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, name):
    compare(spark, views(), QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_every_document(spark, name):
    found = QUERIES[name](spark, SF)
    assert found.columns == COLUMNS[name]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found.select("doc_id").distinct().count() == docs.count()
    if "piece" not in found.columns:
        assert found.count() == docs.count()
