"""The registered queries and the pipeline on the smallest tables."""

from __future__ import annotations

import pytest
from compare import connect, difference

import corpus_pipeline
from disputeflow.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_twin(spark, name):
    assert difference(queries.registry()[name](spark, SF), connect(SF), queries.oracle_sql()[name]) is None


COLUMNS = {
    "op1_": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op2_": ["doc_id", "n_shingles", "component_id", "kept"],
    "op3_": ["doc_id", "start", "end", "first_doc_id"],
    "op4_": ["page_id", "host", "path", "rule", "verdict"],
    "op5_": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6_": ["doc_id", "start", "end", "other_id"],
    "op7_": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op8_": ["doc_id", "held_out", "score", "predicted"],
    "op9_": ["doc_id", "held_out", "score", "predicted"],
    "op10_": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op12_": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "op13_": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op11_": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
}


def test_queries_with_their_columns(spark):
    names = queries.registry()
    assert len(names) == len(COLUMNS)
    for start, columns in COLUMNS.items():
        (name,) = [n for n in names if n.startswith(start)]
        if start in ("op1_", "op5_", "op10_"):  # the others run below or beside their twins
            assert set(columns) <= set(names[name](spark, SF).columns)


@pytest.mark.parametrize("name", ["op4_url_template_filter", "op10_rule_ledger"])
def test_native_queries_run_no_python(spark, capsys, name):
    queries.registry()[name](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    for kind in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert kind not in plan


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.kept(stage(spark, docs, SF), name)
        assert docs.columns == columns
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left <= ids and len(left) > 0.7 * len(ids)
        ids = left
    whole = corpus_pipeline.run(spark, SF)
    assert whole.columns == [*columns, "n_tokens", "token_ids"]
    assert {r["doc_id"] for r in whole.select("doc_id").collect()} == ids
