"""Queries of the package that SQL can say, against their SQL; and what is registered."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry_point
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    rows, error = compare(spark, connect(sf_dir), name, queries.JOBS[name], queries.ORACLES[name], sf_dir)
    assert error is None, error
    assert rows > 0


def test_every_operator_is_registered_once():
    names = [n for n in entry_point.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry_point.queries()


def test_columns_of_the_contract(spark, sf_dir):
    want = {
        1: "doc_id n_shingles component_id kept", 2: "page_id url text n_chars", 3: "doc_id n_words n_hit n_items items_sha256 contaminated",
        4: "page_id payload_bytes payload_digest record_type refers_to", 5: "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        6: "doc_id n_tokens ids_sha256 decoded_sha256", 7: "doc_id n_bytes n_removed n_spans kept_sha256",
        9: "doc_id n_words n_base first_word last_word base_labels labels score",
        10: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        11: "anchor_id positive_id rank negative_id positive_score negative_score", 12: "item_id rank doc_id score", 13: "page_id host path rule verdict",
    }
    for name, job in queries.JOBS.items():
        columns = want.get(int(name[2:].split("_")[0]), "").split()
        schema = dict(job(spark, sf_dir).dtypes) if columns else {}
        assert set(columns) <= set(schema), name
        for c in columns:
            assert c != "rank" or schema[c] == "int", name
            if c.startswith("n_") or c.endswith("_score") or c in ("anchor_id", "positive_id", "negative_id", "item_id", "component_id", "payload_bytes", "refers_to", "first_word", "last_word", "word_chars"):
                assert schema[c] == "bigint", (name, c)
