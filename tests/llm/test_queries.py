"""The registered queries over whole tables: against SQL, and their columns."""

import pytest
from oracle import DATA, difference, duck

from flowloom.llm.queries import ORACLES, QUERIES

SF = f"{DATA}/sf0.001"

COLUMNS = {
    "op1_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op2_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op3_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4_simhash": "doc_id fingerprint component_id",
    "op5_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op6_url_filters": "page_id host path rule verdict",
    "op7_main_text": "page_id url text n_chars",
    "op8_language_id": "doc_id held_out lang_pred score",
    "op9_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op10_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op11_mixing": "doc_id size source_size target taken",
    "op12_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op13_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(spark, name):
    assert difference(QUERIES[name](spark, SF).toPandas(), duck(SF).sql(ORACLES[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    out = QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(out.columns)
    key = "page_id" if "page_id" in out.columns else "doc_id"
    table = "pages" if key == "page_id" else "documents"
    want = spark.read.parquet(f"{SF}/{table}.parquet").select(key)
    got = out.select(key)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
