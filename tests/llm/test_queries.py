"""The registered corpus queries: their columns, and their rows where SQL gives them too."""

import duckdb
import pytest

from tallyloom.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["page_id", "url", "text", "n_chars"],
    "op2": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op3": ["doc_id", "held_out", "expected_grade", "tail_probability", "kept"],
    "op4": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op5": ["doc_id", "held_out", "score", "predicted"],
    "op6": ["doc_id", "fingerprint", "component_id"],
    "op7": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op8": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op9": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op11": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    "op12": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op13": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op10": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.columns == COLUMNS[name.split("_")[0]]
    rows = df.collect()
    source = "pages" if name.startswith(("op1_", "op8_")) else "embeddings" if name.startswith("op11_") else "documents"
    n = spark.read.parquet(f"{SMALL}/{source}.parquet").count()
    assert len(rows) >= n if name.startswith("op2_") else len(rows) == n
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "labels", "pages", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
        got = con.execute(ORACLE_SQL[name])
        order = [c[0] for c in got.description]
        assert sorted(order) == sorted(df.columns)
        assert sorted(tuple(str(r[c]) for c in order) for r in rows) == sorted(tuple(map(str, r)) for r in got.fetchall())
