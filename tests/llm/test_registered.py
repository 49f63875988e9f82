import os

import pytest

from tidelog.llm import queries as q

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_": "doc_id n_words n_hit n_items items_sha256 contaminated", "op2_": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op3_": "doc_id held_out n_tokens n_known train_tokens base_score score", "op4_": "doc_id held_out score predicted",
    "op5_": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op6_": "doc_id fingerprint component_id",
    "op7_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op8_": "page_id url text n_chars",
    "op9_": "doc_id n_lines n_removed kept_sha256", "op10_": "doc_id n_words n_removed kept_sha256", "pipeline": "doc_id start length sequence_id offset",
}
TYPES = {"kept": "boolean", "contaminated": "boolean", "base_failed": "boolean", "held_out": "boolean", "predicted": "int", "score": "double", "base_score": "double"}
TEXT = {"items_sha256", "base_sha256", "kept_sha256", "spans", "fingerprint", "url", "text"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("prefix", COLUMNS)
def test_results_have_the_contracts_columns(spark, prefix):
    (query,) = [f for n, f in q.queries().items() if n.startswith(prefix)]
    df = query(spark, SF)
    types = dict(df.dtypes)
    for c in COLUMNS[prefix].split():
        assert types[c] == ("string" if c in TEXT else TYPES.get(c, "bigint")), c
    rows = df.count()
    table = "pages" if prefix == "op8_" else "documents"
    assert rows >= (1 if prefix == "pipeline" else spark.read.parquet(f"{SF}/{table}.parquet").count())
    if prefix not in ("op5_", "pipeline"):
        assert rows == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.parametrize("prefix", ["op2_", "op7_", "op9_"])
def test_native_queries_run_no_python(spark, prefix):
    (query,) = [f for n, f in q.queries().items() if n.startswith(prefix)]
    plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
