import pytest

import __spark_entry__ as entry
from tools.check import compare
from waymark.llm import catalog

SF = "/root/testdata/sf0.01"
OUTPUT = {
    "op1": "doc_id n_words n_hit n_items items_sha256 contaminated", "op2": "doc_id held_out score predicted", "op3": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4": "doc_id n_shingles component_id", "op5": "doc_id piece start length ids_crc32 sequence_id offset", "op6": "query_id rank vec_id score", "op7": "doc_id n_lines n_dropped kept_sha256",
    "op8": "doc_id n_assign n_access n_hex base_sha256 spans", "op9": "doc_id n_words n_base first_word last_word base_labels labels score", "op10": "doc_id held_out lang_pred score",
    "op11": "page_id payload_bytes payload_digest record_type refers_to", "op12": "word form root n n_near form_n", "op13": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
}


def test_one_query_per_operator_and_the_pipeline():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(n.split("_")[0] for n in names) == sorted(OUTPUT) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_rows_equal_sql(spark, name):
    state, n, _, _, note = compare(spark, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert state == "ok", note


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n.split("_")[0] not in ("op4", "op6", "op11", "op12", "op13")])
def test_a_row_per_document(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.columns == OUTPUT[name.split("_")[0]].split()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert df.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    if not name.startswith("op5"):
        assert df.count() == docs.count()


@pytest.mark.parametrize("name", ["op11_warc", "op12_spelling_variants", "op13_conversation_repair"])
def test_columns(spark, name):
    assert entry.queries()[name](spark, SF).columns == OUTPUT[name.split("_")[0]].split()


def test_neighbour_recall(spark):
    import numpy as np

    found = entry.queries()["op6_nearest_neighbours"](spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        true = [int(ids[i]) for i in np.lexsort((ids, -s)) if i != q][:20]
        got = [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == ids[q]), key=lambda r: r["rank"])]
        assert len(got) == 20
        hits.append(len(set(got) & set(true)) / 20)
    assert np.mean(hits) >= 0.9
