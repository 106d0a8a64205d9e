"""The registered queries: columns, whole tables, oracles."""

import duckdb
import pytest

from ledgerlark.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_ogg_media": "doc_id:bigint n_bytes:bigint payload_bytes:bigint payload_sha256:string tail_crc32:bigint media_bytes:bigint media_sha256:string feature:string",
    "op2_secret_crf": "doc_id:bigint n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string",
    "op3_pii_crf": "doc_id:bigint n_email:bigint n_ip:bigint n_card:bigint n_phone:bigint base_sha256:string spans:string",
    "op4_pivot_topk": "query_id:bigint rank:int vec_id:bigint score:bigint",
    "op5_best_fit_packing": "doc_id:bigint piece:int start:bigint length:bigint ids_crc32:bigint sequence_id:bigint offset:bigint",
    "op6_language_mixture": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op7_golay_simhash": "doc_id:bigint fingerprint:string component_id:bigint",
    "op8_html_crf": "page_id:bigint url:string text:string n_chars:bigint",
    "op9_line_suffix_array": "doc_id:bigint text:string n_chars:bigint lines_removed:bigint",
    "op10_entropy_mix": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint",
    "op11_quality_divergence": "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
    "op12_turn_repair": "conv_id:bigint gaps:bigint blank:bigint duplicate:bigint truncated:bigint illegal:bigint cost:bigint audit:string repaired_sha256:string",
    "op13_prefix_trie": "conv_id:bigint depth:bigint parent_conv_id:bigint n_convs:bigint n_children:bigint n_leaves:bigint saved_tokens:bigint ends_sha256:string",
}


def test_the_registry_is_whole():
    import __spark_entry__ as entry

    assert set(COLUMNS) == set(queries.QUERIES) and set(queries.ORACLES) <= set(COLUMNS)
    assert {*COLUMNS, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    got = queries.QUERIES[name](spark, SF)
    kinds = dict(got.dtypes)
    assert all(kinds[c] == k for c, k in (x.split(":") for x in COLUMNS[name].split()))
    table = "pages" if name.startswith("op8") else "documents"
    if name not in ("op4_pivot_topk", "op5_best_fit_packing", "op12_turn_repair", "op13_prefix_trie"):
        assert got.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in cur.description]
    got = queries.QUERIES[name](spark, SF).select(*cols).collect()
    assert sorted(map(tuple, got), key=str) == sorted(cur.fetchall(), key=str)
