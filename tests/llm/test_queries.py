"""The line query against its SQL twin; every other query gives its contract's columns for every row."""

from llm import queries
from workload import compare

SF = "/root/testdata/sf0.001"


def test_line_dedup_against_sql(spark):
    con = compare.duck(SF)
    want = con.execute(queries.LINE_DEDUP_SQL).fetchall()
    found = queries.op4_line_dedup(spark, SF).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_contract_columns(spark):
    docs, pages = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages"))
    for name, columns, rows in (
        ("op1_html_extract", "page_id url text n_chars", pages),
        ("op2_quality_rules", "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", docs),
        ("op6_byte_bpe", "doc_id n_tokens ids_sha256 decoded_sha256", docs),
        ("op10_token_output", "doc_id start n_tokens ids_crc32", docs),
    ):
        found = queries.queries()[name](spark, SF)
        assert set(columns.split()) <= set(found.columns) and found.count() == rows
