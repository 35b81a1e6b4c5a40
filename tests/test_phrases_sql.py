"""The phrase query and its SQL where a phrase begins inside a word just before it stands by itself."""

import pytest

from quillframe.plans import catalogue

duckdb = pytest.importorskip("duckdb")


def test_a_place_inside_a_word_hides_none_after_it(spark, tmp_path):
    texts = ["bathe the the en", "was a as a", "as as a", "the the the the", "éthe the the, the", "The THE|the the", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "the the en as a x"), (1, "as a")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in catalogue.QUERIES["d11_phrase_table"](spark, str(tmp_path)).select("doc_id", "phrase", "start").collect())
    assert got == sorted(con.sql(f"select doc_id, phrase, start from ({catalogue.ORACLE['d11_phrase_table']})").fetchall())
    assert (0, "the the", 6) in got and (2, "as a", 3) in got and [g[2] for g in got if g[0] == 3] == [0, 8]


def test_forms_are_dealt_to_all_cores(spark, tmp_path):
    """One small file of customers: what is done to the forms made of them is more than one task."""
    spark.range(1, 2001).selectExpr("id as c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("e1_form_entities", "e1_categories"):
        assert catalogue.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() >= 4
