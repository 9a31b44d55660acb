"""Queries over whole tables give each document and customer a row, and pointers reach all pages."""

import __spark_entry__ as E

D = "/root/testdata/sf0.001"
QUERIES = E.queries()


def test_every_document_and_customer(spark):
    for name, table, key, id_ in (("truth_issues_all", "documents", "doc_id", "doc_id"), ("case_assembly_all", "customer", "c_custkey", "case_id")):
        want = sorted(r[0] for r in spark.read.parquet(f"{D}/{table}.parquet").select(key).collect())
        assert sorted(r[0] for r in QUERIES[name](spark, D).select(id_).collect()) == want
    assert {r[0] for r in QUERIES["case_assembly_all"](spark, D).select("origin").collect()} == {"P0", "DEV"}


def test_pointers_past_the_first_page(spark, tmp_path):
    text = "\n".join(f"line {i} of it" for i in range(25))
    rows = [(2, text), (1, text), (5, text), (6, text)]  # pages 3, 2, 3, 1 of 3
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["error"] for r in QUERIES["pointer_rules"](spark, str(tmp_path)).collect()} == {1: None, 2: None, 5: "bbox outside page bounds", 6: "bbox outside page bounds"}
    spark.createDataFrame([(20, text), (8, "x"), (10, "one page")], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    got = {r["doc_id"]: r["error"] for r in QUERIES["pointer_rules"](spark, f"{tmp_path}/b").collect()}
    assert got == {20: "excerpt not present in page text", 8: "excerpt not present in page text", 10: None}
