"""F1 of FINDINGS_r02.md: redact_all and its SQL on odd texts that hold no label but EMAIL."""

import pytest

duckdb = pytest.importorskip("duckdb")


def test_redact_all_agrees_with_its_sql_on_odd_texts(spark, tmp_path):
    from veilspan.plans.oracle import ORACLE_SQL
    from veilspan.plans.queries import QUERIES

    texts = [None, "", " ", "a@b.pl,c@d.pl;a@b.pl", "x\u0001a@b.pl\u0001y", "a😀b jan@example.pl\r\nx", "żółć@exąmple.pl a@b.c", "a@b.pl\0c@d.pl"]
    spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    theirs = con.execute(f"SELECT doc_id, n_spans, redacted_text FROM ({ORACLE_SQL['redact_all']})").fetchall()
    rows = QUERIES["redact_all"](spark, str(tmp_path)).select("doc_id", "n_spans", "redacted_text").collect()
    assert sorted(map(tuple, rows)) == sorted(theirs)
    assert (0, None, None) in theirs
