
import os
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")
DIR = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")
def test_forms_are_redacted_at_the_limit_of_production(spark):
    from veilspan.plans.oracle import ORACLE_SQL
    from veilspan.plans.queries import QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    rows = QUERIES["redact_form_texts"](spark, DIR).select("doc_id", "message", "redacted_text").collect()
    theirs = con.execute(ORACLE_SQL["redact_form_texts"]).fetchall()
    assert Counter(map(tuple, rows)) == Counter(theirs)
    assert {r["message"] for r in rows} == {None, "text exceeds 2000 characters"}
    assert any("<EMAIL>" in (r["redacted_text"] or "") for r in rows)
    assert all((r["message"] is None) == (r["redacted_text"] is not None) for r in rows)
