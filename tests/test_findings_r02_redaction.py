"""F1 of FINDINGS_r02.md: redact_all reports every label, not those of its SQL alone."""

from pyspark.sql import Row


def test_redact_all_leaves_no_label_out(spark, tmp_path):
    from veilspan.plans.queries import QUERIES

    # from the rows of the 0.1 GB table in which the query and its SQL differ
    texts = {
        1: ("de bocirr os.\nLicensed under CC BY-NC 4.0.", 1, "de bocirr <ADDRESS>.0."),
        2: ('token = "2fc43797753588f13dc1659f3b1265a8c9a08e5a" on', 1, 'token = "2fc<PESEL>f13dc1659f3b1265a8c9a08e5a" on'),
        3: ("the the 4495589438270767 42.73.240.87 the", 1, "the the <CARD>.73.240.87 the"),
        4: ("mail jan@example.pl there", 1, "mail <EMAIL> there"),
        5: ("nothing", 0, "nothing"),
    }
    spark.createDataFrame([Row(doc_id=k, text=t, lang="en") for k, (t, _, _) in texts.items()]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["redact_all"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_spans"], r["redacted_text"]) for r in rows} == {k: (n, out) for k, (_, n, out) in texts.items()}
