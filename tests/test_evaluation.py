"""Evaluation, gates, corpora on disk, state."""

import json
from collections import deque

import pytest
from pyspark.sql import functions as F

from veilspan.functions import checksums as ck
from veilspan.model import LABELS
from veilspan.operators import evaluation as ev
from veilspan.operators.detection import detect, long_form
from veilspan.operators.ratelimit import accepts, rate_limited
from veilspan.settings import Settings
from veilspan.sources import synthetic, tables

PUBLIC = [x for x in LABELS if x not in ("PERSON", "ORG", "ADDRESS")]


@pytest.fixture(scope="module")
def corpus(spark):
    return tables.kept(synthetic.corpus(spark.range(3000)), "test corpus")


def _gold(corpus):
    return corpus.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.start", "e.end", "e.label", "e.text")


def test_public_gates_pass(spark, corpus):
    found = long_form(detect(corpus, settings=Settings(enable_krs=True)), "doc_id")
    report = ev.report(_gold(corpus), found, PUBLIC)
    gates, micro = tables.gates_of(spark, {"micro_f1": 0.85, "labels": {x: {"precision": 1.0, "recall": 1.0, "max_invalid_fp": 0, "min_support": 1} for x in PUBLIC}})
    assert ev.gate_failures(report, gates, micro).collect() == []
    rows = {r["label"]: r for r in report.collect()}
    assert rows["PESEL"]["support"] == 1672 and rows[None]["f1"] == 1.0


def test_gold_spans_are_exact(corpus):
    wrong = _gold(corpus).join(corpus.select("doc_id", F.col("text").alias("body")), "doc_id").where(F.expr("substring(body, start + 1, `end` - start) != text"))
    assert wrong.count() == 0


def test_counts_measures_and_zero_denominators(spark):
    gold = spark.createDataFrame([("d", 0, 1, "A", "x"), ("d", 2, 3, "A", "x"), ("d", 2, 3, "A", "x"), ("e", 0, 11, "PESEL", "44051401358")], "doc_id string, start int, end int, label string, text string")
    found = spark.createDataFrame([("d", 0, 1, "A", "x"), ("d", 5, 6, "B", "y"), ("e", 0, 11, "PESEL", "44051401358"), ("e", 0, 11, "PESEL", "44051401358")], gold.schema)
    rows = {r["label"]: r for r in ev.report(gold, found).collect()}
    assert (rows["A"]["tp"], rows["A"]["fp"], rows["A"]["fn"], rows["A"]["precision"], rows["A"]["recall"], rows["A"]["f1"]) == (1, 0, 1, 1.0, 0.5, 0.6667)
    assert (rows["B"]["precision"], rows["B"]["recall"], rows["B"]["f1"], rows["B"]["support"]) == (0.0, 1.0, 0.0, 0)
    assert rows["PESEL"]["invalid_fp"] == 2 and rows[None]["invalid_fp"] == 0 and rows[None]["tp"] == 2
    empty = ev.report(gold.limit(0), found.limit(0)).collect()
    assert [(r["label"], r["tp"], r["f1"]) for r in empty] in ([], [(None, 0, 1.0)])


def test_gate_messages(spark):
    report = spark.createDataFrame([("A", 1, 1, 0, 2, 0.5, 1.0, 0.6667, 1), (None, 1, 1, 0, 0, 0.5, 1.0, 0.6667, 1)], "label string, tp long, fp long, fn long, invalid_fp long, precision double, recall double, f1 double, support long")
    gates, micro = tables.gates_of(spark, {"micro_f1": 0.9, "labels": {"A": {"precision": 0.9, "recall": 0.9, "max_invalid_fp": 0}, "B": {"f1": 0.9}, "C": {"min_support": 2}}})
    missed = {(r["label"], r["metric"]) for r in ev.gate_failures(report, gates, micro).collect()}
    assert missed == {("A", "precision"), ("A", "invalid_fp"), ("C", "support"), ("micro", "f1")}


def test_corpus_round_trip(spark, corpus, tmp_path):
    some = corpus.orderBy("doc_id").limit(20)
    tables.write_corpus(some, str(tmp_path / "c"))
    with open(tmp_path / "c" / "part-extra.json", "w") as f:
        f.write("\n   \n")
    back = tables.read_corpus(spark, str(tmp_path / "c"))
    assert sorted(map(str, back.collect())) == sorted(map(str, some.select(back.columns).collect()))


def test_report_and_gate_files(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"micro_f1": 0.5, "labels": {"A": {"f1": 1}}}))
    gates, micro = tables.read_gates(spark, str(tmp_path / "g.json"))
    assert micro == 0.5 and gates.first()["f1"] == 1.0
    report = spark.createDataFrame([("A", 1, 0, 0, 0, 1.0, 1.0, 1.0, 1), (None, 1, 0, 0, 0, 1.0, 1.0, 1.0, 1)], "label string, tp long, fp long, fn long, invalid_fp long, precision double, recall double, f1 double, support long")
    assert json.loads(tables.report_json(report, 3, 1.234, "c"))["per_label"]["A"]["tp"] == 1


def test_size_guard_and_audit(spark):
    df = detect(spark.createDataFrame([("a@b.pl",), ("x" * 11,), (None,)], "text string"))
    short, long = tables.within_size(df, most=10)
    assert short.count() == 2 and long.first()["reason"] == "text exceeds 10 characters"
    assert "text" not in tables.audit(df).columns


def test_checksums(spark):
    known = [("44051401359", "44051401358", ck.is_pesel), ("1234563218", "1234563217", ck.is_nip), ("123456785", "123456786", ck.is_regon), ("12345678512347", "12345678512346", ck.is_regon), ("PL61109010140000071219812874", "PL61109010140000071219812875", ck.is_iban), ("4111 1111-1111 1111", "4111111111111112", ck.is_luhn), ("aba 300000", "ABA123456", ck.is_dowod)]
    for good, bad, test in known:
        rows = spark.createDataFrame([(good,), (bad,), (good[:-1],), ("٤" * 11,), ("",), (None,)], "t string").select(test(F.col("t"))).collect()
        assert [r[0] for r in rows] == [True, False, False, False, False, None], test


def _limited(hits, limit, window):
    out, seen = {}, {}
    for key, at, n in sorted(hits, key=lambda h: (h[0], h[1], h[2])):
        out[n] = accepts(seen.setdefault(key, deque()), at, limit, window)
    return out


def test_rate_limit_counts_accepted_hits_alone(spark):
    hits = [("a", float(t), n) for n, t in enumerate([0, 1, 2, 3, 59, 60, 61, 62, 63, 120, 121, 122])] + [("b", 0.0, 100)]
    df = spark.createDataFrame(hits, "ip string, at double, n long").withColumn("at", F.timestamp_millis((F.col("at") * 1000).cast("long")))
    got = {r["n"]: r["accepted"] for r in rate_limited(df, "ip", "at", "n", 3, 60.0).collect()}
    assert got == _limited(hits, 3, 60.0)
    assert [got[n] for n in range(12)] == [True, True, True, False, False, False, True, True, True, False, False, True]
    nulls = spark.createDataFrame([(None, None, 1), (None, None, 2)], "ip string, at timestamp, n long")
    assert [r["accepted"] for r in rate_limited(nulls, "ip", "at", "n").collect()] == [False, False]


def test_command_line(spark, tmp_path, capsys):
    from veilspan.plans import evaluate

    path, gates = str(tmp_path / "corpus"), tmp_path / "gates.json"
    assert evaluate.main(["make", path, "--n", "60"]) == 0
    assert "umowa" in capsys.readouterr().out
    gates.write_text(json.dumps({"micro_f1": 0.9, "labels": {"PESEL": {"recall": 1.0, "min_support": 1}}}))
    assert evaluate.main(["run", path, "--gates", str(gates), "--labels", "PESEL,DOB", "--report", str(tmp_path / "r.json")]) == 0
    assert json.loads((tmp_path / "r.json").read_text())["per_label"]["PESEL"]["tp"] == 60
    gates.write_text(json.dumps({"labels": {"PESEL": {"min_support": 61}}}))
    assert evaluate.main(["run", path, "--gates", str(gates), "--labels", "PESEL", "--limit", "20"]) == 1


def test_form(spark):
    from veilspan.plans.engine import Engine

    df = spark.createDataFrame([("mail a@b.pl",), ("  ",), (None,), ("x" * 30,)], "text string")
    rows = [(r["message"], r["redacted_text"], r["summary"]) for r in Engine(Settings()).redact_form(df, mode="odd", most=20).collect()]
    assert rows == [(None, "mail <EMAIL>", "EMAIL×1"), ("empty text", None, None), ("empty text", None, None), ("text exceeds 20 characters", None, None)]
