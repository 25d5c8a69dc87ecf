"""Command line: make a corpus, or evaluate detection on one against gates.

    python -m veilspan.plans.evaluate make PATH --n 3000
    python -m veilspan.plans.evaluate run PATH --gates FILE --labels PESEL,NIP --report FILE

`run` prints the report as JSON and ends with status 1 if, and only if, a gate is missed.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilspan.operators import evaluation as ev
from veilspan.operators.detection import detect, long_form
from veilspan.settings import Settings
from veilspan.sources import synthetic, tables


def make(spark: SparkSession, path: str, n: int) -> None:
    """Writes a corpus of n documents and prints how many there are of each kind."""
    corpus = tables.kept(synthetic.corpus(spark.range(n)), f"corpus {n}")
    tables.write_corpus(corpus, path)
    labels = corpus.select(F.explode("entities").alias("e")).select("e.label")
    print("templates:", {r[0]: r[1] for r in ev.histogram(corpus, "template").collect()})
    print("labels:", {r[0]: r[1] for r in ev.histogram(labels, "label").collect()})


def run(spark: SparkSession, path: str, gates: str | None = None, labels: list[str] | None = None, limit: int | None = None, settings: Settings | None = None) -> tuple[str, list[str]]:
    """(the report as JSON, the messages of missed gates)."""
    corpus = tables.read_corpus(spark, path)
    if limit is not None:
        corpus = corpus.orderBy("doc_id").limit(limit)
    start = time.perf_counter()
    # written once: the report and the gates read the same spans
    spans = detect(corpus, settings=settings or Settings(enable_krs=True)).select("doc_id", "spans", "entities")
    name = f"spans of {path} at {time.time()}"
    spans = tables.kept(spans, name)
    n = spans.count()
    took = (time.perf_counter() - start) * 1000 / max(n, 1)
    gold = long_form(spans, "doc_id", "entities")
    report = tables.kept(ev.report(gold, long_form(spans, "doc_id"), labels), name + ", report")
    missed = []
    if gates:
        rows, micro = tables.read_gates(spark, gates)
        missed = [r["message"] for r in ev.gate_failures(report, rows, micro).orderBy("message").collect()]
    return tables.report_json(report, n, took, path), missed


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("what", choices=("make", "run"))
    parser.add_argument("path")
    parser.add_argument("--n", type=int, default=3000)
    parser.add_argument("--gates")
    parser.add_argument("--labels", default="")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--report")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if given.what == "make":
        make(spark, given.path, given.n)
        return 0
    report, missed = run(spark, given.path, given.gates, [x for x in given.labels.split(",") if x] or None, given.limit)
    print(report)
    if given.report:
        with open(given.report, "w", encoding="utf-8") as f:
            f.write(report + "\n")
    for message in missed:
        print("gate missed:", message, file=sys.stderr)
    return int(bool(missed))


if __name__ == "__main__":
    sys.exit(main())
