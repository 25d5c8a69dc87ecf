"""Exact-span evaluation: counts, precision, recall, F1, gates.

Gold and predictions are long tables (doc_id, start, end, label, text). Both sides
are distinct on (doc_id, start, end, label) before they are compared; checksum
failures are counted over the predictions as they come. One aggregation by span key
does both: each side is read once, and rows of equal keys are combined before the
shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.checksums import valid_by_label

KEY = ["doc_id", "start", "end", "label"]


def classified(gold: DataFrame, found: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """doc_id, start, end, label, kind (tp, fp or fn), invalid: one row for each
    distinct key, with the number of its predictions that fail their checksum."""
    fails = ~F.coalesce(valid_by_label(F.col("label"), F.col("text")), F.lit(True))
    sides = (gold.select(*KEY, F.lit(True).alias("g"), F.lit(0).alias("bad")), found.select(*KEY, F.lit(False).alias("g"), fails.cast("int").alias("bad")))
    both = sides[0].unionByName(sides[1])
    if labels:
        both = both.where(F.col("label").isin(*labels))
    keys = both.groupBy(*KEY).agg(F.bool_or("g").alias("in_gold"), F.bool_or(~F.col("g")).alias("in_found"), F.sum("bad").alias("invalid"))
    kind = F.when(F.col("in_gold") & F.col("in_found"), "tp").when(F.col("in_found"), "fp").otherwise("fn")
    return keys.select(*KEY, kind.alias("kind"), "invalid")


def _ratio(of: Column, whole: Column) -> Column:
    return F.when(whole == 0, 1.0).otherwise(of / whole)


def scored(counts: DataFrame) -> DataFrame:
    """counts (tp, fp, fn, ...) with precision, recall, f1 and support; nothing
    found is precision 1, nothing to find is recall 1."""
    tp = F.col("tp").cast("double")
    p, r = _ratio(tp, F.col("tp") + F.col("fp")), _ratio(tp, F.col("tp") + F.col("fn"))
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return counts.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(f1, 4), "support": F.col("tp") + F.col("fn")})


def report(gold: DataFrame, found: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """A row a label and one with label null for all: tp, fp, fn, invalid_fp and the
    measures. The total's invalid_fp is 0: failures are counted by label alone."""
    kinds = classified(gold, found, labels)
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    counts = kinds.rollup("label").agg(count("tp"), count("fp"), count("fn"), F.sum("invalid").alias("invalid"), F.grouping("label").alias("total"))
    counts = counts.where((F.col("total") == 1) | F.col("label").isNotNull())
    out = counts.withColumn("invalid_fp", F.when(F.col("total") == 1, 0).otherwise(F.col("invalid")).cast("long"))
    return scored(out).select("label", "tp", "fp", "fn", "invalid_fp", "precision", "recall", "f1", "support")


def gate_failures(measured: DataFrame, gates: DataFrame, micro_f1: float | None = None) -> DataFrame:
    """(label, metric, value, floor, message) for each gate that is missed.

    A gate's label that the report lacks fails only if it asks for support.
    """
    m = measured.where("label is not null").select(F.col("label").alias("__label"), *(F.col(c).cast("double").alias(f"m_{c}") for c in ("precision", "recall", "f1", "invalid_fp", "support")))
    both = gates.join(F.broadcast(m), F.col("label") == F.col("__label"), "left")  # a row a label
    there = F.col("__label").isNotNull()

    def miss(metric: str, gate: str, below: bool) -> Column:
        value, limit = F.col(f"m_{metric}"), F.col(gate).cast("double")
        bad = there & limit.isNotNull() & ((value < limit) if below else (value > limit))
        if metric == "support":
            value = F.coalesce(value, F.lit(0.0))
            bad = (limit > 0) & (value < limit)
        return F.struct(bad.alias("bad"), F.lit(metric).alias("metric"), value.alias("value"), limit.alias("floor"))

    tests = F.array(miss("precision", "precision", True), miss("recall", "recall", True), miss("f1", "f1", True), miss("invalid_fp", "max_invalid_fp", False), miss("support", "min_support", True))
    out = both.select("label", F.explode(tests).alias("t")).where("t.bad").select("label", "t.metric", "t.value", "t.floor")
    if micro_f1 is not None:
        total = measured.where("label is null").select(F.lit("micro").alias("label"), F.lit("f1").alias("metric"), F.col("f1").alias("value"), F.lit(float(micro_f1)).alias("floor"))
        out = out.unionByName(total.where("value < floor"))
    relation = F.when(F.col("metric") == "invalid_fp", ">").otherwise("<")
    return out.withColumn("message", F.concat_ws(" ", "label", "metric", F.col("value").cast("string"), relation, F.col("floor").cast("string")))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def entity_counts(long_spans: DataFrame, key: str = "doc_id") -> DataFrame:
    return long_spans.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"))
