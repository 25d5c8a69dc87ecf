"""Pareto order sampling: repeated ids, weights, and the query's columns."""

import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veilspan.llm import mixing

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, size long"


def _uniform(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    return {r["doc_id"]: r["u"] for r in df.select("doc_id", mixing.uniform(F.col("doc_id")).alias("u")).collect()}


def _prefix(rows, need):
    """How many rows (t, id, size) in order are taken."""
    total = n = 0
    for *_, size in sorted(rows):
        if total + size / 2 > need:
            return n
        total, n = total + size, n + 1
    return n


def test_an_often_repeated_id_is_cut_exactly(spark):
    rows = [(1, "a", 3)] * 5000 + [(k, "a", 1 + k % 7) for k in range(2, 400)] + [(2, "b", 4), (2, "b", 4), (None, "b", 0), (5, None, 9)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], SCHEMA + ", n long")
    out = mixing.mix(df.repartition(6)).collect()
    assert sorted(r["n"] for r in out) == list(range(len(rows)))
    u = _uniform(spark, {i for i, s, _ in rows if i is not None})
    for source in ("a", "b", None):
        own = [r for r in out if r["source"] == source]
        target, size = own[0]["target"], own[0]["source_size"]
        whole = int(target // size) if size else 0
        need = target - whole * size
        n = _prefix([(u.get(r["doc_id"], -1), r["doc_id"] or 0, r["size"]) for r in own], need) if need > 0 else 0
        assert sum(r["copies"] - whole for r in own) == n
        assert {r["copies"] for r in own} <= {whole, whole + 1}
        if source == "a":
            once = [r["copies"] - whole for r in own if r["doc_id"] == 1]
            assert 0 < sum(once) < 5000  # the cut is among the equal rows


def test_buckets_change_nothing(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(k, rnd.choice("aab"), rnd.randrange(0, 50)) for k in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = Counter(map(tuple, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "COARSE", 2)
    monkeypatch.setattr(mixing, "BUCKETS", 4)
    assert Counter(map(tuple, mixing.mix(df).collect())) == want


def test_unequal_odds(spark):
    rnd = random.Random(5)
    rows = [(k, "ab"[k % 2], rnd.randrange(1, 40), rnd.choice([0.5, 1.0, 4.0, 40.0])) for k in range(2000)]
    rows += [(5000, "a", 10, None), (5001, "a", 10, -1.0), (5002, "b", 10, float("nan")), (5003, "b", 10, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA + ", w double")
    out = mixing.mix(df.repartition(3), odds="w", most=3, share_percent=90).collect()
    u = _uniform(spark, [r[0] for r in rows])
    for source in "ab":
        own = [r for r in out if r["source"] == source]
        good = lambda w: w if w and w > 0 else 0.0
        target, full = own[0]["target"], set()
        while True:  # the level at which expected copies come to the target
            left = target - 3 * sum(r["size"] for r in own if r["doc_id"] in full)
            level = left / sum(good(r["w"]) * r["size"] for r in own if r["doc_id"] not in full)
            more = {r["doc_id"] for r in own if good(r["w"]) * level >= 3}
            if more <= full:
                break
            full |= more
        expected = {r["doc_id"]: 3.0 if r["doc_id"] in full else good(r["w"]) * level for r in own}
        whole = {d: int(e) for d, e in expected.items()}
        need = target - sum(whole[r["doc_id"]] * r["size"] for r in own)
        order = []
        for r in own:
            p, x = expected[r["doc_id"]] - whole[r["doc_id"]], u[r["doc_id"]]
            if p > 0:
                order.append(((x / (1 - x)) / (p / (1 - p)), r["doc_id"], r["size"]))
        taken = {d for _, d, _ in sorted(order)[: _prefix(order, need)]}
        assert {r["doc_id"]: r["copies"] for r in own} == {d: n + (d in taken) for d, n in whole.items()}
        assert abs(sum(r["copies"] * r["size"] for r in own) - target) <= 20
        mean = defaultdict(list)
        for r in own:
            mean[r["w"]].append(r["copies"])
        assert sum(mean[40.0]) / len(mean[40.0]) > sum(mean[1.0]) / len(mean[1.0]) > sum(mean[0.5]) / len(mean[0.5])


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")
def test_columns_of_the_query(spark):
    out = mixing.op8_mixing(spark, DIR)
    assert out.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
