"""The rows that toxicity is learned from, its features, and the query by brute force."""

import math
import os
import zlib

import pytest

from veilspan.llm import toxicity

DIR = "/root/testdata/sf0.01"


def test_as_many_rows_as_there_may_be(spark):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(0, 300, 2)] + [(2, "a"), (2, None), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 3 == 0) for k in range(300)] + [(4, True), (None, True), (6, None)], "doc_id long, toxic boolean")
    rows = toxicity.learned(docs, labels.selectExpr("doc_id", "cast(toxic as int) as toxic"), most=100).collect()
    assert len(rows) == 100  # half of the labels have no document, and take nobody's place
    every = {r["__text"]: r["__label"] for r in toxicity.learned(docs, labels.selectExpr("doc_id", "cast(toxic as int) as toxic")).collect()}
    assert len(every) == 150 and every["a"] == 0 and "t2" not in every and every["t4"] == 1


def _places(text):
    """The n-grams' places, spelled out."""
    import regex

    words = [w.encode() for w in regex.findall(r"[\w']+", (text or "").lower())]
    h = [zlib.crc32(w) for w in words]
    found = set()
    for k, w in enumerate(words):
        found.add(h[k] * 0xFF51AFD7ED558CCD % 2**64)
        found |= {zlib.crc32(w[:n]) * (0xD6E8FEB86659FD93 ^ n) % 2**64 for n in toxicity.STEMS if len(w) > n}
    for k in range(len(h) - 1):
        found.add(h[k] * 0x9E3779B97F4A7C15 % 2**64 ^ h[k + 1] * 0xC2B2AE3D27D4EB4F % 2**64)
    for k in range(len(h) - 2):
        found.add(h[k] * 0x165667B19E3779F9 % 2**64 ^ h[k + 2] * 0x27D4EB2F165667C5 % 2**64)
    return {x >> 64 - toxicity.BITS for x in found}


def _fit(rows):
    """The learner a coordinate at a time, in plain Python."""
    z, n, bz, bn = {}, {}, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= toxicity.L1 else (math.copysign(toxicity.L1, z[i]) - z[i]) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)
    rows = [(sorted(_places(t)), y) for t, y in rows]
    for _ in range(toxicity.EPOCHS):
        for at, y in rows:
            w = [weight(i) for i in at]
            bias = -bz / ((toxicity.BETA + bn**0.5) / toxicity.ALPHA)
            g = 1 / (1 + math.exp(-(sum(w) + bias))) - y
            for i, x in zip(at, w, strict=True):
                ni = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((ni + g * g) ** 0.5 - ni**0.5) / toxicity.ALPHA * x
                n[i] = ni + g * g
            bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / toxicity.ALPHA * bias
            bn += g * g
    return {i: weight(i) for i in z if weight(i)}, -bz / ((toxicity.BETA + bn**0.5) / toxicity.ALPHA)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")
def test_query_by_brute_force(spark):
    out = toxicity.op1_toxicity(spark, DIR)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    labels = spark.read.parquet(f"{DIR}/labels.parquet").where("doc_id is not null and toxic is not null").selectExpr("doc_id", "toxic", "xxhash64(cast(doc_id as string)) as h").collect()
    model, bias = _fit([(texts[r["doc_id"]], r["toxic"]) for r in sorted(labels, key=lambda r: r["h"]) if not held(r["doc_id"]) and r["doc_id"] in texts])
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        want = 1 / (1 + math.exp(-(sum(model.get(i, 0.0) for i in _places(texts[r["doc_id"]])) + bias)))
        assert r["score"] == pytest.approx(want, abs=1e-6)
        assert r["held_out"] == held(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.3)
