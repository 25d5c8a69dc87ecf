"""Pipeline stages on clashing columns, null ids and repeated rows; other queries' columns."""

import os
from collections import Counter

import pytest

from veilspan.llm import embedding_dedup, search, sharding, simhash, token_counts

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")
CLASHES = ("row", "found", "size", "copies", "id", "hash", "k", "n", "root", "fp", "score", "target", "need", "before", "bucket", "component_id", "text_hash", "first", "lang_pred")


def test_stages_carry_clashing_columns(spark):
    import corpus_pipeline as cp
    from veilspan.llm.common import read

    docs = read(spark, DIR, "documents").limit(80)
    docs = docs.unionByName(docs.limit(4))
    for k, name in enumerate(CLASHES):
        docs = docs.selectExpr("*", f"concat('c{k}-', coalesce(cast(doc_id as string), '')) AS {name}")
    docs = docs.cache()
    rows = Counter(docs.collect())
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns
        got = Counter(out.collect())
        assert set(got) <= set(rows) and got
        if name != "mixing":
            assert not got - rows
    packed = cp.STAGES[-1][1](spark, docs, DIR)
    assert Counter(r["doc_id"] for r in packed.where("piece = 0").collect()) == Counter(r["doc_id"] for r in docs.collect())


def test_null_ids_with_texts_in_the_dedup_stage(spark):
    import corpus_pipeline as cp
    from veilspan.llm.common import read

    long = " ".join(f"word{k}" for k in range(60))
    rows = [(None, "one two three four five six", 0), (None, "one two three four five six", 0), (None, long, 1), (5, long, 2), (5, long, 2), (7, None, 3), (None, None, 4), (9, "", 5), (None, " ".join(f"w{k * k}" for k in range(70)), 6)]
    docs = spark.createDataFrame([(i, t, "en", "s", n) for i, t, n in rows], read(spark, DIR, "documents").schema)
    out = cp.one_of_each_group(spark, docs, DIR).collect()
    fps = [simhash.fingerprint(t) for _, t, _ in rows]
    groups = {}
    for (i, t, _), f in zip(rows, fps, strict=True):
        key = next((g for g in groups if (g ^ f).bit_count() <= 4), f)
        groups.setdefault(key, []).append(i)
    least = Counter(min((i for i in ids if i is not None), default=None) for ids in groups.values())
    assert Counter(r["doc_id"] for r in out) == least
    assert cp.one_of_each_group(spark, docs.limit(0), DIR).collect() == []


def test_columns_of_the_other_queries(spark):
    out = search.op2_search(spark, DIR)
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    out = simhash.op3_simhash(spark, DIR)
    assert out.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    assert all(len(r["fingerprint"]) == 16 and r["fingerprint"] == r["fingerprint"].lower() for r in out.collect())
    out = embedding_dedup.op4_embedding_dedup(spark, DIR)
    assert out.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    out = token_counts.op5_token_counts(spark, DIR)
    assert out.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in out.collect())
    out = sharding.op6_sharding(spark, DIR)
    assert [c for c, _ in out.dtypes][:1] == ["doc_id"]


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    from veilspan.sources import tables

    class Conf:
        def __init__(self, named):
            self.named = named

        def get(self, key, default=None):
            return self.named

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context

        def __init__(self, named=None):
            self.conf = Conf(named)

    with pytest.raises(RuntimeError):
        tables.shared_base(Session())
    assert tables.shared_base(Session("hdfs://x/y/")) == "hdfs://x/y"
