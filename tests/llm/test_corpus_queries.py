"""The registered queries on the smallest tables, and the pipeline by brute force."""

import os
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")
DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")


def test_registered():
    import __spark_entry__ as e
    from veilspan.llm.queries import QUERIES

    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
    assert {"pipeline", *QUERIES} <= set(e.queries())


def test_queries_agree_with_sql(spark):
    from veilspan.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, DIR)
        theirs = con.execute(sql)
        names = [c[0] for c in theirs.description]
        assert Counter(map(tuple, df.select(*names).collect())) == Counter(theirs.fetchall()), name


def test_pipeline(spark):
    import corpus_pipeline as cp
    from veilspan.llm import language, mixing, packing, simhash, toxicity
    from veilspan.llm.common import read

    docs = read(spark, DIR, "documents")
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", "s", 0)], docs.schema)).cache()
    steps = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DIR)
        if name != "packing":
            assert out.columns == docs.columns
        steps[name] = (docs.collect(), out.collect())
        docs = spark.createDataFrame(steps[name][1], out.schema)
    # toxicity: the rows below the threshold, and no others
    before, after = steps["toxicity"]
    model = toxicity.train(*(spark.createDataFrame(before, cp.read(spark, DIR, "documents").schema).where("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 4 != 2"), read(spark, DIR, "labels")))
    held = dict(zip(model[0].tolist(), model[1].tolist(), strict=True))
    low = lambda t: toxicity._sigmoid(sum(held.get(f, 0.0) for f in set(toxicity.features(t).tolist())) + model[2]) < toxicity.THRESHOLD
    assert Counter(after) == Counter(r for r in before if low(r["text"]))
    # language: texts without letters go, clean ones stay
    before, after = steps["language"]
    assert not [r for r in after if not language.letters(r["text"])]
    assert len([r for r in before if language.letters(r["text"])]) - len(after) <= 1
    # SimHash: one of each component
    before, after = steps["simhash"]
    fps = [simhash.fingerprint(r["text"]) for r in before]
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(before):
        least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(least.values())
    # mixing: whole copies, near the targets
    before, after = steps["mixing"]
    times, size = Counter(r["doc_id"] for r in after), {r["doc_id"]: len((r["text"] or "").split()) for r in before}
    assert max(times.values()) <= mixing.MOST_COPIES and set(times) <= set(size)
    # half a document a source is how near a sample can come
    slack = sum(max(size[r["doc_id"]] for r in before if r["source"] == s) / 2 for s in {r["source"] for r in before})
    assert abs(sum(size[d] * n for d, n in times.items()) - 1.5 * sum(size.values())) <= slack
    # packing: every copy of every document, whole
    before, after = steps["packing"]
    assert Counter(r["doc_id"] for r in after if r["piece"] == 0) == Counter(r["doc_id"] for r in before)
    used = Counter()
    for r in after:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= packing.CAPACITY


def test_pipeline_of_nothing(spark):
    import corpus_pipeline as cp
    from veilspan.llm.common import read

    docs = read(spark, DIR, "documents").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, DIR)
        assert docs.collect() == []


def test_core_stands_without_this_subpackage():
    import pathlib
    import subprocess

    root = pathlib.Path(__file__).resolve().parents[2]
    lines = subprocess.run(["grep", "-rln", "veilspan.llm", str(root / "veilspan"), "--include=*.py"], capture_output=True, text=True).stdout.split()
    assert all("/llm/" in line for line in lines)
