"""Language ID: short texts, bounds, and the query by brute force."""

import os
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilspan.llm import language

zstandard = pytest.importorskip("zstandard")
DIR = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")


def test_bounds_come_from_the_nearest_class():
    narrow = {("aa", 2): 0.1, ("aa", 5): 0.3, ("bb", 0): 0.02}
    assert language.least_margin(narrow, "aa", 60) == 0.1
    assert language.least_margin(narrow, "aa", 10**6) == 0.3
    assert language.least_margin(narrow, "bb", 10**6) == 0.02
    assert language.least_margin(narrow, "cc", 3) == 0.02
    assert language.least_margin({}, "aa", 60) == 0.0


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 3)
    rows = spark.createDataFrame([(f"l{k}", f"text {k}") for k in range(4)], "lang string, text string")
    with pytest.raises(ValueError):
        language.train(rows)
    assert len(language.train(rows.where("lang <> 'l0'"))) == 3


def _letters(text):
    words = "".join(c if re.match(r"[^\W\d_]", c) else " " for c in (text or "").lower())
    return " ".join(w for w in words.split(" ") if w).encode()


def _model(rows):
    """Dictionaries of (text, lang), spelled out."""
    out = {}
    for lang in {g for _, g in rows}:
        counts = Counter(w for t in {t for t, g in rows if g == lang} for w in _letters(t).split())
        words, used = [], 0
        for word in sorted(counts, key=lambda w: (-counts[w], w)):
            used += len(word) + 1
            if used > 65_536:
                break
            words.insert(0, word)
        content = zstandard.ZstdCompressionDict(b" ".join(words) + b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=17, search_log=6, min_match=4, target_length=16, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
        content.precompute_compress(compression_params=params)
        out[lang] = zstandard.ZstdCompressor(compression_params=params, dict_data=content)
    return out


@needs_tables
def test_query_by_brute_force(spark):
    found = language.op9_language(spark, DIR)
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    learned = [(r["text"], r["lang"]) for r in docs if not held(r["doc_id"]) and r["lang"] is not None and r["text"] is not None]
    assert max(Counter(g for _, g in learned).values()) <= language.SAMPLE  # all are read
    model, many = _model(learned), Counter(g for _, g in learned)
    rows = {r["doc_id"]: r for r in found.collect()}
    assert len(rows) == len(docs)
    for r in docs[:400]:
        data = _letters(r["text"])
        sizes = {g: sum(len(c.compress(data[k : k + 1024] + b" " * 64)) for k in range(0, len(data), 1024)) for g, c in model.items()}
        best = min(sizes, key=lambda g: (sizes[g], -many[g], g))
        second = min(s for g, s in sizes.items() if g != best)
        want = (best, (second - sizes[best]) / second) if data else ("und", 0.0)
        assert rows[r["doc_id"]]["lang_pred"] == want[0]
        assert rows[r["doc_id"]]["score"] == pytest.approx(want[1]) and rows[r["doc_id"]]["held_out"] == held(r["doc_id"])


@needs_tables
def test_few_words_are_enough(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("lang is not null and text is not null")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    cut = test.withColumn("text", F.regexp_extract("text", r"(\p{L}+ \p{L}+ \p{L}+)", 1)).where("length(text) > 15")
    rows = language.identify(cut, train, name="found").select("lang", "found.lang").collect()
    assert len(rows) > 200 and sum(a == b for a, b in rows) >= 0.85 * len(rows)


def test_repeated_rows_get_equal_results(spark):
    rows = [(k % 3, ["der hund und die katze", "the dog and the cat", None][k % 3], ["de", "en", "de"][k % 3], "x") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, found string")
    out = language.identify(df, df, name="found").collect()
    assert len(out) == 9 and len(set(out)) == 3 and {r["found"]["lang"] for r in out if r["text"] is None} == {"und"}
