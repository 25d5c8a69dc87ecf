"""Cases of FINDINGS_r02.md."""

import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("zstandard")


def _word(k):
    return "".join(chr(97 + k // 26**i % 26) for i in range(4))


def test_dictionaries_hold_the_words_of_all_texts(spark):
    from veilspan.llm import language

    # a word of its own in each of more texts than a sample would have; copies count once
    rows = [("aa", f"kappa {_word(k)}") for k in range(3000)] * 2 + [("bb", "sigma tau"), ("cc", "123")]
    model = language.train(spark.createDataFrame(rows, "lang string, text string"))
    assert [g for g, _ in model] == ["aa", "bb", "cc"]
    want = sorted(_word(k).encode() for k in range(3000))
    assert dict(model)["aa"].split() == want[::-1] + [b"kappa"]
    assert dict(model)["bb"].split() == [b"tau", b"sigma"] and dict(model)["cc"].split() == []


def test_parts_of_counts_lose_no_common_word():
    import random

    from veilspan.llm import language

    rnd = random.Random(2)
    for size in (20, 100, 301):
        counts = [(("x" * rnd.randrange(1, 9) + _word(k)).encode(), rnd.randrange(1, 6)) for k in range(200)]
        parts = [x for i in range(7) for x in language.commonest(counts[i::7], size)]
        assert language.content(parts, size) == language.content(counts, size)


def test_bounds_come_from_the_margins_of_all_texts(spark, monkeypatch):
    import numpy as np

    from veilspan.llm import language

    # several hand-overs of counts
    monkeypatch.setattr(language, "HELD", 500)
    own = lambda g, k: " ".join(_word(zlib.crc32(f"{g}{k}{i}".encode()) % 700 + 5000 * g) for i in range(3 + k % 40))
    df = spark.createDataFrame([(f"l{g}", own(g, k)) for g in range(2) for k in range(1300)], "lang string, text string").distinct().cache()
    rows = df.withColumn("half", F.pmod(F.shiftright(F.xxhash64("text"), 40), F.lit(2))).collect()
    ways = [[(g, language.compressor(language.dictionary([r["text"] for r in rows if r["lang"] == g and r["half"] != k]))) for g in ("l0", "l1")] for k in (0, 1)]
    margins = {}
    for r in rows:
        for x in language.fragments(language.letters(r["text"])):
            name, margin = language.classify(x, ways[r["half"]])
            margins.setdefault((name, language.length_class(len(x))), []).append(margin)
    want = {k: 0.5 * np.quantile(v, 0.05) for k, v in margins.items() if len(v) >= 20}
    got = language.bounds(df)
    assert len(want) > 4 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
