
import os
import random

import pytest

pytest.importorskip("zstandard")
DIR = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")


@needs_tables
def test_unlearned_languages_and_gibberish_go(spark):
    import corpus_pipeline as cp
    from veilspan.llm import language
    from veilspan.llm.common import read

    docs = read(spark, DIR, "documents").where("text is not null").cache()
    rnd = random.Random(1)
    junk = [" ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randrange(2, 11))) for _ in range(n)) for n in (12, 30, 60, 200) for _ in range(50)]
    page = "Il gatto dorme sulla sedia vicino alla finestra mentre la pioggia cade piano sui tetti della vecchia città e nessuno passa per la strada. " * 3
    # rows without a language are judged, and not learned from
    extra = spark.createDataFrame([(10**6 + k, t, None, "junk", len(t)) for k, t in enumerate([*junk, page])], docs.schema)
    known = docs.where("lang <> 'de'")
    unknown = docs.where("lang = 'de'").selectExpr("doc_id", "text", "cast(null as string) as lang", "'left out' as source", "n_chars")
    out = cp.reject_unknown_language(spark, known.unionByName(unknown).unionByName(extra), DIR).select("doc_id", "lang", "source").collect()
    kept = {s: sum(r["source"] == s and r["lang"] is None for r in out) for s in ("junk", "left out")}
    assert kept["junk"] <= 0.05 * len(junk) and 10**6 + len(junk) not in {r["doc_id"] for r in out}
    assert kept["left out"] <= 0.1 * unknown.count()
    assert sum(r["lang"] is not None for r in out) >= 0.99 * known.count()
    assert language.bounds(known.limit(0)) == {}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><div style='overflow:hidden'><p>kept</p></div></article>", "kept"),
        ("<article><p title='the hidden cost'>kept</p></article>", "kept"),
        ("<article><section aria-hidden='false' data-x='hidden'>kept</section></article>", "kept"),
        ("<article><p>kept<p HIDDEN=''>no</p><div class=x hidden>no</div><div hidden=until-found>found</div></article>", "kept\n\nfound"),
        ("<body class='single-post right-sidebar'><article><p>kept</p></article></body>", "kept"),
        ("<body class='page'><div class='content with-sidebar'><h1>Title words</h1><main><p>kept</p></main></div></body>", "Title words\n\nkept"),
        ("<div id=nav-wrapper><article class='post has-comments'><p>kept</p></article></div>", "kept"),
        ("<div class='wrapper right-sidebar'><main class='no-sidebar'><p>kept</p><div class=sidebar><p>no</p></div></main><div class=sidebar><article>no</article></div></div>", "kept"),
        ("<div class='layout sidebar'><article><p>kept</p></article></div><div class=comments><article>no</article></div>", "kept"),
        ("<div class=post><p>kept</p></div><div class=comments><article>no</article></div>", "kept"),
        ("<nav><article>no</article></nav><div class='menu-open'><main>kept</main></div>", "kept"),
    ],
)
def test_attributes_of_wrappers_drop_no_article(page, text):
    from veilspan.llm import extraction

    assert extraction.extract(page, extraction.grow(extraction.table())) == text


def test_copies_do_not_shrink_the_sample_of_a_language(spark):
    from veilspan.llm import language

    # 40 texts, one of them very often, and 3 texts of another language, each often
    rows = [("aa", f"alpha{k} beta{k}") for k in range(40)] + [("aa", "alpha0 beta0")] * 400
    rows += [("bb", f"gamma{k} delta{k}") for k in range(3) for _ in range(300)]
    df = spark.createDataFrame(rows, "lang string, text string")
    model = dict(language.train(df, sample=40))
    assert [g for g, _ in language.train(df, sample=40)] == ["bb", "aa"]
    assert len({w for w in model["aa"].split()}) == 2  # letters alone: alpha, beta
    many, chosen = language._sampled(df, "lang", "text", 40)
    assert many == {"aa": 440, "bb": 900}
    assert {r["__lang"]: r["count"] for r in chosen.groupBy("__lang").count().collect()} == {"aa": 40, "bb": 3}


def test_toxicity_stage_learns_from_as_many_rows_as_op1(spark, monkeypatch, tmp_path):
    import corpus_pipeline as cp
    from veilspan.llm import toxicity

    docs = spark.createDataFrame([(k, f"word{k}", "en", "s", 5) for k in range(80)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen, train = [], toxicity.train

    def watched(own, labels, **named):
        seen.append({r["doc_id"] for r in labels.collect()} - {r["doc_id"] for r in own.collect()})
        return train(own, labels, **named)

    monkeypatch.setattr(toxicity, "train", watched)
    cp.reject_toxic(spark, docs, str(tmp_path))
    assert seen == [set()]  # so the limit on labels is one on the rows that are learned
