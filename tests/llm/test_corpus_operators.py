"""Operators against brute force, and on nulls, empty and long texts, ties, repeats,
empty tables and clashing column names."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from veilspan.llm import components, embedding_dedup, extraction, language, mixing, packing, search, sharding, simhash, token_counts, toxicity  # noqa: E402
from veilspan.llm.pretokens import vocabulary  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, fp string, row string, copies string, slot string"


def _docs(spark, texts, source="s"):
    rows = [(i if i != 3 else None, t, "en", f"{source}{i % 3}" if i % 7 else None, 0, "x", "x", "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def _texts(n=60, seed=1):
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "d'or", "étang", "123", "zz--", "naïve", "<|endoftext|>", "x_y", "中文", "ﬁn"]
    texts = [" ".join(rnd.choices(words, k=rnd.randrange(0, 40))) for _ in range(n)]
    return [None, "", " \t\n", *texts, texts[0], texts[0], "long " * 40_000, "don't 's '' x\x1cy"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))


# 5 and 7: tokens


def test_ids_are_the_library_s(library):
    rnd = random.Random(2)
    texts = ["".join(chr(rnd.choice((rnd.randrange(1, 0x250), rnd.randrange(0x250, 0x3000)))) for _ in range(30)) for _ in range(400)]
    texts += [t or "" for t in _texts()]
    got = vocabulary().ids(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(spark, library):
    texts = _texts()
    rows = token_counts.count_tokens(_docs(spark, texts).repartition(3)).collect()
    want = Counter((None if i == 3 else i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts))
    assert Counter(map(tuple, rows)) == want
    assert token_counts.count_tokens(_docs(spark, texts).limit(0)).collect() == []


def test_packing(spark, library):
    texts = _texts(200, 3)
    rows = packing.pack(_docs(spark, texts).repartition(3)).collect()
    ids = {i if i != 3 else None: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    pieces = {(r["doc_id"], r["piece"]): r for r in rows}
    assert len(pieces) == len(rows) == sum(-(-len(v) // 2048) for v in ids.values())
    sequences = defaultdict(list)
    for (doc, k), r in pieces.items():
        part = ids[doc][2048 * k : 2048 * k + 2048]
        assert (r["start"], r["length"], r["ids_crc32"]) == (2048 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(map(len, ids.values())) // 2048) + 1
    assert packing.pack(_docs(spark, texts).limit(0)).collect() == []


def test_plan_is_near_the_bound_and_complete():
    rnd = random.Random(5)
    for histogram in ({2048: 3}, {1: 5000}, {1500: 7, 548: 7}, {1025: 9}, dict(Counter(min(2048, int(rnd.paretovariate(1) * 90)) for _ in range(20_000)))):
        configs = packing.plan(dict(histogram), steps=300)
        assert all(sum(c) <= 2048 and k > 0 for c, k in configs)
        assert sum((Counter({x: m * k for x, m in Counter(c).items()}) for c, k in configs), Counter()) == Counter(histogram)
        n, bound = sum(k for _, k in configs), -(-sum(x * m for x, m in histogram.items()) // 2048)
        assert n <= max(bound * 1.005 + 1, histogram.get(1025, 0))
    assert packing.plan({}) == []


# 3: SimHash


def _fingerprint(text):
    xxhash = pytest.importorskip("xxhash")
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def _groups(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                up[find(i)] = find(j)
    return [find(i) for i in range(n)]


def test_fingerprints():
    for t in [*_texts(), "ÀA B", "a\x85b c\xa0d e", "one two three four", "a b c"]:
        assert simhash.fingerprint(t) == _fingerprint(t)


def test_simhash_components(spark):
    rnd = random.Random(7)
    base = ["".join(rnd.choices("abcdefgh ", k=900)) for _ in range(12)]
    near = [b[:k] + "q" + b[k:] for b in base for k in (5, 300, 880)]
    texts = [None, "", *base, *near, *base[:4]]
    rows = simhash.near_duplicates(_docs(spark, texts)).select("doc_id", "fp", "component_id").collect()
    fps = [_fingerprint(t) for t in texts]
    ids = [None if i == 3 else i for i in range(len(texts))]
    group = _groups(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    least = {g: min((i for i, h in zip(ids, group, strict=True) if h == g and i is not None), default=None) for g in group}
    want = Counter((i, f - (1 << 64) if f >> 63 else f, least[g]) for i, f, g in zip(ids, fps, group, strict=True))
    assert Counter(map(tuple, rows)) == want and len(set(group)) < len(texts) - 10
    assert simhash.near_duplicates(_docs(spark, texts).limit(0)).collect() == []


@pytest.mark.parametrize("blocks", [5, 6, 8])
def test_forest_loses_no_link(spark, monkeypatch, blocks):
    monkeypatch.setattr(simhash, "SHARD", 16)
    rnd = random.Random(11)
    seeds = [rnd.getrandbits(64) for _ in range(25)] + [0]
    fps = sorted({s ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(6))) & ((1 << 64) - 1) for s in seeds for _ in range(12)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = dict(map(tuple, components.components(simhash.forest(df, blocks=blocks)).collect()))
    group = _groups(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    mine = [roots.get(f, f) for f in signed]
    assert len(set(zip(mine, group, strict=True))) == len(set(mine)) == len(set(group))


def test_tree_children_are_keyed_by_distance():
    rnd = np.random.default_rng(3)
    bits = np.unique(rnd.integers(0, 1 << 20, 400).astype("u8"))
    shard = np.sort(rnd.integers(0, 3, len(bits)))
    trees = simhash.Trees(shard, bits)
    for child, key in zip(trees.child, trees.key, strict=True):
        if key >= 0:
            assert (int(bits[child]) ^ int(bits[key // 65])).bit_count() == key % 65 and shard[child] == shard[key // 65]
    got = {(int(a), int(b)) for x, y in trees.links(3) for a, b in zip(x, y, strict=True)}
    assert got == {(i, j) for i in range(len(bits)) for j in range(i) if shard[i] == shard[j] and (int(bits[i]) ^ int(bits[j])).bit_count() <= 3}


def test_components_of_a_long_path(spark):
    path = [(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1000), (7, 7)]
    roots = dict(map(tuple, components.components(spark.createDataFrame(path, "a long, b long")).collect()))
    assert len({roots[k] for k in range(301)}) == 1 and roots[1000] == roots[1001] != roots[0] and len(roots) == 303


# 2 and 4: vectors


def _vectors(spark, n=150, d=8, seed=0, kind="float"):
    rnd = np.random.default_rng(seed)
    m = rnd.normal(size=(n, d))
    m[n // 2 :] = m[: n - n // 2] + rnd.normal(size=(n - n // 2, d)) * rnd.choice([0.0, 0.02, 0.12, 0.16, 0.6], size=(n - n // 2, 1))
    rows = [(int(i), [float(x) for x in np.float32(v)]) for i, v in enumerate(m)]
    rows += [(1000, None), (1001, [0.0] * d), (1002, [float("nan")] * d), (1003, [1.0, None] + [0.0] * (d - 2)), (1004, [1.0, 2.0]), (1100, [1.0, 2.0]), (None, rows[0][1]), (5, rows[5][1]), (1005, []), (1006, [float("inf")] * d)]
    return rows, spark.createDataFrame([(*r, "x", 0.0) for r in rows], f"vec_id long, embedding array<{kind}>, n_links string, score double")


def _good(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embedding_links(spark, kind):
    rows, df = _vectors(spark, kind=kind)
    got = embedding_dedup.near_duplicates(df.repartition(3), tile=40).collect()
    ok = [i is not None and _good(v) and any(v) for i, v in rows]

    def linked(i, j):
        if i == j or not (ok[i] and ok[j]) or len(rows[i][1]) != len(rows[j][1]):
            return False
        a, b = np.array(rows[i][1]), np.array(rows[j][1])
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95

    n = Counter()
    for i in range(len(rows)):
        n[rows[i][0]] += sum(linked(i, j) for j in range(len(rows)))
    names = sorted({i for i, _ in rows if i is not None})
    same = {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(len(rows)) if linked(i, j)}
    group = _groups(len(names), lambda i, j: (names[i], names[j]) in same)
    least = {i: min(names[k] for k in range(len(names)) if group[k] == g) for i, g in zip(names, group, strict=True)}
    want = Counter((i, n[i] if i is not None else 0, least.get(i), i == least.get(i)) for i, _ in rows)
    assert Counter(map(tuple, got)) == want
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_quantisation_bounds_hold():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(300, 16)) * rnd.lognormal(size=(300, 1), sigma=3)
    t = embedding_dedup.Tile(np.arange(300), x)
    exact = t.unit @ t.unit.T
    approx = (t.q.astype(float) @ t.q.T.astype(float)) * t.scale[:, None] * t.scale
    bound = t.error[:, None] * (t.size + t.error) + t.size[:, None] * t.error
    assert (np.abs(exact - approx) <= bound).all()


@pytest.mark.parametrize("at_once", [3, 100])
def test_search(spark, at_once):
    rows, df = _vectors(spark)
    got = search.top_k(df.repartition(3), F.pmod("vec_id", F.lit(5)) == 0, queries_at_once=at_once).collect()
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and _good(v)]
    want = Counter()
    for a, (q, v) in enumerate(whole):
        if q % 5 == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), c) for b, (c, w) in enumerate(whole) if a != b and len(w) == len(v))
            want.update((q, k, c, -s) for k, (s, c) in enumerate(scores[:10], 1))
    assert Counter(map(tuple, got)) == want
    assert search.top_k(df.limit(0), F.lit(True)).collect() == []


def test_search_of_huge_components_stays_exact():
    q, rows = np.array([2.0**40, 3.0]), np.array([[2.0**20, 5.0], [-(2.0**60), 0.0]])
    assert search._exact(q, rows).tolist() == [2**60 + 15, -(2**63) + 1]


def test_search_reads_few_exact_vectors():
    rnd = np.random.default_rng(0)
    rows = np.floor(rnd.normal(size=(4000, 64)) * 128)
    low, width = rows.min(0), (rows.max(0) - rows.min(0)) / 256
    cells = np.minimum((rows - low) / width, 255).astype(np.uint8)
    best = [search.Best(10) for _ in range(20)]
    reads = search.search_block(rows[:20], best, np.arange(4000), low, width, cells, rows)
    assert reads < 20 * 300
    for q, b in zip(rows[:20], best, strict=True):
        scores = (rows @ q).astype(np.int64)
        assert b.ids.tolist() == np.lexsort((np.arange(4000), -scores))[:10].tolist()


# 1 and 9: classifiers


def test_toxicity(spark):
    rnd = random.Random(4)
    clean = [" ".join("".join(rnd.choices("abcde", k=4)) for _ in range(40)) for _ in range(600)]
    toxic = [i % 4 == 0 for i in range(600)]
    texts = [t + " you rotten fool " if y else t for t, y in zip(clean, toxic, strict=True)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x"), (900, "", "x"), (901, "word " * 50_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic) if i < 450] + [(None, 1), (3, None), (7, 0)], "doc_id long, toxic int")
    rows = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(df, df, labels).collect()}
    assert all((rows[i] >= 0.3) == toxic[i] for i in range(450, 600))
    assert all(0 <= s <= 1 for s in rows.values()) and rows[None] == rows[900] < 0.5
    again = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(df.repartition(5), df.repartition(2), labels).collect()}
    assert rows == again
    assert toxicity.score_toxicity(df.limit(0), df, labels).collect() == []
    nothing = toxicity.score_toxicity(df.limit(5), df, labels.limit(0)).collect()
    assert {r["score"] for r in nothing} == {0.5}
    places, weights, _ = toxicity.fit(texts, [int(y) for y in toxic])
    assert 0 < len(places) < 2000 and (weights != 0).all()


def test_language(spark):
    rnd = random.Random(6)
    vocab = {g: ["".join(rnd.choices(a, k=rnd.randrange(5, 11))) for _ in range(300)] for g, a in (("aa", "abcdefghijklm"), ("bb", "ghijklmnopqrs"), ("cc", "nopqrstuvwxyz"))}
    rows = [(i, " ".join(rnd.choices(vocab[g], k=60)), g, "x") for i, g in enumerate(list(vocab) * 60)]
    df = spark.createDataFrame([*rows, (None, None, "aa", "x"), (999, "12 !! ", None, "x"), (998, "", "bb", "x"), (997, "abc " * 50_000, None, "x")], "doc_id long, text string, lang string, found string")
    found = {r["doc_id"]: r["found"] for r in language.identify(df, df.where("doc_id % 2 = 0"), name="found").collect()}
    assert all(found[i]["lang"] == g for i, _, g, _ in rows)
    assert found[None]["lang"] == found[999]["lang"] == found[998]["lang"] == "und" and found[999]["margin"] == 0
    assert all(0 <= f["margin"] <= 1 for f in found.values())
    kept = language.identify(df, df, name="found").where(language.accepted(F.col("found"))).count()
    assert kept == 180  # one word over and over has no margin
    assert {r["found"]["lang"] for r in language.identify(df, df.limit(0), name="found").collect()} == {"und"}
    assert language.identify(df.limit(0), df).collect() == []
    same = [("x", object())]
    assert language.classify(b"", same) == ("und", 0.0)


# 10: HTML

TREE = extraction.grow(extraction.table())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<article><h1>A &amp; B</h1><p>One&nbsp;two\n three<br>four</p><p>x</article>", "A & B\n\nOne two three four\n\nx"),
        ("<nav><a href=/>Home</a></nav><div class='ad'>Buy now this thing please</div><article><p>Text</p></article><footer>&copy; x</footer>", "Text"),
        ("<article><header><h1>T</h1></header><p>a</p><aside>Side words are here</aside><form>Mail <input> <button>Go</button></form><div class='comments'><article>I say so</article></div><p>b</p></article>", "T\n\na\n\nb"),
        ("<header><h1>Site name</h1></header><main><p>Body</p></main>", "Body"),
        ("<div id=cookie-notice><p>We use cookies to make this better for all of you here</p></div><main>Body</main>", "Body"),
        ("<article><p>a<script>var t='</p>';</script>b</p><style>p{}</style><p>c &lt;b&gt; &#233;</p></article>", "ab\n\nc <b> é"),
        ("<article><p>un<b>bro</b>ken <!-- no --> word<p hidden>no</p></article>", "unbroken word"),
        ("<div class=sidebar>" + "many words of a side bar that look like prose " * 5 + "</div>", ""),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("<article><p title='a>b'>x</p><p class=\"q>r\">y</p></article>", "x\n\ny"),
    ],
)
def test_main_text(page, text):
    assert extraction.extract(page, TREE) == text


def test_extraction_frame(spark):
    df = spark.createDataFrame([(1, "u", "<main>x 😀</main>", "clash"), (1, "u", None, "clash")], "page_id long, url string, html string, text string")
    rows = extraction.main_text(df).collect()
    assert [r["text"] for r in rows] == ["x 😀", ""]
    assert extraction.main_text(df.limit(0)).collect() == []


def test_tree_fits_its_table():
    assert all(extraction.kept(TREE, tuple(r[:-1])) == bool(r[-1]) for r in extraction.table())


# 6: sharding


def test_lookup_table():
    names = [f"s{n}" for n in range(7)]
    table = sharding.lookup_table(names, 211)
    counts = Counter(table)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 211)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 211 * 0.3
    for bad in ((names, 210), ([], 211), (["a", "a"], 211)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placement(spark, tmp_path):
    docs = _docs(spark, _texts())
    rows = sharding.place(docs).collect()
    table = sharding.lookup_table()
    assert len(rows) == docs.count()
    for r in rows:
        slot = sharding._number("" if r["doc_id"] is None else str(r["doc_id"])) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, sharding.SHARDS[table[slot]])
    assert sharding.place(docs.limit(0)).collect() == []
    sharding.write_shards(docs.select("doc_id", "source"), str(tmp_path / "out"), shards=("a", "b"), slots=101)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


# 8: mixing


def _targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    budget, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        level = (budget - sum(full.values())) / max(1, sum(w[s] for s in rest))
        above = [s for s in rest if level * w[s] >= 2 * sizes[s]]
        if not above:
            return full | {s: level * w[s] for s in rest}
        full |= {s: 2.0 * sizes[s] for s in above}


def test_mixing(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice(["a", "b", "b", "b", "c", "d", None]), rnd.randrange(0, 60)) for i in range(900)]
    rows += [(None, "b", 5), (None, None, 5), (7, "a", 3), (7, "a", 3), (8000, "zero", 0), (8001, "one", 10)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, size long, u string")
    out = mixing.mix(df.repartition(3)).collect()
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = _targets(dict(sizes))
    assert len(out) == len(rows)
    taken = Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and r["copies"] in (0, 1, 2)
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - want[s]) <= max(n for _, x, n in rows if x == s) / 2 + 1e-6 for s in want)
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["copies"])
    assert sorted(map(key, out)) == sorted(map(key, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mix(df.limit(0)).collect() == []


def test_mixing_runs_no_python(spark):
    plan = mixing.mix(spark.createDataFrame([(1, "a", 3)], "doc_id long, source string, size long"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
