"""Language ID by compression with per-language zstandard dictionaries.

A language's raw-content dictionary is the commonest words of all its distinct
texts, the commonest last, where matches are cheapest. A text is lower-
cased, everything but letters becomes one space, and the whole of it is compressed
in pieces with each dictionary. The language with the smallest sum is predicted.
The margin to the next is the score; narrow margins are for a caller to reject.
How narrow is told by the margins that texts of the learned languages have with
dictionaries of other texts (`bounds`), for each length class.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import crc_of_id, read, stored, worker_memo

#: Distinct texts of each language that are learned from, unless a caller wants fewer: all.
SAMPLE = math.inf
#: Bytes of a dictionary, and of the pieces that are compressed with it.
DICTIONARY = 65_536
PIECE = 1024
#: Most languages that are learned; more are an error, as every worker holds all
#: dictionaries.
LANGUAGES = 1000
#: Every piece gets so many spaces after it: zstandard looks for no match in a block's
#: last bytes, and stores a block as it is unless it shrinks, as the spaces always do.
SPACES = 64
#: Least bytes of letters of each length class. The bound of a class is SLACK times
#: the QUANTILE of its margins, of FEW margins at least.
CLASSES = (1, 25, 50, 100, 200, 400, 1000)
QUANTILE, SLACK, FEW = 0.05, 0.5, 20
#: Margins are counted in steps of 1 / STEPS, so a class has no more values than that.
STEPS = 100_000
#: Counts that a task holds before it hands them on.
HELD = 200_000
UNKNOWN = "und"

_REST = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """The text's words in lower case, with single spaces between."""
    return _REST.sub(" ", (text or "").lower()).strip().encode("utf-8", "replace")


def commonest(counts, size: int = DICTIONARY) -> list[tuple[bytes, int]]:
    """Of (word, count) those that a dictionary holds, the commonest first, and the one
    at which it is full: with that one, the commonest of parts give those of the whole."""
    out, left = [], size
    for word, n in sorted(counts, key=lambda x: (-x[1], x[0])):
        out.append((word, n))
        left -= len(word) + 1
        if left < 0:
            break
    return out


def content(counts, size: int = DICTIONARY) -> bytes:
    """The dictionary of (word, count)."""
    words = [w for w, _ in commonest(counts, size)]
    if sum(len(w) + 1 for w in words) > size:
        words.pop()
    return b" ".join(reversed(words)) + b" "


def dictionary(texts: list[str | None], size: int = DICTIONARY) -> bytes:
    from collections import Counter

    return content(Counter(w for t in texts for w in letters(t).split()).items(), size)


def compressor(content: bytes):
    import zstandard as z

    way = z.ZstdCompressionParameters(
        window_log=17, chain_log=16, hash_log=17, search_log=6, min_match=4, target_length=16, strategy=z.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=way)
    return z.ZstdCompressor(compression_params=way, dict_data=d)


def classify(data: bytes, compressors: list[tuple[str, object]]) -> tuple[str, float]:
    """(language, margin) of a text's letters; ties go to the earlier language."""
    if not data.strip() or not compressors:
        return UNKNOWN, 0.0
    pieces = [data[k : k + PIECE] + b" " * SPACES for k in range(0, len(data), PIECE)]
    sizes = [sum(len(c.compress(p)) for p in pieces) for _, c in compressors]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    if len(sizes) == 1:
        return compressors[0][0], 1.0
    second = min(s for k, s in enumerate(sizes) if k != best)
    return compressors[best][0], (second - sizes[best]) / second


def length_class(size: int) -> int:
    return max(0, bisect_right(CLASSES, size) - 1)


def fragments(data: bytes) -> list[bytes]:
    """The text's letters, and runs of its words of every shorter length class."""
    out = [data]
    for low, high in pairwise(CLASSES):
        for part in (0, 1, 2):
            # from a word's beginning to a word's end
            at = data.find(b" ", len(data) * part // 3) + 1 if part else 0
            piece = data[at : at + (low + high) // 2 + 1].rpartition(b" ")[0]
            if low <= len(piece) < high:
                out.append(piece)
    return out


def _sampled(docs: DataFrame, lang: str, text: str, sample: float) -> tuple[dict[str, int], DataFrame]:
    """Rows of each language, and the distinct texts that are learned from."""
    d = docs.select(F.col(lang).alias("__lang"), F.col(text).alias("__text")).where("__lang is not null and __text is not null")
    d = d.withColumn("__order", F.xxhash64("__text"))
    whole = sample == math.inf
    if whole:
        many = d.groupBy("__lang").agg(F.count(F.lit(1)).alias("__n"))
    else:
        # equal texts are one, as they are when they are learned from
        each = d.groupBy("__lang", "__order").agg(F.count(F.lit(1)).alias("__n"))
        many = each.groupBy("__lang").agg(F.sum("__n").alias("__n"), F.count(F.lit(1)).alias("__m"))
    rows = many.limit(LANGUAGES + 1).collect()  # one row a language
    if not rows:
        return {}, d
    if len(rows) > LANGUAGES:
        raise ValueError(f"{len(rows)} languages, but {LANGUAGES} at most are learned")
    if whole:
        return {r["__lang"]: r["__n"] for r in rows}, d.distinct()
    share = F.pmod("__order", F.lit(1 << 40)).cast("double") / float(1 << 40)
    counts = d.sparkSession.createDataFrame([(r["__lang"], r["__m"]) for r in rows], "__lang string, __m long")
    # a row a language, which the driver has just held: texts are not shuffled to meet it
    chosen = d.join(F.broadcast(counts), "__lang").where(share * F.col("__m") < sample).select("__lang", "__text", "__order").dropDuplicates(["__lang", "__order"])
    return {r["__lang"]: r["__n"] for r in rows}, chosen


def _word_counts(frames):
    """Words of texts, counted by language and half."""
    from collections import Counter

    import pandas as pd

    def told():
        return pd.DataFrame([(*k, w, n) for k, c in counts.items() for w, n in c.items()], columns=["lang", "half", "word", "n"])

    counts, held = {}, 0
    for frame in frames:
        for own, half, body in zip(frame["__lang"], frame["__half"], frame["__text"], strict=True):
            c = counts.setdefault((own, half), Counter())
            held -= len(c)
            c.update(letters(body).split())
            held += len(c)
            if held >= HELD:
                yield told()
                counts, held = {}, 0
    if counts:
        yield told()


def _kept(rows):
    import pandas as pd

    best = {}
    for lang, part, word, n in rows:
        own = best.setdefault((lang, part), [])
        own.append((bytes(word), n))
        if len(own) >= 2 * DICTIONARY:
            best[lang, part] = commonest(own)
    return pd.DataFrame([(*k, w, n) for k, c in best.items() for w, n in commonest(c)], columns=["lang", "part", "word", "n"])


def _commonest_of_part(frames):
    """The commonest words of both halves (0, 1) and of the whole (2) in a partition."""
    rows = (r for f in frames for r in zip(f["lang"], f["word"], f["n0"], f["n1"], strict=True))
    yield _kept((lang, part, word, n) for lang, word, a, b in rows for part, n in ((0, a), (1, b), (2, a + b)) if n)


def _commonest_again(frames):
    yield _kept(r for f in frames for r in zip(f["lang"], f["part"], f["word"], f["n"], strict=True))


def _content_of(rows):
    import pandas as pd

    made = content(zip(map(bytes, rows["word"]), rows["n"], strict=True))
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "part": [rows["part"].iloc[0]], "content": [made]})


def _halved(chosen: DataFrame) -> DataFrame:
    return chosen.select("__lang", "__text", F.pmod(F.shiftright("__order", 40), F.lit(2)).cast("int").alias("__half"))


def _dictionaries(halved: DataFrame, only_whole: bool = False) -> tuple[dict[str, bytes], ...]:
    """Dictionaries by language of the texts of each half, if asked for, and of all."""
    n = lambda k: F.sum(F.when(F.col("half") == k, F.col("n")).otherwise(0))
    words = halved.mapInPandas(_word_counts, "lang string, half int, word binary, n long").groupBy("lang", "word").agg(n(0).alias("n0"), n(1).alias("n1"))
    kind = "lang string, part int, word binary, n long"
    if only_whole:
        best = words.select("lang", F.lit(2).alias("part"), "word", (F.col("n0") + F.col("n1")).alias("n")).mapInPandas(_commonest_again, kind)
    else:
        best = words.mapInPandas(_commonest_of_part, kind)
    # again in fewer parts, so that what meets for a language grows with the root of the parts
    parts = math.isqrt(int(halved.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    best = best.repartition(parts).mapInPandas(_commonest_again, kind)
    rows = best.groupBy("lang", "part").applyInPandas(_content_of, "lang string, part int, content binary").collect()
    return tuple({r["lang"]: bytes(r["content"]) for r in rows if r["part"] == k} for k in range(3))


def _ordered(found: dict[str, bytes], many: dict[str, int]) -> list[tuple[str, bytes]]:
    # a language whose texts have no letters has a dictionary without words
    return [(g, found.get(g, dictionary([]))) for g in sorted(many, key=lambda g: (-many[g], g))]


def train(docs: DataFrame, lang: str = "lang", text: str = "text", sample: float = SAMPLE) -> list[tuple[str, bytes]]:
    """(language, dictionary content), the language with most documents first.

    Rows with a null text or lang take no part; equal texts of a language are one.
    All others are learned from, unless `sample` says that about so many of each
    language are enough, those whose hashes are least.
    """
    many, chosen = _sampled(docs, lang, text, sample)
    return _ordered(_dictionaries(_halved(chosen), only_whole=True)[2], many) if many else []


def bounds(docs: DataFrame, lang: str = "lang", text: str = "text", sample: float = SAMPLE) -> dict[tuple[str, int], float]:
    """(language, length class): the margin below which a text is not of it."""
    return learn(docs, lang, text, sample)[1]


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", sample: float = SAMPLE) -> tuple[list[tuple[str, bytes]], dict[tuple[str, int], float]]:
    """What `train` and `bounds` give, with the distinct texts made once.

    For the bounds the texts that are learned from are halved. Those of each half,
    whole and in fragments, are classified with dictionaries of the other half, so no
    margin owes anything to a text's own words. Classes with few margins have none.
    """
    many, chosen = _sampled(docs, lang, text, sample)
    if not many:
        return [], {}
    halved = stored(_halved(chosen), "language-texts")
    *halves, whole = _dictionaries(halved)
    # texts of a half meet the dictionaries of the other
    held = docs.sparkSession.sparkContext.broadcast([sorted(halves[1 - k].items()) for k in (0, 1)])

    def measure(frames):
        from collections import Counter

        import pandas as pd

        def told():
            return pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["lang", "class", "step", "n"])

        ways = [[(g, compressor(body)) for g, body in model] for model in held.value]
        known = [{g for g, _ in way} for way in ways]
        counts = Counter()
        for frame in frames:
            for own, body, half in zip(frame["__lang"], frame["__text"], frame["__half"], strict=True):
                if len(ways[half]) < 2 or own not in known[half]:
                    continue
                for x in fragments(letters(body)):
                    if x:
                        name, margin = classify(x, ways[half])
                        counts[name, length_class(len(x)), round(margin * STEPS)] += 1
                if len(counts) >= HELD:
                    yield told()
                    counts.clear()
        if counts:
            yield told()

    rows = halved.mapInPandas(measure, "lang string, class int, step int, n long")
    low = F.percentile(F.col("step"), F.lit(QUANTILE), F.col("n")) / STEPS
    found = rows.groupBy("lang", "class").agg(low.alias("low"), F.sum("n").alias("n"))
    return _ordered(whole, many), {(r["lang"], r["class"]): SLACK * r["low"] for r in found.where(F.col("n") >= FEW).collect()}


def least_margin(narrow: dict[tuple[str, int], float], lang: str, size: int) -> float:
    """The bound of a language and length class; where there is none, that of the
    language's nearest class, else of any language's nearest, else 0."""
    own = length_class(size)
    known = [(abs(c - own), c, v) for (g, c), v in narrow.items() if g == lang] or [(abs(c - own), c, v) for (_, c), v in narrow.items()]
    return min(known)[2] if known else 0.0


def classifier(spark: SparkSession, model: list[tuple[str, bytes]], narrow: dict[tuple[str, int], float] | None = None):
    """A function of a text column: struct (lang, margin, size of the letters, least
    margin of a text of this language and length as `narrow` has it; 0 without)."""
    # one dictionary of DICTIONARY bytes a language, LANGUAGES at most
    held = spark.sparkContext.broadcast((model, narrow or {}))

    def run(column):
        import pandas as pd

        model, narrow = held.value
        memo, key = worker_memo(), ("languages", hash(tuple(model)))
        if key not in memo:
            memo[key] = [(lang, compressor(content)) for lang, content in model]
        out, least = [], {}
        for text in column:
            data = letters(text)
            lang, margin = classify(data, memo[key])
            known = lang, length_class(len(data))
            if known not in least:
                least[known] = least_margin(narrow, lang, len(data))
            out.append((lang, margin, len(data), least[known]))
        return pd.DataFrame(out, columns=["lang", "margin", "size", "least"])

    udf = F.pandas_udf(run, "lang string, margin double, size long, least double")

    def of(text: Column) -> Column:
        return udf(text)

    return of


def accepted(found: Column) -> Column:
    """False for texts without letters and for texts with narrow margins."""
    return (found["lang"] != UNKNOWN) & (found["margin"] >= found["least"])


def identify(docs: DataFrame, train_docs: DataFrame, text: str = "text", name: str = "language") -> DataFrame:
    """docs with the struct column `name` (lang, margin, size, least); one of that
    name is replaced. Null texts and texts without letters are `und` with margin 0; texts
    that no dictionary tells apart go to the language with most documents.
    Without any labelled row all are `und`. An empty table stays empty.
    """
    return docs.withColumn(name, classifier(docs.sparkSession, *learn(train_docs))(F.col(text)))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.pmod(crc_of_id(), F.lit(5)) == 0
    # all margins are given, so none needs a bound
    found = docs.withColumn("found", classifier(spark, train(docs.where(~held_out)))(F.col("text")))
    return found.select("doc_id", held_out.alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.margin").alias("score"))
