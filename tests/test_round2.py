"""Pre-tests of recognisers, languages, the model adapter, streams' order, storage."""

import dataclasses
import json
import random

import pytest
from pyspark.sql import functions as F

from veilspan.functions.registered import register
from veilspan.operators import ner
from veilspan.operators.detection import detect
from veilspan.operators.recognizers import registry
from veilspan.plans.engine import Engine
from veilspan.settings import Settings
from veilspan.sources import tables
from veilspan.streaming import streams

SETTINGS = Settings(enable_krs=True)


def _texts(n):
    rnd = random.Random(8)
    parts = ["4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "4111 1111 1111 1111", "PL61109010140000071219812874", "DE89 3704 0044 0532 0130 00", "44051401359", "123-456-32-18", "1234563218", "123456785"]
    parts += ["ABA300000", "ABA 300000", "AA1234567", "WW 12345", "KRA1A23", "00-950", "ul. Polna 1/5", "Aleja Róż 7B", "ur. 01.02.1990", "1990-02-01", "Beta S.A.", "Sigma Sp. z o.o.", "Kappa sp. j.", "Rho spk", "jan@example.pl", "+48 601 234 567", "22 123 45 67", "601 234 567"]
    parts += ["٤٤٠٥١٤٠١٣٥٩", "karta", "nip", "krs 0000123456", "regon", " ", "  ", "-", ".", ",", "\n", "1", "22", "A", "ż"]
    return [rnd.choice(("", " ")).join(rnd.choices(parts, k=rnd.randrange(1, 7))) for _ in range(n)]


def test_pre_tests_lose_no_match(spark):
    df = spark.createDataFrame([(t,) for t in _texts(3000)], "text string").repartition(4)
    for recogniser in registry(SETTINGS):
        if recogniser.possible is None:
            continue
        bare = dataclasses.replace(recogniser, possible=None)
        both = df.select("text", recogniser.candidates(F.col("text"), SETTINGS).alias("a"), bare.candidates(F.col("text"), SETTINGS).alias("b"))
        assert both.where("a <> b").limit(3).collect() == [], recogniser.name


def test_cards_a_digit_at_a_time(spark):
    df = spark.createDataFrame([("karta 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",)], "text string")
    (span,) = detect(df, settings=SETTINGS, labels=["CARD"]).first()["spans"]
    assert (span["start"], span["end"], span["label"], span["score"]) == (6, 37, "CARD", 1.0)


def test_language_of_all_rows_and_of_each(spark):
    polish = [dataclasses.replace(r, languages=("pl",)) if r.name == "email" else r for r in registry(SETTINGS)]
    engine = Engine(SETTINGS, recognisers=polish)
    df = spark.createDataFrame([("mail jan@example.pl", x) for x in ("pl", "en", "EN-us", "de", None)], "text string, lang string")
    n = lambda found: [r[0] for r in found.select(F.size("spans")).collect()]
    assert n(engine.analyze(df, labels=["EMAIL"], language="pl")) == [1] * 5
    assert n(engine.analyze(df, labels=["EMAIL"], language="en")) == [0] * 5
    assert n(engine.analyze(df, labels=["EMAIL"], language=F.col("lang"))) == [1, 0, 0, 1, 1]
    assert n(Engine(SETTINGS).analyze(df, labels=["EMAIL"], language=F.col("lang"))) == [1] * 5
    with pytest.raises(ValueError):
        engine.analyze(df, language="xx")


def test_a_model_takes_part(spark):
    def model(texts):
        for t in texts:
            at = t.find("Anna")
            yield [(at, at + 4, "persName", 0.8), (0, 3, "time", 0.9), (0, 0, "date", 0.5), (2, 999, "orgName", 0.7), (0, 2, "NOSUCH", 0.7)] if at >= 0 else []

    df = spark.createDataFrame([("tu Anna i PESEL",), ("nikt",), (None,)], "text string")
    rows = Engine(SETTINGS, ner=ner.adapter(model)).analyze(df).collect()
    assert [[(s["start"], s["end"], s["label"], s["source"]) for s in r["spans"]] for r in rows] == [[(3, 7, "PERSON", "ner")], [], []]
    assert ner.entity_of("GPE") == "LOCATION" and ner.entity_of("GPE", "pl") is None and ner.entity_of("MONEY") is None


class _State:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_the_vault_puts_before_it_answers():
    import pandas as pd

    vault = streams.VaultProcessor()
    vault.stored = _State()
    put = lambda x: json.dumps({"[A_001]": x})
    frames = [pd.DataFrame({"action": ["get", "put"], "payload": [None, put("b")]}), pd.DataFrame({"action": ["put", "put", "get"], "payload": [put("a"), "{}", None]})]
    for order in (frames, frames[::-1]):
        (out,) = vault.handleInputRows(("s",), iter(order), None)
        assert out["mapping"].tolist() == [put("b")] * 2


def test_the_limiter_orders_hits_over_frames(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(streams, "ANSWERS", 2)
    limiter = streams.LimiterProcessor(2, 60.0)
    limiter.accepted = _State()
    frames = [pd.DataFrame({"hit_id": [3, 1], "at": [50.0, 0.0]}), pd.DataFrame({"hit_id": [2, 4], "at": [1.0, 61.0]})]
    out = pd.concat(list(limiter.handleInputRows(("k",), iter(frames), None)))
    assert out["hit_id"].tolist() == [1, 2, 3, 4] and out["accepted"].tolist() == [True, True, False, True]


def test_letters_as_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT is_iban('PL61 1090 1014 0000 0712 1981 2874'), is_iban('PL61109010140000071219812875'), is_iban('x'), is_iban(NULL), is_dowod('aba 300000'), is_dowod('ABA123456'), is_dowod(NULL)").first()
    assert tuple(row) == (True, False, False, None, True, False, None)


def test_only_small_tables_are_dealt_anew(spark, monkeypatch):
    df = spark.range(100).coalesce(1)
    assert tables.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(tables, "SMALL", 10)
    assert tables.spread(df).rdd.getNumPartitions() == 1


def test_values_with_control_characters_keep_their_tokens(spark):
    from veilspan.plans.queries import STORE

    found = lambda text: F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("PERSON").alias("entity"), F.lit(0.9).alias("score")), F.struct(F.lit(4).alias("start"), F.lit(7).alias("end"), F.lit("PERSON").alias("entity"), F.lit(0.9).alias("score")))
    engine = Engine(SETTINGS, STORE, recognisers=(), ner=found)
    df = spark.createDataFrame([("a\u0001ż óbc",), ("x\u0001y óbc",)], "text string")
    a, b = (r["pseudonyms"] for r in engine.redact(df, profile="linkable").collect())
    assert a[1]["text"] == b[1]["text"] != a[0]["text"] != b[0]["text"]


def test_sessions_of_documents(spark):
    import os

    from veilspan.plans.queries import QUERIES

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("the test tables are not here")
    rows = QUERIES["vault_put"](spark, "/root/testdata/sf0.01").collect()
    want = sum(r["n_tokens"] > 0 for r in QUERIES["anonymize"](spark, "/root/testdata/sf0.01").collect())
    assert len(rows) == want > 0 and len({r["session_id"] for r in rows}) == want
    assert all(len(r["session_id"]) == 32 and str(r["expires_at"]) == "2024-01-15 00:15:00" for r in rows)


def test_log_and_health(spark, tmp_path):
    engine = Engine(SETTINGS)
    found = engine.analyze(spark.createDataFrame([(1, "mail jan@example.pl"), (2, "nic")], "id int, text string"))
    tables.write_log(tables.log_lines(found, "analyze", "spans", "id"), str(tmp_path / "log"))
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "log")).collect())
    assert [json.loads(x) for x in lines] == [{"event": "analyze", "id": 1, "n_spans": 1, "by_label": {"EMAIL": 1}}, {"event": "analyze", "id": 2, "n_spans": 0, "by_label": {}}]
    assert engine.info()["vault"] == "disabled"
    assert engine.info(spark, str(tmp_path / "none"))["vault"] == "unreachable"
    tables.vault_rows(tables.with_session(engine.anonymize(found.drop("spans"))), F.current_timestamp()).write.parquet(str(tmp_path / "vault"))
    assert engine.info(spark, str(tmp_path / "vault"))["vault"] == "connected"
