"""Redaction, round trips, wire forms, pseudonyms, keys."""

import base64
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from veilspan.functions import crypto
from veilspan.functions.canonical import canonical
from veilspan.operators import transforms as tf
from veilspan.plans.engine import Engine
from veilspan.settings import Settings

STORE = crypto.KeyStore({"v1": b"\x11" * 32, "v2": b"\x22" * 32})
ENGINE = Engine(Settings(enable_krs=True, hash_salt="salt"), STORE)
TEXT = "PESEL 44051401359 oraz email jan@example.pl. Powtórka: 44051401359."


def _one(spark, text, **options):
    return ENGINE.redact(spark.createDataFrame([(text,)], "text string"), **options).first()


def test_replace_mask_hash(spark):
    assert _one(spark, TEXT)["redacted_text"] == "PESEL <PESEL> oraz email <EMAIL>. Powtórka: <PESEL>."
    assert _one(spark, "PESEL 44051401359", mode="mask")["redacted_text"] == "PESEL ***********"
    row = _one(spark, "PESEL 44051401359", mode="hash")
    assert row["redacted_text"] == "PESEL 3ea21daef2002018" and row["privacy"]["deprecated_hash"]
    assert _one(spark, "PESEL 44051401359", mode="mask", profile="strict")["redacted_text"] == "PESEL <PESEL>"
    assert _one(spark, None)["redacted_text"] is None and _one(spark, "")["redacted_text"] == ""
    with pytest.raises(ValueError):
        tf.resolve_profile("nope")
    with pytest.raises(ValueError):
        tf.resolve_profile(mode="nope")


def test_anonymize_and_restore(spark):
    df = spark.createDataFrame([(TEXT,), ("[PESEL_009] nic",), (None,)], "text string")
    out = ENGINE.restore(ENGINE.anonymize(df), "anonymized_text").collect()
    assert out[0]["anonymized_text"] == "PESEL [PESEL_001] oraz email [EMAIL_001]. Powtórka: [PESEL_001]."
    assert out[0]["mapping"] == {"[PESEL_001]": "44051401359", "[EMAIL_001]": "jan@example.pl"}
    assert [r["restored_text"] for r in out] == [TEXT, "[PESEL_009] nic", None]
    session = _one(spark, TEXT, profile="session")
    assert session["redacted_text"] == out[0]["anonymized_text"] and session["privacy"]["reversible"]


def test_restore_is_one_pass(spark):
    df = spark.createDataFrame([("[A_001][B_001] [C_001]", {"[A_001]": "[B_001]", "[B_001]": "x"})], "text string, mapping map<string,string>")
    assert ENGINE.restore(df).first()["restored_text"] == "[B_001]x [C_001]"
    with pytest.raises(ValueError):
        ENGINE.restore(df, mapping=None)


def test_vault(spark):
    vault = spark.createDataFrame([("s1", {"[A_001]": "old", "[B_001]": "b"}, 2000), ("s2", {"[A_001]": "gone"}, 500)], "session_id string, mapping map<string,string>, at int")
    vault = vault.select("session_id", "mapping", F.timestamp_seconds("at").alias("expires_at"))
    asked = spark.createDataFrame([("s1", {"[A_001]": "new"}), ("s2", None), ("s3", None)], "session_id string, mapping map<string,string>").withColumn("text", F.lit("[A_001] [B_001]"))
    out = ENGINE.restore(asked, vault=vault, now=F.timestamp_seconds(F.lit(1000))).select("session_id", "restored_text").collect()
    assert dict(map(tuple, out)) == {"s1": "new b", "s2": "[A_001] [B_001]", "s3": "[A_001] [B_001]"}


def test_vault_rows(spark):
    from veilspan.sources.tables import vault_rows, with_session

    df = with_session(ENGINE.anonymize(spark.createDataFrame([(TEXT,), ("nic",)], "text string")))
    rows = vault_rows(df, F.timestamp_seconds(F.lit(0))).collect()
    assert len(rows) == 1 and len(rows[0]["session_id"]) == 32 and rows[0]["expires_at"].timestamp() == 900


def test_given_results(spark):
    df = spark.createDataFrame([("PESEL 44051401359 mail a@b.pl", [("PESEL", 6, 17), ("EMAIL_ADDRESS", 23, 29), ("OWN", 0, 5), ("X", 40, 50), ("X", 3, 3)])], "text string, analyzer_results array<struct<entity_type:string,start:int,end:int>>")
    out = ENGINE.apply_results(df).first()["anonymized"]
    assert out["text"] == "<OWN> <PESEL> mail <EMAIL>"
    assert [(i["entity_type"], i["start"], i["end"]) for i in out["items"]] == [("OWN", 0, 5), ("PESEL", 6, 13), ("EMAIL", 23, 30)]


def test_entity_wire(spark):
    df = spark.createDataFrame([(TEXT,)], "text string")
    assert ENGINE.analyze_entities(df, entities=["US_SSN"]).first()["results"] == []
    out = ENGINE.analyze_entities(df, entities=["EMAIL_ADDRESS"]).first()["results"]
    assert [(r["entity_type"], r["start"], r["end"]) for r in out] == [("EMAIL", 29, 43)]
    tags = spark.createDataFrame([("en-US",), ("de",), ("",), (None,), (" PL ",)], "t string").select(tf.coerced_language(F.col("t"))).collect()
    assert [t[0] for t in tags] == ["en", "pl", "pl", "pl", "pl"]


def test_known_tokens(spark):
    known = [
        ("v1", "eval", "_", "PESEL", "44051401359", "PESEL_v1_fzzu_5G20GpoNQQlp3ZH"),
        ("v1", "logs", "_", "PESEL", "44051401359", "PESEL_v1_XGPvBJJN6-rUTG3zQo_z"),
        ("v2", "eval", "_", "PESEL", "44051401359", "PESEL_v2_eTfHpnQFeCrpGZzI6eeL"),
        ("v1", "eval", "_", "NIP", "1234563218", "NIP_v1_ghXGz06HZxmAarmaoiL-"),
        ("v1", "llm-gateway", "acme", "PESEL", "44051401359", "PESEL_v1_mblqjBAl6rbWcx1ArW32"),
    ]
    for kid, purpose, tenant, label, value, token in known:
        row = ENGINE.redact(spark.createDataFrame([(f"{label} {value}",)], "text string"), profile="linkable", purpose=purpose, tenant=tenant, key_id=kid).first()
        assert row["redacted_text"] == f"{label} {token}"
        assert row["stats"]["pseudonymised"] == 1 and row["stats"]["by_label"] == {label: 1}
    assert STORE.derive("v1", "eval", "_").hex() == "dabed208c5cd8a3bd7c06fb0ae4a36f1d1897541aca679e16ed76734e615593f"


def test_linking_is_canonical_and_strict_profile(spark):
    a = _one(spark, "tel. +48 601 234 567, ur. 01.02.1990", profile="linkable_strict")
    b = _one(spark, "tel. 601234567", profile="linkable")
    assert a["redacted_text"].split(",")[0] == b["redacted_text"] and "<DOB>" in a["redacted_text"]
    assert a["stats"]["replaced_fallback"] == 1


def test_tenants_by_row(spark):
    df = spark.createDataFrame([("PESEL 44051401359", "a"), ("PESEL 44051401359", "b"), ("PESEL 44051401359", "a")], "text string, tenant string")
    out = [r[0] for r in ENGINE.redact(df, profile="linkable", tenants=["a", "b"]).select("redacted_text").collect()]
    assert len(set(out)) == 2
    plan = ENGINE.redact(df, profile="linkable", tenants=["a", "b"])._jdf.queryExecution().toString()
    assert STORE.derive("v1", "default", "a").hex() not in plan.lower()
    with pytest.raises(Exception, match="unknown tenant"):
        ENGINE.redact(df, profile="linkable", tenants=["a"]).collect()


def test_already_tokens_stay(spark):
    from veilspan.operators.pseudonyms import linkable

    df = spark.createDataFrame([("x NIP_v1_ghXGz06HZxmAarmaoiL- y", [(2, 29, "NIP", 1.0, "NIP_v1_ghXGz06HZxmAarmaoiL-", "pattern")])], "text string, spans array<struct<start:int,end:int,label:string,score:double,text:string,source:string>>")
    row = linkable(df, STORE).first()
    assert row["redacted_text"] == "x NIP_v1_ghXGz06HZxmAarmaoiL- y" and row["stats"]["pseudonymised"] == 0


def test_fails_closed_and_purposes():
    bare = Engine(Settings())
    assert bare.info()["pseudonym"] == {"enabled": False}
    with pytest.raises(crypto.KeystoreError):
        bare.redact(None, profile="linkable")
    with pytest.raises(ValueError):
        Engine(Settings(allowed_purposes="a, b"), STORE).purpose("c")
    with pytest.raises(ValueError):
        ENGINE.analyze(None, threshold=1.5)


def test_canonical_forms(spark):
    cases = [
        ("PESEL", "4405 1401 359", "44051401359"), ("NIP", "123-456-32-18", "1234563218"), ("EMAIL", "Jan@Example.PL", "Jan@example.pl"), ("PHONE", "601234567", "+48601234567"),
        ("PHONE", "+48 601 234 567", "+48601234567"), ("PHONE", "0048601234567", "+48601234567"), ("PESEL", "123", None), ("POSTAL", "00950", "00-950"), ("PLATE", "ww  12345", "WW 12345"),
        ("DOWOD", "aba 300000", "ABA300000"), ("IBAN", "pl61 1090", None), ("CARD", "4111 1111 1111 1111", "4111111111111111"), ("PASSPORT", "aa 1234567", "AA1234567"), ("EMAIL", "@x", None),
        ("PERSON", " Jan   Nowak ", "Jan Nowak"), ("OTHER", " x ", "x"), ("OTHER", "  ", None), ("KRS", "0000123456", "0000123456"), ("REGON", "123456785", "123456785"), ("PESEL", None, None),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "l string, t string")
    assert [r[0] for r in df.select(canonical(F.col("l"), F.col("t"))).collect()] == [c[2] for c in cases]


def test_compatibility_forms_link(spark):
    a, b = _one(spark, "mail ａbc@example.pl x", profile="linkable", labels=["EMAIL"]), _one(spark, "mail bc@example.pl x", profile="linkable", labels=["EMAIL"])
    assert a["redacted_text"].endswith(b["redacted_text"].split(" ", 1)[1])


def test_keys(tmp_path):
    secret = base64.b64encode(b"k" * 32)
    (tmp_path / "a").write_bytes(secret)
    (tmp_path / "b").write_bytes(b"q" * 40)
    store = crypto.KeyStore.from_settings(Settings(master_keys=f"v1:{tmp_path}/a,v2:{tmp_path}/b", active_kid="v2"))
    assert store.ids() == ["v1", "v2"] and store.active == "v2"
    late = crypto.KeyStore.from_settings(Settings(master_keys=f"v1:{tmp_path}/a", master_key_file=f"{tmp_path}/b", active_kid="v3"))
    assert late.ids() == ["v1", "v3"]
    assert crypto.KeyStore.from_settings(Settings(master_key_b64=secret.decode())).ids() == ["v1"]
    assert crypto.KeyStore.from_settings(Settings()) is None
    for bad in ({}, {"V1": b"k" * 32}, {"v1": b"k"}, {"v2": b"k" * 32}):
        with pytest.raises(crypto.KeystoreError):
            crypto.KeyStore(bad)
    with pytest.raises(crypto.KeystoreError):
        store.derive("v9")
    with pytest.raises(ValueError):
        crypto.token(None, "v1", None, 7)


def test_hmac_is_hmac(spark):
    inner, outer = crypto.pads(b"key" * 11)
    df = spark.createDataFrame([(bytearray(inner), bytearray(outer), "żółć")], "i binary, o binary, m string")
    got = df.select(F.lower(F.hex(crypto.hmac_sha256(F.col("i"), F.col("o"), F.col("m"))))).first()[0]
    assert got == hmac.new(b"key" * 11, "żółć".encode(), hashlib.sha256).hexdigest()


def test_settings_from_env():
    s = Settings.from_env({"ENABLE_KRS": "true", "SCORE_THRESHOLD": "0.5", "PSEUDONYM_ACTIVE_KID": "v7", "PSEUDONYM_ALLOWED_PURPOSES": "a,b"})
    assert s.enable_krs and s.score_threshold == 0.5 and s.active_kid == "v7" and s.purposes() == {"a", "b"}
