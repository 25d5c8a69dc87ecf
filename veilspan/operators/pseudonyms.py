"""Linkable pseudonyms: every span becomes a keyed token of its canonical value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import crypto
from veilspan.functions.canonical import canonical, nfkc, structured
from veilspan.functions.text import spliced
from veilspan.model import SPANS
from veilspan.operators.transforms import Profile, placeholder

NORMALISED = "__veilspan_normal"


def _with_normal_values(df: DataFrame, spans: str) -> DataFrame:
    """df with the NFKC of each span's text. Every batch of rows passes through Python,
    but rows whose values are ASCII send a null there."""
    texts = F.transform(F.col(spans), lambda s: s["text"])
    odd = F.exists(texts, lambda t: t.rlike(r"[^\x00-\x7F]"))
    return df.withColumn(NORMALISED, F.when(odd, nfkc()(F.when(odd, texts))).otherwise(texts))


def linkable(
    df: DataFrame,
    store: crypto.KeyStore | None,
    text: str = "text",
    spans: str = "spans",
    profile: Profile = Profile.LINKABLE,
    purpose: str = "default",
    tenant: str | None = None,
    tenants: list[str] | None = None,
    kid: str | None = None,
    n_bytes: int = 15,
    strict: bool = False,
) -> DataFrame:
    """df with redacted_text, pseudonyms (the spans with tokens as their text) and stats.

    tenant is one name for all rows; with `tenants` the column `tenant` names each
    row's, and rows of others are an error. Values without a canonical form become
    <LABEL>, or fail the query if strict. Values that are tokens already stay.
    Without keys this fails before anything runs.
    """
    if store is None:
        raise crypto.KeystoreError("linkable profiles need a master key")
    kid = kid or store.active
    spark = df.sparkSession
    table = crypto.pad_table(spark, store, purpose, tenants or [tenant or "_"], kid)
    if tenants:
        at = F.coalesce(F.col("tenant"), F.lit("_"))
        df = df.join(F.broadcast(table), at == F.col("__tenant"), "left")
        df = df.withColumn("__inner", F.when(F.col("__inner").isNull(), F.raise_error(F.concat(F.lit("unknown tenant: "), at))).otherwise(F.col("__inner")))
    else:
        # a table of one row, so that no plan shows a key
        df = df.withColumn("__tenant", F.lit(tenant or "_")).join(F.broadcast(table), "__tenant")
    df = _with_normal_values(df, spans)

    def one(s: Column, i: Column) -> Column:
        value = canonical(s["label"], F.get(F.col(NORMALISED), i))
        allowed = structured(s["label"]) if profile == Profile.LINKABLE_STRICT else F.lit(True)
        mac = crypto.hmac_sha256(F.col("__inner"), F.col("__outer"), crypto.message(s["label"], value))
        made = F.when(allowed & value.isNotNull(), crypto.token(s["label"], kid, mac, n_bytes))
        if strict:
            made = F.when(allowed & value.isNull(), F.raise_error(F.concat(F.lit("no canonical form: "), s["label"]))).otherwise(made)
        already = crypto.is_token(s["text"])
        kind = F.when(already, "kept").when(made.isNotNull(), "token").otherwise("placeholder")
        new = F.when(already, F.trim(s["text"])).otherwise(F.coalesce(made, placeholder(s)))
        end = F.when(already, s["start"] + F.length(F.trim(s["text"]))).otherwise(s["end"])
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), end.alias("shown"), s["label"].alias("label"), s["score"].alias("score"), new.alias("text"), s["source"].alias("source"), kind.alias("kind"))

    df = df.withColumn("__made", F.transform(F.col(spans), one))
    made = F.col("__made")
    shown = F.transform(made, lambda m: F.struct(m["start"].alias("start"), m["shown"].alias("end"), m["label"].alias("label"), m["score"].alias("score"), m["text"].alias("text"), m["source"].alias("source"))).cast(SPANS)
    tokens = F.filter(made, lambda m: m["kind"] == "token")
    labels = F.array_sort(F.array_distinct(F.transform(tokens, lambda m: m["label"])))
    stats = F.struct(
        F.size(tokens).alias("pseudonymised"),
        F.size(F.filter(made, lambda m: m["kind"] == "placeholder")).alias("replaced_fallback"),
        F.map_from_entries(F.transform(labels, lambda x: F.struct(x, F.size(F.filter(tokens, lambda m: m["label"] == x))))).alias("by_label"),
    )
    out = df.withColumns({"redacted_text": spliced(F.col(text), made, lambda m: m["text"]), "pseudonyms": shown, "stats": stats})
    return out.drop("__made", "__inner", "__outer", "__tenant", NORMALISED)
