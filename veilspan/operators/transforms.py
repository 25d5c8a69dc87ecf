"""Transforms of a text by its spans: replace, mask, hash, number, restore."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.text import spliced
from veilspan.model import ENTITY_LABELS

SESSION_TOKEN = r"\[[A-Z]+_\d{3,}\]"


class Profile(StrEnum):
    STRICT = "strict"
    MASK = "mask"
    SESSION = "session"
    LINKABLE = "linkable"
    LINKABLE_STRICT = "linkable_strict"
    HASH = "hash"


MODES = {"replace": Profile.STRICT, "mask": Profile.MASK, "hash": Profile.HASH}


def resolve_profile(profile: str | None = None, mode: str | None = None) -> Profile:
    """The profile, if one is named, else what the mode (default replace) stands for."""
    if profile:
        if profile not in list(Profile):
            raise ValueError(f"unknown profile: {profile!r}")
        return Profile(profile)
    if (mode or "replace") not in MODES:
        raise ValueError(f"unknown redaction mode: {mode!r}")
    return MODES[mode or "replace"]


def form_mode(mode: str | None) -> str:
    """What a form's free choice of mode stands for: replace, if it is no mode."""
    return mode if mode in MODES else "replace"


def placeholder(span: Column) -> Column:
    return F.concat(F.lit("<"), span["label"], F.lit(">"))


def replaced(text: Column, spans: Column) -> Column:
    return spliced(text, spans, placeholder)


def masked(text: Column, spans: Column) -> Column:
    return spliced(text, spans, lambda s: F.repeat(F.lit("*"), s["end"] - s["start"]))


def hashed(text: Column, spans: Column, salt: str = "") -> Column:
    """16 hexadecimal digits of a salted SHA-256; weak, kept for old callers."""
    return spliced(text, spans, lambda s: F.substring(F.sha2(F.concat(F.lit(salt), s["text"]), 256), 1, 16))


def numbered(spans: Column) -> Column:
    """array<struct<token,text>> beside the spans: [LABEL_001] for a label's first
    value, and so on; an equal value has an equal token."""

    def token(s: Column) -> Column:
        same = F.filter(spans, lambda o: o["label"] == s["label"])
        place = F.array_position(F.array_distinct(F.transform(same, lambda o: o["text"])), s["text"])
        name = F.format_string("[%s_%03d]", s["label"], place)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), name.alias("token"), s["text"].alias("text"))

    return F.transform(spans, token)


def anonymized(text: Column, spans: Column) -> tuple[Column, Column]:
    """(text with session tokens, map from token to value)."""
    tokens = numbered(spans)
    pairs = F.array_distinct(F.transform(tokens, lambda t: F.struct(t["token"], t["text"])))
    return spliced(text, tokens, lambda t: t["token"]), F.map_from_entries(pairs)


def restored(text: Column, mapping: Column) -> Column:
    """Session tokens that the mapping knows become their values, in one pass: a
    value that looks like a token is not replaced again."""
    tokens = F.regexp_extract_all(text, F.lit(SESSION_TOKEN), F.lit(0))
    values = F.transform(tokens, lambda t: F.coalesce(F.element_at(mapping, t), t))
    gaps = F.split(text, SESSION_TOKEN, -1)
    padded = F.concat(values, F.array(F.lit("")))
    joined = F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), padded.alias("v")), lambda x: F.array(x["g"], x["v"]))), "")
    return F.when(mapping.isNull() | (F.size(tokens) == 0), text).otherwise(joined)


def with_results_applied(df: DataFrame, text: str = "text", results: str = "analyzer_results", output: str = "anonymized") -> DataFrame:
    """df with `output`: struct<text, items>, the given spans replaced from the right.

    results: array<struct<entity_type,start,end,...>> in either vocabulary; unknown
    types are kept as they are. A span outside the text as it is by then, or empty,
    is skipped; overlaps are not resolved. items are ascending; their starts are
    those given, their ends the start and the replacement's length.
    """
    known = F.create_map(*(F.lit(x) for pair in ENTITY_LABELS.items() for x in pair))
    given = F.transform(F.col(results), lambda r: F.struct(r["entity_type"].alias("entity_type"), r["start"].cast("int").alias("start"), r["end"].cast("int").alias("end")))
    listed = F.coalesce(given, F.array().cast("array<struct<entity_type:string,start:int,`end`:int>>"))
    keyed = F.transform(listed, lambda r, i: F.struct((-r["start"]).alias("k"), i.alias("i"), r["entity_type"].alias("entity_type"), r["start"].alias("start"), r["end"].alias("end")))
    item = "array<struct<operator:string,entity_type:string,start:int,`end`:int>>"
    begin = F.struct(F.col(text).alias("text"), F.array().cast(item).alias("items"))

    def step(acc: Column, r: Column) -> Column:
        label = F.coalesce(known[r["entity_type"]], r["entity_type"])
        new = F.concat(F.lit("<"), label, F.lit(">"))
        bad = (r["start"] < 0) | (r["end"] > F.length(acc["text"])) | (r["start"] >= r["end"])
        out = F.overlay(acc["text"], new, r["start"] + 1, r["end"] - r["start"])
        one = F.struct(F.lit("replace").alias("operator"), label.alias("entity_type"), r["start"].alias("start"), (r["start"] + F.length(new)).cast("int").alias("end"))
        done = F.struct(out.alias("text"), F.concat(F.array(one).cast(item), acc["items"]).alias("items"))
        return F.when(bad, acc).otherwise(done)

    return df.withColumn(output, F.aggregate(F.array_sort(keyed), begin, step))


def privacy(profile: Profile) -> Column:
    """What a caller may be told of a result, as a struct."""
    linkable = profile in (Profile.LINKABLE, Profile.LINKABLE_STRICT)
    values = {
        "classification": "pseudonymised_personal_data" if linkable or profile in (Profile.HASH, Profile.SESSION) else "redacted",
        "linkable": linkable or profile == Profile.HASH,
        "reversible": profile == Profile.SESSION,
        "algorithm": {"hash": "SHA256-salt-truncated", "mask": "mask", "strict": "replace", "session": "session-tokens"}.get(profile, "HMAC-SHA256-HKDF-v1"),
        "deprecated_hash": profile == Profile.HASH,
    }
    return F.struct(*(F.lit(v).alias(k) for k, v in values.items()))


def counts_by_label(spans: Column) -> Column:
    """map<label, number of spans>."""
    labels = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"])))
    return F.map_from_entries(F.transform(labels, lambda x: F.struct(x, F.size(F.filter(spans, lambda s: s["label"] == x)))))


def summary(spans: Column) -> Column:
    """LABEL×n, sorted by label."""
    entries = F.map_entries(counts_by_label(spans))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("×"), e["value"].cast("string"))), ", ")


def to_wire(spans: Column, text: bool = True) -> Column:
    """Spans without their source, and without their text if so asked."""
    names = ("start", "end", "label", "score") + (("text",) if text else ())
    return F.transform(spans, lambda s: F.struct(*(s[n].alias(n) for n in names)))


def to_entity_wire(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["label"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))


def coerced_language(language: Column, default: str = "pl") -> Column:
    """pl or en out of any language tag; the default for the rest."""
    short = F.lower(F.trim(F.split_part(language, F.lit("-"), F.lit(1))))
    return F.when(short.isin("pl", "en"), short).otherwise(F.lit(default))
