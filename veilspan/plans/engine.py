"""The engine: the operations of the service, over DataFrames.

Each method plans; nothing runs until a caller asks for rows. Wrong names, modes,
profiles, purposes and ranges are ValueErrors before that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.crypto import KeyStore, KeystoreError
from veilspan.model import LABELS, LANGUAGES, labels_allowed
from veilspan.operators import transforms as tf
from veilspan.operators.detection import Ner, detect, spans_of
from veilspan.operators.pseudonyms import linkable
from veilspan.operators.recognizers import Recogniser, registry
from veilspan.operators.transforms import Profile, resolve_profile
from veilspan.settings import Settings
from veilspan.sources.tables import with_mappings


class Engine:
    def __init__(self, settings: Settings | None = None, store: KeyStore | None = None, recognisers: Sequence[Recogniser] | None = None, ner: Ner | None = None):
        self.settings = settings or Settings()
        self.store = store or KeyStore.from_settings(self.settings)
        self.recognisers = tuple(recognisers) if recognisers is not None else registry(self.settings)
        self.ner = ner

    def info(self, spark: SparkSession | None = None, vault: str | None = None) -> dict:
        """What the engine has. With the path of a vault: whether it can be read."""
        status = "disabled"
        if spark is not None and vault:
            try:
                found = set(spark.read.parquet(vault).columns)
                status = "connected" if {"session_id", "mapping", "expires_at"} <= found else "unreachable"
            except AnalysisException:
                status = "unreachable"
        return {
            "vault": status,
            "languages": list(LANGUAGES),
            "recognizers": sorted({r.name for r in self.recognisers} | ({"ner"} if self.ner else set())),
            "labels": list(LABELS),
            "pseudonym": self.store.health() if self.store else {"enabled": False},
        }

    def _options(self, labels: Sequence[str] | None, threshold: Column | float | None, language: str | None = None) -> dict:
        if language is not None and language not in LANGUAGES:
            raise ValueError(f"unknown language: {language!r}")
        if isinstance(threshold, (int, float)) and not 0 <= threshold <= 1:
            raise ValueError("the threshold is between 0 and 1")
        chosen = tuple(r for r in self.recognisers if language is None or language in r.languages)
        return {"settings": self.settings, "labels": labels, "threshold": threshold, "recognisers": chosen, "ner": self.ner}

    def purpose(self, purpose: str | None) -> str:
        name = (purpose or "").strip() or self.settings.default_purpose
        if len(name) > 64:
            raise ValueError("a purpose takes 64 characters at most")
        if self.settings.purposes() and name not in self.settings.purposes():
            raise ValueError(f"purpose not allowed: {name!r}")
        return name

    def analyze(self, df: DataFrame, text: str = "text", labels: Sequence[str] | None = None, threshold: Column | float | None = None, output: str = "spans", language: str | Column | None = None) -> DataFrame:
        """df with the spans of each text. The language is one for all rows, or a
        column of tags: other tags than those of a known language count as Polish."""
        if not isinstance(language, Column):
            return detect(df, text, output, **self._options(labels, threshold, language))
        by = {x: self._options(labels, threshold, x) for x in LANGUAGES}
        first = by[LANGUAGES[0]]
        if all(o["recognisers"] == first["recognisers"] for o in by.values()):
            return detect(df, text, output, **first)  # no row's language changes anything
        tag = tf.coerced_language(language)
        found = F.when(tag == LANGUAGES[0], spans_of(F.col(text), **first))
        for x in LANGUAGES[1:]:
            found = found.when(tag == x, spans_of(F.col(text), **by[x]))
        return df.withColumn(output, found)

    def analyze_entities(self, df: DataFrame, text: str = "text", entities: list[str] | None = None, threshold: Column | float | None = None, output: str = "results") -> DataFrame:
        """df with entity_type, start, end, score for each span. `entities` allows
        types or labels; a list that names nothing known detects nothing."""
        allowed = labels_allowed(entities)
        if allowed == []:
            return df.withColumn(output, F.array().cast("array<struct<entity_type:string,start:int,`end`:int,score:double>>"))
        found = self.analyze(df, text, allowed, threshold, "__spans")
        return found.withColumn(output, tf.to_entity_wire(F.col("__spans"))).drop("__spans")

    def redact(
        self,
        df: DataFrame,
        text: str = "text",
        profile: str | None = None,
        mode: str | None = None,
        labels: Sequence[str] | None = None,
        threshold: Column | float | None = None,
        purpose: str | None = None,
        tenant: str | None = None,
        tenants: list[str] | None = None,
        key_id: str | None = None,
        token_bytes: int | None = None,
        strict: bool = False,
    ) -> DataFrame:
        """df with spans, redacted_text and privacy; linkable profiles add stats and
        pseudonyms, the session profile adds mapping."""
        chosen = resolve_profile(profile, mode)
        if chosen in (Profile.LINKABLE, Profile.LINKABLE_STRICT):
            name = self.purpose(purpose)
            if self.store is None:
                raise KeystoreError("linkable profiles need a master key")
            found = self.analyze(df, text, labels, threshold)
            size = token_bytes or self.settings.default_token_bytes
            out = linkable(found, self.store, text, "spans", chosen, name, tenant, tenants, key_id, size, strict)
            return out.withColumn("privacy", tf.privacy(chosen))
        if chosen == Profile.SESSION:
            out = self.anonymize(df, text, labels, threshold).withColumnRenamed("anonymized_text", "redacted_text")
            return out.withColumn("privacy", tf.privacy(chosen))
        found = self.analyze(df, text, labels, threshold)
        t, s = F.col(text), F.col("spans")
        if chosen == Profile.MASK:
            new = tf.masked(t, s)
        elif chosen == Profile.HASH:
            new = tf.hashed(t, s, self.settings.hash_salt)
        else:
            new = tf.replaced(t, s)
        return found.withColumn("redacted_text", new).withColumn("privacy", tf.privacy(chosen))

    def redact_form(self, df: DataFrame, text: str = "text", mode: str | None = None, most: int = 2000, labels: Sequence[str] | None = None) -> DataFrame:
        """For forms: an unknown mode is replace, blank texts and texts over `most`
        characters are not touched and have a message; the others have a summary."""
        out = self.redact(df, text, mode=tf.form_mode(mode), labels=labels)
        t = F.col(text)
        message = F.when(t.isNull() | (F.trim(t) == ""), "empty text").when(F.length(t) > most, f"text exceeds {most} characters")
        return out.withColumns({"message": message, "redacted_text": F.when(message.isNull(), F.col("redacted_text")), "summary": F.when(message.isNull(), tf.summary(F.col("spans")))})

    def anonymize(self, df: DataFrame, text: str = "text", labels: Sequence[str] | None = None, threshold: Column | float | None = None) -> DataFrame:
        """df with spans, anonymized_text and the mapping from tokens to values."""
        found = self.analyze(df, text, labels, threshold)
        new, mapping = tf.anonymized(F.col(text), F.col("spans"))
        return found.withColumns({"anonymized_text": new, "mapping": mapping})

    def restore(self, df: DataFrame, text: str = "text", mapping: str | None = "mapping", vault: DataFrame | None = None, now: Column | None = None) -> DataFrame:
        """df with restored_text. With a vault, stored mappings of session_id are used
        too; the request's own entries go first. With neither this is an error."""
        if mapping is None and vault is None:
            raise ValueError("restore needs a mapping or a session")
        if vault is None:
            return df.withColumn("restored_text", tf.restored(F.col(text), F.col(mapping)))
        asked = df if mapping else df.withColumn("mapping", F.lit(None).cast("map<string,string>"))
        known = with_mappings(asked, vault, F.current_timestamp() if now is None else now)
        return known.withColumn("restored_text", tf.restored(F.col(text), F.col("known"))).drop("known")

    def apply_results(self, df: DataFrame, text: str = "text", results: str = "analyzer_results") -> DataFrame:
        return tf.with_results_applied(df, text, results)
