"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import checksums as ck
from veilspan.functions.canonical import canonical
from veilspan.functions.crypto import KeyStore
from veilspan.functions.registered import register
from veilspan.model import LABELS, SPANS
from veilspan.operators import evaluation as ev
from veilspan.operators import transforms as tf
from veilspan.operators.detection import detect, long_form, resolved
from veilspan.operators.ratelimit import rate_limited
from veilspan.plans.engine import Engine
from veilspan.settings import Settings
from veilspan.sources import synthetic, tables

Query = Callable[[SparkSession, str], DataFrame]

#: Labels that patterns alone can report in full.
PUBLIC = tuple(x for x in LABELS if x not in ("PERSON", "ORG", "ADDRESS"))
SETTINGS = Settings(enable_krs=True, hash_salt="pepper")
NOW = "2024-01-15 00:00:00"
#: The key of the published test vectors.
STORE = KeyStore({"v1": b"\x11" * 32, "v2": b"\x22" * 32})
ENGINE = Engine(SETTINGS, STORE)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spread(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spread(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as a table: made once, then read, as a corpus on disk would be."""
    return tables.kept(synthetic.corpus(_ids(spark, sf_dir)), f"corpus of {sf_dir}")


def _identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.kept(synthetic.with_identifiers(_ids(spark, sf_dir)), f"identifiers of {sf_dir}")


def _gold(corpus: DataFrame) -> DataFrame:
    return corpus.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.start", "e.end", "e.label", "e.text")


def _emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ENGINE.analyze(_documents(spark, sf_dir), labels=["EMAIL"])


# Detection and transforms of the documents' e-mail addresses.


def email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(_emails(spark, sf_dir), "doc_id").select("doc_id", "start", "end", "label", "score", "text", "source")


def email_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _emails(spark, sf_dir).select("lang", F.size("spans").alias("n"))
    return found.groupBy("lang").agg(F.sum("n").alias("n_spans"), F.count_if(F.col("n") > 0).alias("n_docs"))


def page_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ENGINE.analyze(_table(spark, sf_dir, "pages").select("page_id", "html"), "html", ["EMAIL"])
    return long_form(found, "page_id").select("page_id", "start", "end", "text")


def _redacted(**options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ENGINE.redact(_documents(spark, sf_dir), labels=["EMAIL"], **options).select("doc_id", "redacted_text")

    return query


def redact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recogniser over every document; the headline of the bench."""
    out = ENGINE.redact(_documents(spark, sf_dir), profile="strict")
    return out.select("doc_id", F.when(F.col("text").isNotNull(), F.size("spans")).alias("n_spans"), "redacted_text")


def anonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ENGINE.anonymize(_documents(spark, sf_dir), labels=["EMAIL"])
    return out.select("doc_id", "anonymized_text", F.size("mapping").alias("n_tokens"))


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ENGINE.anonymize(_documents(spark, sf_dir), labels=["EMAIL"])
    return out.select("doc_id", F.explode_outer("mapping").alias("token", "value")).where("token is not null")


def restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ENGINE.anonymize(_documents(spark, sf_dir), labels=["EMAIL"])
    return ENGINE.restore(out, "anonymized_text").select("doc_id", "restored_text")


def apply_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _emails(spark, sf_dir)
    given = found.withColumn("analyzer_results", F.transform("spans", lambda s: F.struct(F.lit("EMAIL_ADDRESS").alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"))))
    out = ENGINE.apply_results(given)
    return out.select("doc_id", F.col("anonymized.text").alias("anonymized_text"), F.size("anonymized.items").alias("n_items"))


def applied_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = ENGINE.analyze_entities(_documents(spark, sf_dir), entities=["EMAIL_ADDRESS", "NO_SUCH"], output="analyzer_results")
    return ENGINE.apply_results(given).select("doc_id", F.explode_outer("anonymized.items").alias("i")).where("i is not null").select("doc_id", "i.operator", "i.entity_type", "i.start", "i.end")


def entities_allow_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ENGINE.analyze_entities(_documents(spark, sf_dir), entities=["US_SSN"])
    return out.select("doc_id", F.size("results").alias("n_results"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emails(spark, sf_dir).select("doc_id", tf.summary(F.col("spans")).alias("summary"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tables.audit(_emails(spark, sf_dir), "spans", "doc_id")
    return counts.select("doc_id", "n_spans", F.coalesce(F.col("by_label")["EMAIL"], F.lit(0)).alias("n_email"))


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.log_lines(_emails(spark, sf_dir), "analyze", "spans", "doc_id")


def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    short, long = tables.within_size(_documents(spark, sf_dir), most=5000)
    return short.select("doc_id", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason")).unionByName(long.select("doc_id", F.lit(False).alias("accepted"), "reason"))


def response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.try_element_at("spans", F.lit(1))
    out = _emails(spark, sf_dir).withColumn("first", first["text"])
    return out.select("doc_id", tables.response_json("doc_id", F.col("first").alias("email")).alias("response"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("tag", F.when(F.col("doc_id") % 3 == 0, F.concat(F.upper("lang"), F.lit("-US"))).when(F.col("doc_id") % 3 == 1, F.col("lang")))
    return docs.select("doc_id", tf.coerced_language(F.col("tag")).alias("language"))


def linkable_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ENGINE.redact(_documents(spark, sf_dir), profile="linkable", labels=["EMAIL"], purpose="eval")
    return out.select("doc_id", "redacted_text", F.col("stats.pseudonymised").alias("pseudonymised"), F.col("stats.replaced_fallback").alias("replaced_fallback"))


def luhn_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _documents(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))).alias("digits"))
    return runs.where(F.length("digits").between(13, 19)).select("doc_id", "digits", ck.is_luhn(F.col("digits")).alias("valid"))


# Identifiers made from keys.

_CHECKS: dict[str, tuple[str, str, Callable[[Column], Column]]] = {
    "pesel": ("pesel", "bad_pesel", ck.is_pesel),
    "nip": ("nip", "bad_nip", ck.is_nip),
    "regon9": ("regon9", "bare9", ck.is_regon),
    "regon14": ("regon14", "bare10", ck.is_regon),
    "iban": ("iban", "bad_iban", ck.is_iban),
    "dowod": ("dowod", "bad_dowod", ck.is_dowod),
    "card": ("card", "postal", ck.is_luhn),
}


def _check(name: str) -> Query:
    good, bad, test = _CHECKS[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _identifiers(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, F.col(good)).otherwise(F.col(bad)).alias("value"))
        return rows.select("id", "value", test(F.col("value")).alias("valid"))

    return query


IDENTIFIERS = ("pesel", "nip", "nip_dashed", "regon9", "regon14", "iban", "dowod", "passport", "card", "phone", "plate", "postal", "email", "krs", "dob", "bad_pesel", "bad_nip", "bad_iban", "bad_dowod", "person", "street")


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything the generators make, a row an order."""
    return _identifiers(spark, sf_dir).select("id", *IDENTIFIERS)


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    rows = _identifiers(spark, sf_dir)
    return rows.selectExpr("id", "is_pesel(pesel) AS a", "is_pesel(bad_pesel) AS b", "is_nip(nip) AS c", "is_nip(bad_nip) AS d", "is_regon9(regon9) AS e", "is_regon14(regon14) AS f", "is_card(card) AS g")


def sql_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL functions of identifiers with letters."""
    register(spark)
    return _identifiers(spark, sf_dir).selectExpr("id", "is_iban(lower(iban)) AS a", "is_iban(bad_iban) AS b", "is_dowod(dowod) AS c", "is_dowod(bad_dowod) AS d", "is_iban(postal) AS e")


_RAW = {
    "PESEL": "concat(substr(pesel, 1, 4), ' ', substr(pesel, 5, 4), ' ', substr(pesel, 9, 3))",
    "NIP": "nip_dashed",
    "REGON": "concat(' ', regon14)",
    "KRS": "krs",
    "DOWOD": "lower(concat(substr(dowod, 1, 3), ' ', substr(dowod, 4, 6)))",
    "IBAN": "concat(substr(lower(iban), 1, 4), ' ', substr(iban, 5, 24))",
    "CARD": "card",
    "EMAIL": "upper(email)",
    "PHONE": "concat('00 48 6', substr(m1, 2, 2), '-', m2, '-', m3)",
    "PASSPORT": "lower(passport)",
    "PLATE": "lower(concat(plate, '  '))",
    "POSTAL": "replace(postal, '-', '')",
    "PERSON": "replace(person, ' ', '   ')",
    "ADDRESS": "concat('  ', street)",
    "OTHER": "concat(' ', city, ' ')",
}


def canonical_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _identifiers(spark, sf_dir)
    pairs = ", ".join(f"named_struct('label', '{label}', 'raw', {raw})" for label, raw in _RAW.items())
    each = rows.selectExpr("id", f"explode(array({pairs})) AS p").select("id", "p.label", "p.raw")
    return each.select("id", "label", canonical(F.col("label"), F.col("raw")).alias("canonical"))


# The corpus, detection on it, and its evaluation.


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).select("doc_id", "template", "language", "text")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(_corpus(spark, sf_dir))


def template_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.histogram(_corpus(spark, sf_dir), "template")


def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.histogram(_gold(_corpus(spark, sf_dir)), "label")


def _found(spark: SparkSession, sf_dir: str, labels: tuple[str, ...] | None = None) -> DataFrame:
    return long_form(detect(_corpus(spark, sf_dir), settings=SETTINGS, labels=labels), "doc_id")


def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of all recognisers together, of the labels that the gold has in full."""
    return _found(spark, sf_dir).where(F.col("label").isin(*PUBLIC, "ORG")).select("doc_id", "start", "end", "label", "text")


def _detect(label: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _found(spark, sf_dir, (label,)).select("doc_id", "start", "end", "text")

    return query


def detect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir).where(F.col("label").isin(*PUBLIC, "ORG"))
    return ev.entity_counts(found).groupBy("label").agg(F.sum("n").alias("n_spans"), F.count(F.lit(1)).alias("n_docs"))


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.report(_gold(_corpus(spark, sf_dir)), _found(spark, sf_dir), PUBLIC)


def _noisy(gold: DataFrame) -> DataFrame:
    """Predictions that miss, shift, repeat and corrupt some of the gold spans."""
    n = F.col("n")
    kept = gold.withColumn("n", F.col("start") + F.length("text")).where(n % 7 != 3)
    moved = kept.withColumn("start", F.when(n % 11 == 5, F.col("start") + 1).otherwise(F.col("start")))
    wrong = F.when((n % 13 == 1) & F.col("label").isin("PESEL", "NIP"), F.concat(F.lit("1"), F.col("text"))).otherwise(F.col("text"))
    return moved.withColumn("text", wrong).unionByName(kept.where(n % 17 == 2)).drop("n")


def evaluation_noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gold(_corpus(spark, sf_dir))
    return ev.report(g, _noisy(g))


GATES = {"micro_f1": 0.95, "labels": {"PESEL": {"precision": 0.99, "recall": 0.5, "max_invalid_fp": 0}, "EMAIL": {"f1": 0.999, "min_support": 1}, "CARD": {"recall": 0.1}, "NOSUCH": {"f1": 0.5, "min_support": 3}, "ABSENT": {"f1": 0.9}}}


def gate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates, micro = tables.gates_of(spark, GATES)
    return ev.gate_failures(evaluation_noisy(spark, sf_dir), gates, micro).select("label", "metric", "value", "floor")


def linkable_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the structured labels over the whole corpus, strictly linkable."""
    out = ENGINE.redact(_corpus(spark, sf_dir).select("doc_id", "text"), profile="linkable_strict", purpose="logs", labels=["PESEL", "EMAIL", "DOB"])
    return out.select("doc_id", F.explode_outer("pseudonyms").alias("p")).where("p is not null").select("doc_id", "p.start", "p.end", "p.label", F.col("p.text").alias("token"))


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a checksum, which have the full score, at three thresholds, the last a
    column: none loses them. See phone_thresholds for scores that differ."""
    rows = _corpus(spark, sf_dir).select("doc_id", "text").withColumn("limit", F.lit(0.9))
    for name, limit in (("low", 0.0), ("usual", None), ("high", F.col("limit"))):
        rows = ENGINE.analyze(rows, labels=["DOWOD"], threshold=limit, output=name)
    return rows.select("doc_id", *(F.size(c).alias(c) for c in ("low", "usual", "high")))


def detect_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street addresses; towns need a model."""
    return _found(spark, sf_dir, ("ADDRESS",)).select("doc_id", "start", "end", "text")


# Gates, on sentences whose outcome is known.

_SENTENCES: dict[str, tuple[str, tuple[str, ...]]] = {
    "dob": ("DOB", ("concat('Jan, ur. ', dob, ', Opole')", "concat('born: ', dob)", "concat('spotkanie ', dob, ' odwołane')", "concat('ur. w Opolu, wydano ', dob)")),
    "postal": ("POSTAL", ("concat('adres: ', postal, ' Opole')", "concat('zakres ', postal, ' szt.')", "concat('paczka ', postal, ' Opole')", "concat('poczta, potem cztery inne jasne słowa tam ', postal, ' szt.')")),
    "plate": ("PLATE", ("concat('tablica rejestracyjna ', plate)", "concat('kod ', plate)", "concat('tablica ', lower(plate))", "concat('tablica REG ', b_five)")),
    "krs": ("KRS", ("concat('spółka pod KRS ', krs)", "concat('wpis ', krs)", "concat('krs: ', krs, '0')", "concat('KRS nr ', krs, '.')")),
    "phone": ("PHONE", ("concat('tel. 6', substr(m1, 2, 2), m2, m3)", "concat('numer 6', substr(m1, 2, 2), m2, m3)", "concat('numer 6', substr(m1, 2, 2), ' ', m2, ' ', m3)", "concat('numer +48 6', substr(m1, 2, 2), m2, m3)")),
    "card": ("CARD", ("concat('karta ', card16)", "concat('numer ', card16)", "concat('numer ', card)", "concat('numer ', substr(card, 1, 13))")),
    "nip": ("NIP", ("concat('NIP ', nip)", "concat('numer ', nip)", "concat('numer ', nip_dashed)", "concat('NIP ', bad_nip)")),
    "regon": ("REGON", ("concat('REGON ', regon9)", "concat('numer ', regon9)", "concat('regon: ', regon14)", "concat('REGON ', bare9)")),
}


def _gate(name: str) -> Query:
    label, texts = _SENTENCES[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        cases = " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(texts))
        rows = _identifiers(spark, sf_dir).selectExpr("id", f"CASE id % 4 {cases} END AS text")
        found = detect(rows, settings=SETTINGS, labels=[label])
        return found.select("id", F.explode_outer("spans").alias("s")).select("id", "s.start", "s.end", "s.text", "s.score")

    return query


def phone_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the phone sentences, whose scores differ, at three thresholds."""
    cases = " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(_SENTENCES["phone"][1]))
    rows = _identifiers(spark, sf_dir).selectExpr("id", f"CASE id % 4 {cases} END AS text", "0.6D AS least")
    for name, limit in (("low", 0.0), ("usual", None), ("high", F.col("least"))):
        rows = ENGINE.analyze(rows, labels=["PHONE"], threshold=limit, output=name)
    return rows.select("id", *(F.size(c).alias(c) for c in ("low", "usual", "high")))


#: An account number of another country, or one whose check digits are one too many.
FOREIGN = "(((CAST(b_iban1 AS BIGINT) % 97) * 1000000000 + CAST(b_iban2 AS BIGINT)) % 97 * 1000000 + 131400) % 97"
FOREIGN_IBAN = f"concat('DE', lpad(CAST(98 - {FOREIGN} + id % 2 AS @TEXT), 2, '0'), b_iban1, b_iban2)"


def iban_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _identifiers(spark, sf_dir).selectExpr("id", f"concat('account ', {FOREIGN_IBAN.replace('@TEXT', 'STRING')}, ' please') AS text")
    found = detect(rows, settings=SETTINGS, labels=["IBAN"])
    return found.select("id", F.explode_outer("spans").alias("s")).where("s is not null").select("id", "s.start", "s.end", "s.label", "s.text", "s.score")


def apply_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given spans that are empty, turned round, or outside the text, and one that is not."""
    rows = _ids(spark, sf_dir).selectExpr("id", "concat('row ', id, ' ends') AS text")
    spans = ((-1, 2), (2, 2), (3, 1), (0, 1000), (0, 3))
    given = F.array(*(F.struct(F.lit("PERSON").alias("entity_type"), F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in spans))
    out = ENGINE.apply_results(rows.withColumn("analyzer_results", given))
    return out.select("id", F.col("anonymized.text").alias("anonymized_text"), F.size("anonymized.items").alias("n_items"))


#: Sentences by the purpose, tenant and key that their tokens are made with.
_VECTORS = {
    ("eval", None, "v1"): ((0, "PESEL 44051401359"), (3, "PESEL 02211301378"), (4, "NIP 1234563218"), (5, "mail Jan@Example.PL"), (6, "tel. 601234567")),
    ("logs", None, "v1"): ((1, "PESEL 44051401359"),),
    ("eval", None, "v2"): ((2, "PESEL 44051401359"),),
    ("llm-gateway", "acme", "v1"): ((7, "PESEL 44051401359"),),
}


def pseudonym_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of known values under keys derived from the published master keys."""
    out = None
    for (purpose, tenant, kid), sentences in _VECTORS.items():
        rows = spark.sql("SELECT CAST(id AS BIGINT) AS id, text FROM VALUES " + ", ".join(f"({n}, '{t}')" for n, t in sentences) + " AS v(id, text)")
        labels = ["PESEL", "NIP", "EMAIL", "PHONE"] if len(sentences) > 1 else ["PESEL"]
        made = ENGINE.redact(rows, profile="linkable", purpose=purpose, tenant=tenant, key_id=kid, labels=labels).select("id", "redacted_text")
        out = made if out is None else out.unionByName(made)
    return out


def card_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards written a digit at a time."""
    rows = _identifiers(spark, sf_dir).selectExpr("id", "concat('karta ', rtrim(regexp_replace(card16, '(.)', '$1 ')), '.') AS text")
    found = detect(rows, settings=SETTINGS, labels=["CARD"])
    return found.select("id", F.explode_outer("spans").alias("s")).select("id", "s.start", "s.end", "s.text", "s.score")


def ner_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a model, which reports four spans, two of them of no use."""
    rows = _identifiers(spark, sf_dir).selectExpr("id", "person", "concat('KRS ', pesel, ' ', person, ' ', city) AS text")

    def model(text: Column) -> Column:
        places = ((0, 3, "ORGANIZATION"), (4, 15, "PERSON"), (16, 20, "PERSON"))
        return F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(e).alias("entity"), F.lit(0.85).alias("score")) for a, b, e in places))

    found = detect(rows, settings=SETTINGS, labels=["PERSON", "ORG"], ner=model)
    return found.select("id", F.explode_outer("spans").alias("s")).where("s is not null").select("id", "s.start", "s.end", "s.label", "s.text", "s.source")


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy resolution of six made-up spans a row."""
    rows = _ids(spark, sf_dir)
    made = [
        f"named_struct('start', CAST((id * {a} + {k}) % 23 AS INT), 'end', CAST((id * {a} + {k}) % 23 + 1 + (id * {b} + {k}) % 9 AS INT), 'label', '{label}', 'score', CAST((id * {c} + {k}) % 4 AS DOUBLE) / 4, 'text', '', 'source', CASE WHEN (id + {k}) % 3 = 0 THEN 'ner' ELSE 'pattern' END)"
        for k, (a, b, c, label) in enumerate(((7, 3, 5, "A"), (11, 5, 3, "B"), (13, 7, 7, "C"), (5, 11, 11, "D"), (3, 13, 13, "E"), (17, 2, 9, "F")))
    ]
    spans = rows.selectExpr("id", f"array({', '.join(made)}) AS spans").withColumn("spans", F.col("spans").cast(SPANS))
    return spans.select("id", F.explode_outer(resolved(F.col("spans"))).alias("s")).where("s is not null").select("id", "s.start", "s.end", "s.label", "s.source")


# State.


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions stored by events, and asked for at one moment."""
    events = _table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"), "user_id")
    put = events.where("event_id % 2 = 0").select(F.col("event_id").cast("string").alias("session_id"), F.create_map(F.lit("[EMAIL_001]"), F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("mapping"), "at")
    stored = put.select("session_id", "mapping", (F.col("at") + F.expr("INTERVAL 900 SECONDS")).alias("expires_at"))
    asked = events.select((F.col("event_id") - F.col("event_id") % 2).cast("string").alias("session_id"), "event_id", F.lit("to [EMAIL_001], [EMAIL_002]").alias("text"), F.when(F.col("event_id") % 5 == 0, F.create_map(F.lit("[EMAIL_001]"), F.lit("own"))).alias("mapping"), F.lit(NOW).cast("timestamp").alias("now"))
    return ENGINE.restore(asked, vault=stored, now=F.col("now")).select("event_id", "restored_text")


def vault_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the vault keeps of the documents' sessions. Their ids are random, so no SQL
    gives the same rows."""
    found = tables.with_session(ENGINE.anonymize(_documents(spark, sf_dir), labels=["EMAIL"]))
    rows = tables.vault_rows(found, F.lit(NOW).cast("timestamp"))
    return rows.select("session_id", F.size("mapping").alias("n_tokens"), "expires_at")


def redact_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ENGINE.redact_form(_documents(spark, sf_dir), mode="no such mode", most=0)
    return out.select("doc_id", "message", "redacted_text")


def redact_form_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms at the limit of production."""
    out = ENGINE.redact_form(_documents(spark, sf_dir), mode="no such mode", labels=["EMAIL"])
    return out.select("doc_id", "message", "redacted_text")


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limiter over users' events: two hits an hour."""
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return rate_limited(events, "user_id", "ts", "event_id", limit=2, window_seconds=3600.0).select("event_id", "user_id", "accepted")


QUERIES: dict[str, Query] = {
    "email_spans": email_spans,
    "email_counts_by_lang": email_counts_by_lang,
    "page_emails": page_emails,
    "redact_replace": _redacted(mode="replace"),
    "redact_mask": _redacted(mode="mask"),
    "redact_hash": _redacted(profile="hash"),
    "redact_session": _redacted(profile="session"),
    "redact_all": redact_all,
    "anonymize": anonymize,
    "mapping": mapping,
    "restore": restore,
    "apply_results": apply_results,
    "applied_items": applied_items,
    "entities_allow_nothing": entities_allow_nothing,
    "summaries": summaries,
    "audit": audit,
    "audit_log": audit_log,
    "size_guard": size_guard,
    "redact_form": redact_form,
    "redact_form_texts": redact_form_texts,
    "response_json": response_json,
    "languages": languages,
    "linkable_email": linkable_email,
    "luhn_runs": luhn_runs,
    **{f"check_{name}": _check(name) for name in _CHECKS},
    "identifiers": identifiers,
    "sql_functions": sql_functions,
    "sql_letters": sql_letters,
    "canonical_forms": canonical_forms,
    "corpus": corpus,
    "gold": gold,
    "template_histogram": template_histogram,
    "label_histogram": label_histogram,
    "detect_all": detect_all,
    "detect_counts": detect_counts,
    **{f"detect_{label.lower()}": _detect(label) for label in (*PUBLIC, "ORG")},
    "evaluation": evaluation,
    "evaluation_noisy": evaluation_noisy,
    "gate_failures": gate_failures,
    "linkable_corpus": linkable_corpus,
    "thresholds": thresholds,
    "phone_thresholds": phone_thresholds,
    "detect_address": detect_address,
    "iban_foreign": iban_foreign,
    "apply_invalid": apply_invalid,
    "pseudonym_vectors": pseudonym_vectors,
    "card_digits": card_digits,
    **{f"gate_{name}": _gate(name) for name in _SENTENCES},
    "ner_gates": ner_gates,
    "overlaps": overlaps,
    "vault": vault,
    "vault_put": vault_put,
    "rate_limit": rate_limit,
}
