"""From candidates to spans: gates in their order, threshold, overlap resolution.

All of it is one chain of expressions over a row: it needs no exchange. The
threshold comes after everything that raises a score, so a caller's threshold is
never pushed below the gates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.text import after, before, contains_any
from veilspan.model import CANDIDATE, ENTITY_LABELS, SPANS, entities_of
from veilspan.operators.recognizers import Recogniser, pruned, registry
from veilspan.settings import Settings

#: A function of the text column that gives array<struct<start,end,entity,score>>.
Ner = Callable[[Column], Column]

# Keyword hints, birth and city patterns, NER names and shapes that are no PII.
HINTS = {
    "KRS": ("krs",),
    "NIP": ("nip", "vat", "podatkowy"),
    "REGON": ("regon",),
    "CARD": ("karta", "card", "credit", "płatnicza", "platnicza", "visa", "mastercard"),
    "PESEL": ("pesel",),
    "IBAN": ("iban", "konto", "rachunek", "account", "przelew"),
    "POSTAL": ("kod pocztowy", "pocztowy", "adres", "ul.", "ulica", "al.", "os.", "zamieszka"),
    "PLATE": ("tablica", "rejestracyjn", "pojazd", "samochód", "auto", "rej."),
}
BIRTH = r"(?iuU)(?:\bur\.?|\burodzon\w*|\burodzi[łl]\w*|\burodzeni[ae]|\bborn\b|\bbirth\w*|\bd\.?o\.?b\.?)[\s:,.-]*$"
CITY = r"(?U)^\s+[A-ZĄĆĘŁŃÓŚŹŻ][A-Za-ząćęłńóśźżĄĆĘŁŃÓŚŹŻ-]{1,}"
NER_KEYWORDS = ("PESEL", "NIP", "REGON", "KRS", "IBAN", "VAT", "DOWÓD", "DOWOD")
ID_SHAPED = r"(?iU)^(?:PL\d{26}|\d{11}|\d{10}|\d{9}(?:\d{5})?|[A-Z]{3}\d{6})$"
HINT_WINDOW, BIRTH_WINDOW, STREET_WINDOW, CITY_WINDOW = 48, 48, 80, 40
HINT_BOOST = CITY_BOOST = 0.25
BIRTH_SCORE = 0.6
STREET_WORDS = ("ul.", "ulica", "al.", "os.", "adres", "poczt")


def candidates(text: Column, recognisers: Sequence[Recogniser], settings: Settings, ner: Ner | None = None) -> Column:
    """The union of what all recognisers, and the NER function if any, report."""
    parts = [r.candidates(text, settings) for r in recognisers]
    if ner is not None:
        named = F.coalesce(ner(text), F.array().cast("array<struct<start:int,`end`:int,entity:string,score:double>>"))

        def as_candidate(s: Column) -> Column:
            found = F.substring(text, s["start"] + 1, s["end"] - s["start"])
            return F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["entity"].alias("entity"), s["score"].cast("double").alias("score"), found.alias("text"), F.lit("ner").alias("source"), F.lit("ner").alias("context"))

        parts.append(F.transform(named, as_candidate).cast(f"array<{CANDIDATE}>"))
    return F.concat(F.array().cast(f"array<{CANDIDATE}>"), *parts)


def _label(entity: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in ENTITY_LABELS.items() for x in pair))[entity]


def _hinted(label: Column, window: Column) -> Column:
    hit = F.lit(False)
    for name, words in HINTS.items():
        hit = hit | ((label == name) & contains_any(window, words))
    return hit


def _annotated(text: Column, found: Column) -> Column:
    """Candidates with their label and what the gates ask about them."""

    def one(c: Column) -> Column:
        label = _label(c["entity"])
        window = before(text, c["start"], HINT_WINDOW)
        street = (label == "POSTAL") & contains_any(before(text, c["start"], STREET_WINDOW), STREET_WORDS)
        return F.struct(
            c["start"].alias("start"),
            c["end"].alias("end"),
            label.alias("label"),
            c["score"].alias("score"),
            c["text"].alias("text"),
            c["source"].alias("source"),
            F.trim(c["text"], F.lit(" .,:;")).alias("bare"),
            _hinted(label, window).alias("hint"),
            ((label == "CARD") & contains_any(window, HINTS["REGON"])).alias("regon"),
            ((label == "DOB") & before(text, c["start"], BIRTH_WINDOW).rlike(BIRTH)).alias("birth"),
            ((label == "POSTAL") & after(text, c["end"], CITY_WINDOW).rlike(CITY)).alias("city"),
            street.alias("street"),
        )

    return F.transform(found, one)


def _passes(c: Column) -> Column:
    """The gates; none depends on the score."""
    ner = c["source"] == "ner"
    label, found = c["label"], c["text"]
    spaced = F.contains(found, F.lit(" ")) | F.contains(found, F.lit("-"))
    compact = F.regexp_replace(found, "[ -]", "")
    return (
        label.isNotNull()
        & ~(ner & F.upper(c["bare"]).isin(*NER_KEYWORDS))
        & ~(ner & F.replace(c["bare"], F.lit(" "), F.lit("")).rlike(ID_SHAPED))
        & ((label != "DOB") | c["birth"])
        & ((label != "POSTAL") | c["hint"] | c["city"] | c["street"])
        & ((label != "CARD") | spaced | c["hint"])
        & ~((label == "CARD") & (F.length(compact) == 14) & c["regon"])
        & (~label.isin("NIP", "REGON") | c["hint"] | ((label == "NIP") & F.contains(found, F.lit("-"))))
    )


def _scored(c: Column) -> Column:
    score = F.when(c["label"] == "DOB", F.greatest(c["score"], F.lit(BIRTH_SCORE))).otherwise(c["score"])
    score = F.least(score + F.when(c["hint"], HINT_BOOST).otherwise(0.0), F.lit(1.0))
    score = F.least(score + F.when(c["city"], CITY_BOOST).otherwise(0.0), F.lit(1.0))
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["label"].alias("label"), F.round(score, 4).alias("score"), c["text"].alias("text"), c["source"].alias("source"))


def resolved(spans: Column) -> Column:
    """Greedy choice of disjoint spans: patterns before NER, then the higher score,
    the longer, the earlier, and the label's name to settle the rest; in order."""

    def keyed(s: Column) -> Column:
        return F.struct((s["source"] == "ner").alias("a"), (-s["score"]).alias("b"), (s["start"] - s["end"]).alias("c"), s["start"].alias("d"), s["label"].alias("e"), s.alias("span"))

    ordered = F.transform(F.array_sort(F.transform(spans, keyed)), lambda k: k["span"])

    def take(kept: Column, s: Column) -> Column:
        overlaps = F.exists(kept, lambda k: (s["end"] > k["start"]) & (s["start"] < k["end"]))
        return F.when(overlaps, kept).otherwise(F.concat(kept, F.array(s)))

    none = F.array().cast(SPANS)
    # spans is named once, as all that makes them would be evaluated again
    return F.coalesce(F.array_sort(F.aggregate(ordered.cast(SPANS), none, take)), none)


def spans_of(
    text: Column,
    settings: Settings | None = None,
    labels: Sequence[str] | None = None,
    threshold: Column | float | None = None,
    language: str | None = None,
    recognisers: Sequence[Recogniser] | None = None,
    ner: Ner | None = None,
) -> Column:
    """array<span> of a text column: sorted, disjoint; empty for null texts.

    labels None or empty means all. The threshold may be a column.
    """
    settings = settings or Settings()
    entities = entities_of(list(labels)) if labels else None
    chosen = pruned(registry(settings, language) if recognisers is None else recognisers, entities)
    least = F.lit(settings.score_threshold) if threshold is None else threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    found = candidates(F.coalesce(text, F.lit("")), chosen, settings, ner)
    scored = F.transform(F.filter(_annotated(text, found), _passes), _scored).cast(SPANS)
    if entities is not None and ner is not None:
        scored = F.filter(scored, lambda s: s["label"].isin(*labels))
    return resolved(F.filter(scored, lambda s: s["score"] >= least))


def detect(df: DataFrame, text: str = "text", output: str = "spans", **options) -> DataFrame:
    """df with the spans of its text column. Rows stay where they are."""
    return df.withColumn(output, spans_of(F.col(text), **options))


def long_form(df: DataFrame, key: str, spans: str = "spans") -> DataFrame:
    """One row a span: key, start, end, label, score, text, source.

    An inner explode would have the optimizer infer a filter on the array and push
    it below the projection that makes it, and all would be detected twice.
    """
    return df.select(key, F.explode_outer(spans).alias("s")).where("s is not null").select(key, "s.*")
