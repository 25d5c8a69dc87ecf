"""Recognisers: declarations from which candidate spans are planned.

A recogniser is a value. To extend the engine, make another Recogniser: patterns
with scores, context words, an optional validator (valid: score 1.0, invalid:
dropped) and an optional filter on the matched text. Patterns know all of Unicode.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions import checksums as ck
from veilspan.functions.text import before, contains_any, last_words, matches
from veilspan.model import CANDIDATE
from veilspan.settings import Settings


@dataclass(frozen=True)
class Recogniser:
    name: str
    entity: str
    #: (pattern, base score), each for itself
    patterns: tuple[tuple[str, float], ...]
    context: tuple[str, ...] = ()
    validator: Callable[[Column], Column] | None = None
    keep: Callable[[Column], Column] | None = None
    #: a cheap test of the whole text, false only where no pattern can match
    possible: Callable[[Column], Column] | None = None
    languages: tuple[str, ...] = ("pl", "en")

    def candidates(self, text: Column, settings: Settings) -> Column:
        """array<candidate> of one text."""
        empty = F.array().cast(f"array<{CANDIDATE}>")
        parts = [self._candidates(text, p, score, settings) for p, score in self.patterns]
        found = F.concat(*parts) if len(parts) > 1 else parts[0]
        return F.when(self.possible(text), found).otherwise(empty) if self.possible else found

    def _candidates(self, text: Column, pattern: str, base: float, settings: Settings) -> Column:
        found = matches(text, pattern)
        if self.keep:
            found = F.filter(found, lambda m: self.keep(m["text"]))
        if self.validator:
            found = F.filter(found, lambda m: F.coalesce(self.validator(m["text"]), F.lit(False)))
        own = 1.0 if self.validator else base

        def candidate(m: Column) -> Column:
            score = F.lit(own)
            if self.context and own < 1.0:
                near = last_words(before(text, m["start"], 200), settings.context_words)
                raised = min(1.0, max(own + settings.context_boost, settings.context_floor))
                score = F.when(contains_any(near, self.context), raised).otherwise(own)
            values = (m["start"], m["end"], F.lit(self.entity), score, m["text"], F.lit("pattern"), F.lit(self.name))
            return F.struct(*(v.alias(n) for v, n in zip(values, ("start", "end", "entity", "score", "text", "source", "context"), strict=True)))

        return F.transform(found, candidate).cast(f"array<{CANDIDATE}>")


def _rlike(pattern: str) -> Callable[[Column], Column]:
    return lambda text: text.rlike(pattern)


def _digits(n: int) -> Callable[[Column], Column]:
    """Enough ASCII digits in a row, or a digit of another script."""
    return _rlike(f"[0-9]{{{n}}}|(?U:[\\d&&[^0-9]])")


_some_digit = _digits(2)


def _compact(text: Column) -> Column:
    return F.regexp_replace(text, "[ -]", "")


# Patterns, scores, context words and the prefixes that are no plates.
_PHONE_CONTEXT = ("tel", "telefon", "kom", "komórka", "phone", "mobile", "fax", "kontakt", "dzwoń")
_PHONES = (
    (r"(?<!\w)\+48[ -]?(?:\d{3}[ -]?\d{3}[ -]?\d{3}|\d{2}[ -]?\d{3}[ -]?\d{2}[ -]?\d{2})(?!\d)", 0.75),
    (r"(?<!\d)(?<!\d[ -])\d{3}[ -]\d{3}[ -]\d{3}(?![ -]?\d)", 0.5),
    (r"(?<!\d)(?<!\d[ -])\d{2}[ -]\d{3}[ -]\d{2}[ -]\d{2}(?![ -]?\d)", 0.5),
    (r"(?<![\d+])\d{9}(?!\d)", 0.3),
)
_PLATE = r"\b[BCDEFGKLNOPRSTWZ][A-PR-Z]{1,2} ?(?=[0-9ACEFGHJKLMNPRSTUVWXY]{0,4}\d)[0-9ACEFGHJKLMNPRSTUVWXY]{4,5}\b"
_PLATE_CONTEXT = ("rejestracyjny", "rejestracyjne", "tablica", "tablice", "pojazd", "samochód", "auto", "rej", "rej.", "nr rej")
_NO_PLATES = ("ISO", "DIN", "IEC", "AST", "ANSI", "SKU", "VAT", "NIP", "REG", "KRS", "REF", "UE", "UN", "ID")
_STREET = (
    r"\b(?:[Uu]l\.|[Uu]lica|[Aa]l\.|[Aa]leja|[Oo]s\.|[Oo]siedle|[Pp]l\.|[Pp]lac)\s+\p{Lu}[\p{L}0-9. -]{1,40}?\s*\d{1,4}[A-Za-z]?(?:\s?/\s?\d{1,4}[A-Za-z]?)?\b"
)
_COMPANY = (
    r"\b\p{Lu}[\p{L}0-9&.'\-]{1,40}?(?:\s+\p{Lu}[\p{L}0-9&.'\-]{1,30}){0,4}\s+(?:Sp(?:ólka|\.)\s+z\s*o\.?\s*o\.?|S\.?A\.?|sp\.?\s*j\.?|sp\.?\s*k\.?|Sp\.\s*k\.)"
)
#: The same with the word spelled in full and an end to the legal form.
_COMPANY_STRICT = (
    r"\b\p{Lu}[\p{L}0-9&.'\-]{1,40}?(?:\s+\p{Lu}[\p{L}0-9&.'\-]{1,30}){0,4}\s+(?:Sp(?:ó[łl]ka|\.)\s+z\s*o\.?\s*o\.?|S\.?A\.?|sp\.?\s*j\.?|sp\.?\s*k\.?|Sp\.\s*k\.)(?!\w)"
)


def _plate_kept(found: Column) -> Column:
    compact = F.replace(found, F.lit(" "), F.lit(""))
    return ~(F.substring(compact, 1, 2).isin(*_NO_PLATES) | F.substring(compact, 1, 3).isin(*_NO_PLATES))


#: Where a legal form can start.
_LEGAL_FORM = r"(?U)\s(?:Sp(?:ó|\.)|S\.?A|sp\.?\s*[jk])"

# Patterns of types with a checksum or a simple shape.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"

PESEL = Recogniser("pesel", "PL_PESEL", ((r"(?<![\d+])\d{11}(?!\d)", 0.85),), ("pesel",), ck.is_pesel, possible=_digits(11))
NIP = Recogniser("nip", "PL_NIP", ((r"(?<!\d)(?:\d{10}|\d{3}-\d{3}-\d{2}-\d{2})(?!\d)", 0.85),), ("nip", "podatkowy", "vat"), lambda t: ck.is_nip(_compact(t)), possible=_some_digit)
REGON = Recogniser("regon", "PL_REGON", ((r"(?<!\d)(?:\d{14}|\d{9})(?!\d)", 0.85),), ("regon",), ck.is_regon, possible=_digits(9))
IBAN_PL = Recogniser("iban_pl", "IBAN_CODE", ((r"(?<!\w)PL ?\d{2}(?: ?\d{4}){6}(?!\d)", 0.85),), ("iban", "konto", "rachunek", "account"), ck.is_iban, possible=_some_digit)
IBAN_ANY = Recogniser(
    "iban", "IBAN_CODE", ((r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", 0.5),), ("iban", "konto", "rachunek", "account", "bank"), ck.is_iban, possible=_rlike("[A-Z]{2}[0-9]{2}|(?U:[\\d&&[^0-9]])")
)
PASSPORT = Recogniser("passport", "PL_PASSPORT", ((r"\b[A-Z]{2}\d{7}\b", 0.4),), ("paszport", "passport", "seria"), possible=_digits(7))
CARD = Recogniser("card", "CREDIT_CARD", ((r"(?<!\d)(?<!\d[ -])\d(?:[ -]?\d){12,18}(?![ -]?\d)", 0.85),), ("karta", "card", "credit", "płatnicza"), ck.is_luhn, possible=_rlike(r"[0-9](?:[ -]?[0-9]){12}|(?U:[\d&&[^0-9]])"))
EMAILS = Recogniser("email", "EMAIL_ADDRESS", ((EMAIL, 0.6),), ("email", "e-mail", "mail", "kontakt"), possible=lambda t: F.contains(t, F.lit("@")))
DOWOD = Recogniser("dowod", "PL_ID_CARD", ((r"\b[A-Z]{3} ?\d{6}\b", 0.5),), ("dowód", "dowod", "osobisty", "seria", "tożsamości"), ck.is_dowod, possible=_digits(6))
PHONE = Recogniser("phone", "PHONE_NUMBER", _PHONES, _PHONE_CONTEXT, possible=_some_digit)
PLATE = Recogniser("plate", "PL_PLATE", ((_PLATE, 0.3),), _PLATE_CONTEXT, keep=_plate_kept, possible=_rlike("[A-Z]{2}"))
POSTAL = Recogniser(
    "postal",
    "PL_POSTAL_CODE",
    ((r"\b\d{2}-\d{3}\b", 0.3),),
    ("pocztowy", "adres", "ul", "ul.", "ulica", "al.", "os.", "mieszka", "zamieszkania", "korespondencji", "zamieszkały", "zamieszkała"),
    possible=_rlike(r"(?U)\d-\d"),
)
ADDRESS = Recogniser("address", "PL_ADDRESS", ((_STREET, 0.6),), ("adres", "zamieszkania", "korespondencji", "mieszka"), possible=_rlike(r"(?U)(?:[Uu]l|[Aa]l|[Oo]s|[Pp]l)(?:\.|ica|eja|iedle|ac)\s+\p{Lu}"))
DOB = Recogniser("dob", "PL_DOB", ((r"\b\d{1,2}[./-]\d{1,2}[./-]\d{4}\b", 0.2), (r"\b\d{4}-\d{2}-\d{2}\b", 0.2)), possible=_rlike(r"(?U)\d[./-]\d"))
ORG = Recogniser("org", "ORGANIZATION", ((_COMPANY, 0.7),), ("firma", "sprzedawca", "nabywca", "spółka", "company", "regon", "nip"), possible=_rlike(_LEGAL_FORM))
ORG_STRICT = Recogniser("org_strict", "ORGANIZATION", ((_COMPANY_STRICT, 0.7),), ORG.context, possible=_rlike(_LEGAL_FORM))
KRS = Recogniser("krs", "PL_KRS", ((r"(?<!\d)\d{10}(?!\d)", 0.1),), ("krs",), possible=_digits(10))

STANDARD = (PESEL, NIP, REGON, IBAN_PL, PASSPORT, CARD, EMAILS, DOWOD, PHONE, PLATE, POSTAL, ADDRESS, DOB, ORG, IBAN_ANY)


def registry(settings: Settings, language: str | None = None) -> tuple[Recogniser, ...]:
    """The recognisers of a language (None: of any), KRS only if switched on."""
    every = STANDARD + ((KRS,) if settings.enable_krs else ())
    return tuple(r for r in every if language is None or language in r.languages)


def pruned(recognisers: Iterable[Recogniser], entities: set[str] | None) -> tuple[Recogniser, ...]:
    """Those that can report one of the entity types: the others are never planned."""
    return tuple(r for r in recognisers if entities is None or r.entity in entities)
