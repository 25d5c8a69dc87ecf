"""Canonical forms of values, so that equal identifiers give equal pseudonyms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.model import STRUCTURED

_DIGITS = {"PESEL": (11,), "NIP": (10,), "REGON": (9, 14), "KRS": (10,), "CARD": tuple(range(13, 20))}


def nfkc() -> Callable[[Column], Column]:
    """Compatibility normalisation of an array of texts, in Arrow batches. Spark has
    none, and ASCII needs none: give null where nothing is to be done."""

    def run(column):
        import unicodedata

        return column.map(lambda texts: None if texts is None else [None if t is None else unicodedata.normalize("NFKC", t) for t in texts])

    return F.pandas_udf(run, "array<string>")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _if(shape: str, value: Column) -> Column:
    return F.when(value.rlike("(?U)" + shape), value)


def canonical(label: Column, raw: Column) -> Column:
    """The canonical form, null where a value can't be brought into one.

    raw is taken as normalised (see `nfkc`). Unknown labels keep the trimmed text.
    """
    text = strip(raw)
    name = F.upper(label)
    digits = F.regexp_replace(text, r"(?U)\D+", "")
    compact = F.upper(F.replace(text, F.lit(" "), F.lit("")))
    spaced = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    at = F.locate("@", text)
    local, domain = F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.length(text))
    email = F.when((at > 1) & (F.length(domain) > 0), F.concat(local, F.lit("@"), F.lower(domain)))
    dialled = F.regexp_replace(F.regexp_replace(text, r"(?U)[^\d+]", ""), "^00", "+")
    number = F.regexp_replace(dialled, r"^\+", "")
    phone = F.when(
        number.rlike(r"(?U)^\d{7,}$"),
        F.when(F.startswith(dialled, F.lit("+")), F.concat(F.lit("+"), number)).when(F.length(number) == 9, F.concat(F.lit("+48"), number)).otherwise(number),
    )
    code = F.replace(text, F.lit(" "), F.lit(""))
    postal = F.when(code.rlike(r"(?U)^\d{2}-?\d{3}$"), F.regexp_replace(code, r"(?U)^(\d{2})-?(\d{3})$", "$1-$2"))
    plate = strip(F.regexp_replace(F.upper(text), r"(?U)\s+", " "))
    cases = [(name == x, F.when(F.length(digits).isin(*n), digits)) for x, n in _DIGITS.items()]
    cases += [
        (name == "DOWOD", _if(r"^\p{L}{3}\d{6}$", compact)),
        (name == "IBAN", _if(r"^\p{L}{2}\d{2}(?s:.{11,})$", compact)),
        (name == "EMAIL", email),
        (name == "PHONE", phone),
        (name == "PASSPORT", _if(r"^[\p{L}\p{N}]{6,}$", compact)),
        (name == "PLATE", F.when(F.length(plate) >= 4, plate)),
        (name == "POSTAL", postal),
        (name.isin("PERSON", "ORG", "ADDRESS", "DOB"), F.when(spaced != "", spaced)),
    ]
    out = F
    for condition, value in cases:
        out = out.when(condition, value)
    return F.when(text != "", out.otherwise(text))


def structured(label: Column) -> Column:
    return label.isin(*STRUCTURED)
