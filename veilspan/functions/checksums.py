"""Checksums of identifiers, as expressions over string columns.

All take the bare digits (and letters) and are false for anything of the wrong
shape and null for null. Sums are folds over the characters, so Spark plans them
with no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.text import let

# The weights of the official checksums.
PESEL_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)
NIP_WEIGHTS = (6, 5, 7, 2, 3, 4, 5, 6, 7)
REGON9_WEIGHTS = (8, 9, 2, 3, 4, 5, 6, 7)
REGON14_WEIGHTS = (2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8)
DOWOD_WEIGHTS = (7, 3, 1, 0, 7, 3, 1, 7, 3)


def value_at(text: Column, k: int) -> Column:
    """The k-th character (from 1) as a number: digits as they are, A as 10."""
    code = F.ascii(F.substring(text, k, 1))
    return F.when(code <= 57, code - 48).otherwise(code - 55)


def weighted(text: Column, weights: Sequence[int]) -> Column:
    total = F.lit(0)
    for k, w in enumerate(weights, 1):
        if w:
            total = total + value_at(text, k) * w
    return total


def _checked(text: Column, shape: str, valid: Callable[[Column], Column]) -> Column:
    return let(text, lambda t: F.when(t.isNull(), None).otherwise(F.when(t.rlike(shape), valid(t)).otherwise(False)))


def is_pesel(text: Column) -> Column:
    return _checked(text, r"^[0-9]{11}$", lambda t: (10 - weighted(t, PESEL_WEIGHTS) % 10) % 10 == value_at(t, 11))


def is_nip(text: Column) -> Column:
    return _checked(text, r"^[0-9]{10}$", lambda t: weighted(t, NIP_WEIGHTS) % 11 == value_at(t, 10))


def is_regon9(text: Column) -> Column:
    return _checked(text, r"^[0-9]{9}$", lambda t: weighted(t, REGON9_WEIGHTS) % 11 % 10 == value_at(t, 9))


def is_regon14(text: Column) -> Column:
    return _checked(text, r"^[0-9]{14}$", lambda t: weighted(t, REGON14_WEIGHTS) % 11 % 10 == value_at(t, 14))


def is_regon(text: Column) -> Column:
    return F.when(F.length(text) == 14, is_regon14(text)).otherwise(is_regon9(text))


def is_dowod(text: Column) -> Column:
    compact = F.upper(F.replace(text, F.lit(" "), F.lit("")))
    return _checked(compact, r"^[A-Z]{3}[0-9]{6}$", lambda t: weighted(t, DOWOD_WEIGHTS) % 10 == value_at(t, 4))


def is_iban(text: Column) -> Column:
    """Mod 97 over the rearranged characters, letters as two digits."""

    def valid(t: Column) -> Column:
        moved = F.concat(F.substring(t, 5, 34), F.substring(t, 1, 4))
        left = F.aggregate(
            F.split(moved, ""),
            F.lit(0),
            lambda acc, c: F.when(F.ascii(c) <= 57, (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
        )
        return left == 1

    return _checked(F.upper(F.replace(text, F.lit(" "), F.lit(""))), r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$", valid)


def is_luhn(text: Column) -> Column:
    return _checked(F.regexp_replace(text, "[ -]", ""), r"^[0-9]{13,19}$", lambda t: F.call_function("luhn_check", t))


def valid_by_label(label: Column, text: Column) -> Column:
    """Whether a reported value passes its label's checksum; null for labels without."""
    bare = F.regexp_replace(text, "[ -]", "")
    close = F.replace(text, F.lit(" "), F.lit(""))
    return (
        F.when(label == "PESEL", is_pesel(text))
        .when(label == "NIP", is_nip(bare))
        .when(label == "REGON", is_regon(text))
        .when(label == "IBAN", is_iban(close))
        .when(label == "DOWOD", is_dowod(text))
        .when(label == "CARD", is_luhn(close))
    )
