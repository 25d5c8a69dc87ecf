"""The scalar functions as SQL functions, which Spark inlines into a plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from veilspan.functions import checksums as ck

_WEIGHTS = {"pesel": ck.PESEL_WEIGHTS, "nip": ck.NIP_WEIGHTS, "regon9": ck.REGON9_WEIGHTS, "regon14": ck.REGON14_WEIGHTS}


def _sum(weights: tuple[int, ...]) -> str:
    return " + ".join(f"{w} * (ascii(substr(t, {k}, 1)) - 48)" for k, w in enumerate(weights, 1) if w)


def _shaped(n: int, test: str) -> str:
    return f"CASE WHEN t IS NULL THEN NULL WHEN t RLIKE '^[0-9]{{{n}}}$' THEN {test} ELSE false END"


FUNCTIONS = {
    "is_pesel": _shaped(11, f"(10 - ({_sum(_WEIGHTS['pesel'])}) % 10) % 10 = ascii(substr(t, 11, 1)) - 48"),
    "is_nip": _shaped(10, f"({_sum(_WEIGHTS['nip'])}) % 11 = ascii(substr(t, 10, 1)) - 48"),
    "is_regon9": _shaped(9, f"({_sum(_WEIGHTS['regon9'])}) % 11 % 10 = ascii(substr(t, 9, 1)) - 48"),
    "is_regon14": _shaped(14, f"({_sum(_WEIGHTS['regon14'])}) % 11 % 10 = ascii(substr(t, 14, 1)) - 48"),
    "is_card": "CASE WHEN t IS NULL THEN NULL WHEN regexp_replace(t, '[ -]', '') RLIKE '^[0-9]{13,19}$' THEN luhn_check(regexp_replace(t, '[ -]', '')) ELSE false END",
}

_MOVED = "concat(substr(upper(replace(t, ' ', '')), 5), substr(upper(replace(t, ' ', '')), 1, 4))"
# letters as two digits, A as 10, and the remainder digit by digit
_NUMBERS = f"transform(split({_MOVED}, ''), c -> CASE WHEN c RLIKE '[0-9]' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
_REMAINDER = f"aggregate({_NUMBERS}, 0, (a, x) -> (CASE WHEN x < 10 THEN a * 10 + x ELSE a * 100 + x END) % 97)"
_LETTERS = " + ".join(f"{w} * (ascii(substr(u, {k}, 1)) - {55 if k <= 3 else 48})" for k, w in enumerate(ck.DOWOD_WEIGHTS, 1) if w)
_BARE = "upper(replace(t, ' ', ''))"
FUNCTIONS |= {
    "is_iban": f"CASE WHEN t IS NULL THEN NULL WHEN {_BARE} RLIKE '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}$' THEN {_REMAINDER} = 1 ELSE false END",
    "is_dowod": f"CASE WHEN t IS NULL THEN NULL WHEN {_BARE} RLIKE '^[A-Z]{{3}}[0-9]{{6}}$' THEN ({_LETTERS.replace('substr(u', f'substr({_BARE}')}) % 10 = ascii(substr({_BARE}, 4, 1)) - 48 ELSE false END",
}


def register(spark: SparkSession) -> list[str]:
    """CREATE TEMPORARY FUNCTION for each; returns their names."""
    for name, body in FUNCTIONS.items():
        kind = "BOOLEAN"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    return sorted(FUNCTIONS)
