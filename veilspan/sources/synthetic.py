"""A deterministic corpus with exact gold spans, made by arithmetic on row ids.

Every column is a SQL expression that Spark and DuckDB both take once the few
differences (Dialect) are filled in, so any row can be made again elsewhere. There
is no random state: rows can be made in any order, on any number of executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Dialect:
    name: str

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def text(self, x: str) -> str:
        return f"CAST({x} AS {'STRING' if self.spark else 'VARCHAR'})"

    def number(self, x: str) -> str:
        return f"CAST({x} AS BIGINT)"

    def whole(self, a: str, b: int) -> str:
        return f"({a} div {b})" if self.spark else f"({a} // {b})"

    def pick(self, values: tuple[str, ...], i: str) -> str:
        inside = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
        return f"element_at(array({inside}), CAST({i} AS INT) + 1)" if self.spark else f"list_extract([{inside}], CAST({i} AS INT) + 1)"

    def character(self, code: str) -> str:
        return f"char({code})" if self.spark else f"chr(CAST({code} AS INT))"

    def some(self, salt: int, n: int) -> str:
        """A number below n that depends on the row's id and the salt."""
        return f"((id * 2654435761 + {salt * 97 + 13} * 40503 + {salt * salt * 7919}) % 4294967291 % {n})"

    def digits(self, salt: int, n: int) -> str:
        return f"lpad({self.text(self.some(salt, 10**n))}, {n}, '0')"

    def digit(self, text: str, k: int) -> str:
        return f"CAST(substr({text}, {k}, 1) AS BIGINT)"

    def weighted(self, text: str, weights: tuple[int, ...]) -> str:
        return "(" + " + ".join(f"{w} * {self.digit(text, k)}" for k, w in enumerate(weights, 1) if w) + ")"

    def fragments(self, parts: list[tuple[str, str | None]]) -> str:
        if self.spark:
            kind = "named_struct('t', {}, 'l', {})"
        else:
            kind = "{{'t': {}, 'l': {}}}"
        null = "CAST(NULL AS STRING)" if self.spark else "CAST(NULL AS VARCHAR)"
        inside = ", ".join(kind.format(t, f"'{label}'" if label else null) for t, label in parts)
        return f"array({inside})" if self.spark else f"[{inside}]"


SPARK, DUCKDB = Dialect("spark"), Dialect("duckdb")

_MEN = ("Adam", "Igor", "Leon", "Oskar", "Filip", "Hubert", "Konrad", "Robert", "Szymon", "Wiktor")
_WOMEN = ("Alicja", "Celina", "Daria", "Eliza", "Halina", "Iga", "Lena", "Nina", "Olga", "Wanda")
_FAMILIES = ("Baran", "Bielik", "Czajka", "Dudek", "Gil", "Jeleń", "Kania", "Sowa", "Wilk", "Żuraw")
_STREETS = ("Akacjowa", "Bukowa", "Dębowa", "Jesienna", "Klonowa", "Łąkowa", "Miodowa", "Różana", "Wiosenna", "Źródlana")
_CITIES = ("Elbląg", "Gliwice", "Kielce", "Legnica", "Nysa", "Opole", "Płock", "Rybnik", "Sopot", "Zamość")
_FIRMS = ("Arka Sp. z o.o.", "Bryza S.A.", "Cis sp.j.", "Dąb Handel Sp. z o.o.", "Echo Serwis S.A.", "Fala Usługi Sp. z o.o.")
_DOMAINS = ("example.com", "example.org", "example.net", "example.pl", "mail.example.com")
_PLATES = ("WW", "KR", "GD", "PO", "DW", "SK", "LU", "EL", "ZS", "WPR", "KRA", "GDA")
_TAILS = ("A", "C", "E", "F", "G", "H", "J", "K", "L", "M")

#: Documents of each template in 3,000, in the order of their ids.
ALLOCATION = {"umowa": 444, "faktura": 384, "mixed": 313, "crm": 309, "email": 301, "przelew": 261, "paszport": 245, "pojazd": 244, "neg_checksum": 193, "neg_noise": 181, "en_mixed": 125}
CYCLE = sum(ALLOCATION.values())


def _identifiers(d: Dialect) -> list[dict[str, str]]:
    """Levels of columns; each may use those before."""
    two = lambda x: f"lpad({d.text(x)}, 2, '0')"
    year, month, day = f"(1955 + {d.some(1, 50)})", f"(1 + {d.some(2, 12)})", f"(1 + {d.some(3, 28)})"
    letter = lambda salt: d.character(f"65 + {d.some(salt, 26)}")
    code = lambda x, k: f"(ascii(substr({x}, {k}, 1)) - 55)"
    bases = {
        "b_year": year,
        "b_month": month,
        "b_day": day,
        "b_nip": d.digits(5, 9),
        "b_regon": d.digits(6, 8),
        "b_regon4": d.digits(7, 4),
        "b_iban1": d.digits(8, 9),
        "b_iban2": d.digits(9, 9),
        "b_iban3": d.digits(10, 6),
        "b_letters": f"concat({letter(11)}, {letter(12)}, {letter(13)})",
        "b_five": d.digits(14, 5),
        "b_card": f"concat('4', {d.digits(15, 9)}, {d.digits(16, 5)})",
        "b_krs": f"concat('0000', {d.digits(17, 6)})",
        "b_bare9": d.digits(18, 9),
        "b_bare10": f"concat('0', {d.digits(19, 9)})",
        "passport": f"concat({letter(20)}, {letter(21)}, {d.digits(22, 7)})",
        "postal": f"concat({d.digits(23, 2)}, '-', {d.digits(24, 3)})",
    }
    century = "CASE WHEN b_year >= 2000 THEN b_month + 20 ELSE b_month END"
    nip, nip_last = d.weighted("b_nip", (6, 5, 7, 2, 3, 4, 5, 6, 7)), d.digit("b_nip", 9)
    doubled = lambda k: f"({d.digit('b_card', k)} * 2 - CASE WHEN {d.digit('b_card', k)} > 4 THEN 9 ELSE 0 END)"
    luhn = " + ".join(doubled(k) if k % 2 else d.digit("b_card", k) for k in range(1, 16))
    serial = {
        "p10": f"concat({two('b_year % 100')}, {two(century)}, {two('b_day')}, {d.digits(4, 4)})",
        # a weighted sum of 10 mod 11 has no check digit; the next last digit has one
        "n9": f"CASE WHEN {nip} % 11 = 10 THEN concat(substr(b_nip, 1, 8), {d.text(f'({nip_last} + 1) % 10')}) ELSE b_nip END",
        "regon9": f"concat(b_regon, {d.text(d.weighted('b_regon', (8, 9, 2, 3, 4, 5, 6, 7)) + ' % 11 % 10')})",
        "card16": f"concat(b_card, {d.text(f'(10 - ({luhn}) % 10) % 10')})",
        "iban_left": f"(((({d.number('b_iban1')} % 97) * 1000000000 + {d.number('b_iban2')}) % 97) * 1000000000000 + {d.number('concat(b_iban3, ' + chr(39) + '252100' + chr(39) + ')')}) % 97",
        "dowod_check": f"(7 * {code('b_letters', 1)} + 3 * {code('b_letters', 2)} + {code('b_letters', 3)} + {d.weighted('b_five', (7, 3, 1, 7, 3))}) % 10",
        "krs_check": d.weighted("b_krs", (6, 5, 7, 2, 3, 4, 5, 6, 7)) + " % 11",
        "bare10_check": d.weighted("b_bare10", (6, 5, 7, 2, 3, 4, 5, 6, 7)) + " % 11",
        "bare9_check": d.weighted("b_bare9", (8, 9, 2, 3, 4, 5, 6, 7)) + " % 11 % 10",
    }
    next_digit = lambda text, k: f"concat(substr({text}, 1, {k - 1}), {d.text(f'({d.digit(text, k)} + 1) % 10')})"
    ids = {
        "pesel": f"concat(p10, {d.text('(10 - ' + d.weighted('p10', (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)) + ' % 10) % 10')})",
        "nip": f"concat(n9, {d.text(d.weighted('n9', (6, 5, 7, 2, 3, 4, 5, 6, 7)) + ' % 11')})",
        "r13": "concat(regon9, b_regon4)",
        "iban": f"concat('PL', lpad({d.text('98 - iban_left')}, 2, '0'), b_iban1, b_iban2, b_iban3)",
        "dowod": f"concat(b_letters, {d.text('dowod_check')}, b_five)",
        "bad_dowod": f"concat(b_letters, {d.text('(dowod_check + 1) % 10')}, b_five)",
        "card": "concat(substr(card16, 1, 4), ' ', substr(card16, 5, 4), ' ', substr(card16, 9, 4), ' ', substr(card16, 13, 4))",
        # digits that no checksum takes by accident
        "krs": f"CASE WHEN krs_check = {d.digit('b_krs', 10)} THEN {next_digit('b_krs', 10)} ELSE b_krs END",
        "bare10": f"CASE WHEN bare10_check = {d.digit('b_bare10', 10)} THEN {next_digit('b_bare10', 10)} ELSE b_bare10 END",
        "bare9": f"CASE WHEN bare9_check = {d.digit('b_bare9', 9)} THEN {next_digit('b_bare9', 9)} ELSE b_bare9 END",
        "plate": f"concat({d.pick(_PLATES, d.some(25, len(_PLATES)))}, CASE WHEN {d.some(26, 10)} < 7 THEN ' ' ELSE '' END, {d.digits(27, 4)}, CASE {d.some(28, 3)} WHEN 0 THEN {d.digits(29, 1)} WHEN 1 THEN {d.pick(_TAILS, d.some(30, len(_TAILS)))} ELSE '' END)",
        "style": d.some(31, 6),
        "m1": d.digits(32, 3),
        "m2": d.digits(33, 3),
        "m3": d.digits(34, 3),
        "l1": d.digits(35, 2),
        "dob": f"CASE {d.some(36, 3)} WHEN 0 THEN concat({two('b_day')}, '.', {two('b_month')}, '.', {d.text('b_year')}) WHEN 1 THEN concat({two('b_day')}, '/', {two('b_month')}, '/', {d.text('b_year')}) ELSE concat({d.text('b_year')}, '-', {two('b_month')}, '-', {two('b_day')}) END",
        "email": f"concat('u', {d.text('id')}, '.', {d.digits(37, 3)}, '@', {d.pick(_DOMAINS, d.some(38, len(_DOMAINS)))})",
        "person": f"CASE WHEN {d.some(39, 2)} = 0 THEN concat({d.pick(_MEN, d.some(40, 10))}, ' ', {d.pick(_FAMILIES, d.some(41, 10))}) ELSE concat({d.pick(_WOMEN, d.some(42, 10))}, ' ', {d.pick(_FAMILIES, d.some(43, 10))}) END",
        "street": f"concat({d.pick(('ul.', 'ulica', 'al.', 'os.'), d.some(44, 4))}, ' ', {d.pick(_STREETS, d.some(45, 10))}, ' ', {d.text('1 + ' + d.some(46, 120))}, CASE WHEN {d.some(47, 10)} < 4 THEN concat('/', {d.text('1 + ' + d.some(48, 40))}) ELSE '' END)",
        "city": d.pick(_CITIES, d.some(49, 10)),
        "firm": d.pick(_FIRMS, d.some(50, len(_FIRMS))),
        "number": d.text(f"1000 + {d.some(51, 9000)}"),
    }
    shown = {
        "regon14": f"concat(r13, {d.text(d.weighted('r13', (2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8)) + ' % 11 % 10')})",
        "bad_pesel": next_digit("pesel", 11),
        "bad_nip": next_digit("nip", 10),
        "bad_iban": next_digit("iban", 28),
        "nip_dashed": "concat(substr(nip, 1, 3), '-', substr(nip, 4, 3), '-', substr(nip, 7, 2), '-', substr(nip, 9, 2))",
        "phone": "CASE style WHEN 0 THEN concat('+48', '6', substr(m1, 2, 2), m2, m3) WHEN 1 THEN concat('+48 6', substr(m1, 2, 2), ' ', m2, ' ', m3)"
        " WHEN 2 THEN concat('+48 ', l1, ' ', m1, ' ', substr(m2, 1, 2), ' ', substr(m3, 1, 2)) WHEN 3 THEN concat('6', substr(m1, 2, 2), ' ', m2, ' ', m3)"
        " WHEN 4 THEN concat(l1, ' ', m1, ' ', substr(m2, 1, 2), ' ', substr(m3, 1, 2)) ELSE concat('6', substr(m1, 2, 2), m2, m3) END",
    }
    bounds, at = [], 0
    for name, n in ALLOCATION.items():
        at += n
        bounds.append(f"WHEN id % {CYCLE} < {at} THEN '{name}'")
    last = {
        "template": f"CASE {' '.join(bounds)} END",
        "nip_shown": f"CASE WHEN {d.some(52, 2)} = 0 THEN nip_dashed ELSE nip END",
        "regon": f"CASE WHEN {d.some(53, 10)} < 7 THEN regon9 ELSE regon14 END",
    }
    return [bases, serial, ids, shown, last]


def _templates(d: Dialect) -> dict[str, list[tuple[str, str | None]]]:
    """Fragments of each template: SQL of a text, and its label or None."""

    def t(text: str) -> tuple[str, None]:
        return "'" + text.replace("'", "''") + "'", None

    place = [("street", "ADDRESS"), t(", "), ("postal", "POSTAL"), t(" "), ("city", "ADDRESS")]
    # near misses: shaped like a plate, a postal code, a date of birth
    code = d.pick(("BX 40712", "GT 5502", "WK 90316", "LN 7781", "PO 60044"), d.some(54, 5))
    amount = d.pick(("40-640", "25-775", "60-905", "75-310"), d.some(55, 4))
    day = d.pick(("17.08.1996", "03-09-2007", "2018-04-23"), d.some(56, 3))
    english = d.pick(("Nora Lind", "Owen Marsh", "Tess Quill"), d.some(57, 3))
    return {
        "crm": [t("Rozmowa z: "), ("person", "PERSON"), t(". Reprezentuje spółkę "), ("firm", "ORG"), t(", wpisaną pod KRS "), ("krs", "KRS"), t(". Do rozliczeń podano kartę: karta "), ("card", "CARD"), t(", a odpowiedź ma trafić na "), ("email", "EMAIL"), t(" lub kom. "), ("phone", "PHONE"), t(".")],
        "pojazd": [t("Kolizja na parkingu, pojazd "), ("plate", "PLATE"), t(" prowadzi "), ("person", "PERSON"), t(" (PESEL "), ("pesel", "PESEL"), t("); pieniądze wysłać pod "), *place, t(".")],
        "en_mixed": [t("The PESEL we hold is "), ("pesel", "PESEL"), t("; please refund card "), ("card", "CARD"), t(" and tell "), (english, "PERSON"), t(" at "), ("email", "EMAIL"), t(".")],
        "neg_noise": [t("Pozycja "), ("number", None), t(" w spisie: towar "), (code, None), t(", partia od "), (amount, None), t(" sztuk, symbol "), ("bare9", None), t(", indeks "), ("bare10", None), t("; przegląd wypadł "), (day, None), t(" i nic więcej nie zapisano.")],
        "neg_checksum": [t("Zwrot do nadawcy ("), ("email", "EMAIL"), t("), bo nie zgadza się konto "), ("bad_iban", None), t(", dowód "), ("bad_dowod", None), t(", NIP "), ("bad_nip", None), t(" ani PESEL "), ("bad_pesel", None), t(".")],
        "umowa": [t("Zleceniobiorcą jest "), ("person", "PERSON"), t("; ur. "), ("dob", "DOB"), t("; legitymuje się dowodem "), ("dowod", "DOWOD"), t("; PESEL "), ("pesel", "PESEL"), t(". Można pisać na "), ("email", "EMAIL"), t(" albo dzwonić, tel. "), ("phone", "PHONE"), t(".\nMieszka pod: "), *place, t(".\nSprawa "), ("number", None), t(".")],
        "faktura": [t("Prosimy o wpłatę na konto "), ("iban", "IBAN"), t(" w ciągu tygodnia, pytania pod "), ("email", "EMAIL"), t("; sprawa "), ("number", None), t(" wystawiona przez "), ("firm", "ORG"), t(", REGON "), ("regon", "REGON"), t(", numer podatkowy NIP "), ("nip_shown", "NIP"), t(", biuro: "), *place, t(".")],
        "przelew": [t("Na konto "), ("iban", "IBAN"), t(" wpłynęło 318,40 zł.\nNadał "), ("person", "PERSON"), t(", a w opisie stoi NIP "), ("nip", "NIP"), t(" i słowo składka.")],
        "paszport": [t("Wyjazd za granicę: osoba urodzona "), ("dob", "DOB"), t(", paszport "), ("passport", "PASSPORT"), t(", PESEL "), ("pesel", "PESEL"), t(". Nazywa się "), ("person", "PERSON"), t(", mieszka przy "), ("street", "ADDRESS"), t(".")],
        "email": [t("Dzień dobry, mój telefon to "), ("phone", "PHONE"), t(", a PESEL "), ("pesel", "PESEL"), t(".\nProszę odpisać na "), ("email", "EMAIL"), t(".\n\n"), ("person", "PERSON")],
        "mixed": [t("Zestawienie; dowód "), ("dowod", "DOWOD"), t("; karta "), ("card", "CARD"), t("; auto "), ("plate", "PLATE"), t("; VAT "), ("nip", "NIP"), t("; REGON "), ("regon9", "REGON"), t("; rachunek "), ("iban", "IBAN"), t("; telefon "), ("phone", "PHONE"), t("; poczta "), ("email", "EMAIL"), t("; PESEL "), ("pesel", "PESEL"), t("; "), ("person", "PERSON"), t("; "), ("street", "ADDRESS"), t(", "), ("postal", "POSTAL"), t(" "), ("city", None)],
    }


def _document(d: Dialect) -> list[dict[str, str]]:
    cases = " ".join(f"WHEN '{name}' THEN {d.fragments(parts)}" for name, parts in _templates(d).items())
    if d.spark:
        text = "array_join(transform(fragments, x -> x.t), '')"
        at = "CAST(aggregate(slice(fragments, 1, i), CAST(0 AS BIGINT), (a, y) -> a + length(y.t)) AS INT)"
        gold = f"filter(transform(fragments, (x, i) -> named_struct('start', {at}, 'end', {at} + length(x.t), 'label', x.l, 'text', x.t)), s -> s.label IS NOT NULL)"
        name = "format_string('doc-%06d', id)"
    else:
        text = "array_to_string(list_transform(fragments, lambda x: x.t), '')"
        at = "CAST(coalesce(list_sum(list_transform(fragments[1:i - 1], lambda y: length(y.t))), 0) AS INT)"
        gold = f"list_filter(list_transform(range(1, len(fragments) + 1), lambda i: {{'start': {at}, 'end': CAST({at} + length(fragments[i].t) AS INT), 'label': fragments[i].l, 'text': fragments[i].t}}), lambda s: s.label IS NOT NULL)"
        name = "'doc-' || lpad(CAST(id AS VARCHAR), CAST(greatest(6, length(CAST(id AS VARCHAR))) AS INTEGER), '0')"
    return [{"fragments": f"CASE template {cases} END"}, {"doc_id": name, "language": "CASE template WHEN 'en_mixed' THEN 'en' ELSE 'pl' END", "text": text, "entities": gold}]


def with_identifiers(rows: DataFrame) -> DataFrame:
    """rows (id long, ...) with one column for each kind of identifier."""
    return _spark(rows, _identifiers(SPARK))


def _spark(rows: DataFrame, levels: list[dict[str, str]]) -> DataFrame:
    for level in levels:
        rows = rows.selectExpr("*", *(f"{sql} AS `{name}`" for name, sql in level.items()))
    return rows


def corpus(rows: DataFrame) -> DataFrame:
    """rows (id long) to doc_id, template, language, text, entities."""
    full = _spark(rows.selectExpr("CAST(id AS BIGINT) AS id"), _identifiers(SPARK) + _document(SPARK))
    return full.select("doc_id", "template", "language", "text", "entities")


def _sql(source: str, levels: list[dict[str, str]]) -> str:
    sql = source
    for level in levels:
        columns = ", ".join(f'{x} AS "{name}"' for name, x in level.items())
        sql = f"(SELECT *, {columns} FROM {sql})"
    return sql


def identifiers_sql(source: str) -> str:
    """The same for DuckDB: a subquery over source, which has a column id."""
    return _sql(source, _identifiers(DUCKDB))


def corpus_sql(source: str) -> str:
    return f"(SELECT doc_id, template, language, text, entities FROM {_sql(source, _identifiers(DUCKDB) + _document(DUCKDB))})"


