"""DuckDB SQL for the registered queries, written for itself wherever it can be:
spans from gaps between matches, checks from how an identifier was made, HMAC from
SHA-256, greedy choice by recursion."""

from __future__ import annotations

from veilspan.functions.crypto import pads
from veilspan.operators.recognizers import EMAIL
from veilspan.plans.queries import _CHECKS, _RAW, _SENTENCES, FOREIGN_IBAN, IDENTIFIERS, NOW, PUBLIC, STORE
from veilspan.sources.synthetic import corpus_sql, identifiers_sql

_IDS = "(SELECT o_orderkey AS id FROM orders)"
_MADE = identifiers_sql(_IDS)
_CORPUS = corpus_sql(_IDS)
_GOLD = f"(SELECT doc_id, e.start AS start, e.end AS \"end\", e.label AS label, e.text AS text FROM (SELECT doc_id, unnest(entities) AS e FROM {_CORPUS}))"
_PUBLIC = ", ".join(f"'{x}'" for x in PUBLIC)


def _hits(table: str, key: str, text: str, extra: str = "") -> str:
    """CTEs: hits (a row a document) and found (a row a match: i, start, t)."""
    return f"""hits AS (SELECT {key}, {extra} {text} AS body, regexp_extract_all({text}, '{EMAIL}') AS h, string_split_regex({text}, '{EMAIL}') AS g FROM {table}),
found AS (SELECT *, h[i] AS t, (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::INTEGER AS start
  FROM (SELECT *, unnest(range(1, len(h) + 1))::INTEGER AS i FROM hits))"""


_DOCS = _hits("documents", "doc_id", "text", "lang,")
_PAGES = _hits("pages", "page_id", "html")


def _spliced(new: str) -> str:
    return f"array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce({new}, '')), '')"


_NUMBERED = f"""{_DOCS}, firsts AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY min(start)) AS n FROM found GROUP BY doc_id, t),
tokens AS (SELECT doc_id, t, '[EMAIL_' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0') || ']' AS token FROM firsts)"""
_TOKENIZED = f"""WITH {_NUMBERED}, parts AS (SELECT doc_id, string_agg(g[i] || token, '' ORDER BY i) AS front, count(DISTINCT token) AS n FROM found JOIN tokens USING (doc_id, t) GROUP BY doc_id)
SELECT doc_id, coalesce(front, '') || g[len(g)] AS @NAME@MORE FROM hits LEFT JOIN parts USING (doc_id)"""


def _hex(purpose: str) -> tuple[str, str]:
    inner, outer = pads(STORE.derive("v1", purpose))
    return inner.hex(), outer.hex()


def _token(label: str, value: str, purpose: str) -> str:
    """The token of a canonical value, HMAC spelled out."""
    inner, outer = _hex(purpose)
    message = f"encode('tt-pii/v1' || chr(10) || {label} || chr(10) || {value})"
    first = f"unhex(sha256(unhex('{inner}') || {message}))"
    mac = f"sha256(unhex('{outer}') || {first})"
    return f"({label} || '_v1_' || rtrim(translate(base64(unhex(substr({mac}, 1, 30))), '+/', '-_'), '='))"


_CANONICAL_EMAIL = "(split_part({0}, '@', 1) || '@' || lower(substr({0}, strpos({0}, '@') + 1)))"

#: What the sentences of gate_<name> give: (prefix length, value, score) or None, by case.
_OUTCOMES = {
    "dob": (("9", "dob", 0.6), ("6", "dob", 0.6), None, None),
    "postal": (("7", "postal", 1.0), None, ("7", "postal", 0.55), None),
    "plate": (("22", "plate", 0.9), None, None, None),
    "krs": (("15", "krs", 0.7), None, None, ("7", "krs", 0.7)),
    "phone": (("5", "'6' || substr(m1, 2, 2) || m2 || m3", 0.65), None, ("6", "'6' || substr(m1, 2, 2) || ' ' || m2 || ' ' || m3", 0.5), ("6", "'+48 6' || substr(m1, 2, 2) || m2 || m3", 0.75)),
    "card": (("6", "card16", 1.0), None, ("6", "card", 1.0), None),
    "nip": (("4", "nip", 1.0), None, ("6", "nip_dashed", 1.0), None),
    "regon": (("6", "regon9", 1.0), None, ("7", "regon14", 1.0), None),
}


def _gate(name: str) -> str:
    def case(pick) -> str:
        arms = " ".join(f"WHEN {k} THEN {pick(o)}" for k, o in enumerate(_OUTCOMES[name]) if o)
        return f"CASE id % 4 {arms} END"

    start, value, score = case(lambda o: o[0]), case(lambda o: o[1]), case(lambda o: f"{o[2]}::DOUBLE")
    return f'SELECT id, ({start})::INTEGER AS start, (({start}) + length({value}))::INTEGER AS "end", {value} AS text, {score} AS score FROM {_MADE}'


_MEASURES = """round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp)::DOUBLE END, 4) AS precision, round(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn)::DOUBLE END, 4) AS recall,
 round(CASE WHEN tp = 0 AND (fp > 0 OR fn > 0) THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS f1, tp + fn AS support"""
_NOISY = f"""gold AS (SELECT * FROM {_GOLD}), kept AS (SELECT *, start + length(text) AS n FROM gold WHERE (start + length(text)) % 7 <> 3),
preds AS (SELECT doc_id, CASE WHEN n % 11 = 5 THEN start + 1 ELSE start END AS start, "end", label, CASE WHEN n % 13 = 1 AND label IN ('PESEL', 'NIP') THEN '1' || text ELSE text END AS text FROM kept
  UNION ALL SELECT doc_id, start, "end", label, text FROM kept WHERE n % 17 = 2),
tps AS (SELECT label, count(*) AS tp FROM (SELECT doc_id, start, "end", label FROM gold INTERSECT SELECT doc_id, start, "end", label FROM preds) GROUP BY label),
fps AS (SELECT label, count(*) AS fp FROM (SELECT doc_id, start, "end", label FROM preds EXCEPT SELECT doc_id, start, "end", label FROM gold) GROUP BY label),
fns AS (SELECT label, count(*) AS fn FROM (SELECT doc_id, start, "end", label FROM gold EXCEPT SELECT doc_id, start, "end", label FROM preds) GROUP BY label),
bad AS (SELECT label, count(*) AS invalid_fp FROM preds WHERE label IN ('PESEL', 'NIP') AND length(replace(text, '-', '')) <> CASE label WHEN 'PESEL' THEN 11 ELSE 10 END GROUP BY label),
each AS (SELECT label, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(invalid_fp, 0) AS invalid_fp
  FROM (SELECT DISTINCT label FROM gold) LEFT JOIN tps USING (label) LEFT JOIN fps USING (label) LEFT JOIN fns USING (label) LEFT JOIN bad USING (label)),
counts AS (SELECT * FROM each UNION ALL SELECT NULL, sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, 0 FROM each),
ratios AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp)::DOUBLE END AS p, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn)::DOUBLE END AS r FROM counts),
measured AS (SELECT label, tp, fp, fn, invalid_fp, {_MEASURES} FROM ratios)"""

_SPANS = ", ".join(
    f"{{'k': {k}, 'start': ((id * {a} + {k}) % 23)::INTEGER, 'end': ((id * {a} + {k}) % 23 + 1 + (id * {b} + {k}) % 9)::INTEGER, 'label': '{label}', 'score': (id * {c} + {k}) % 4, 'ner': (id + {k}) % 3 = 0}}"
    for k, (a, b, c, label) in enumerate(((7, 3, 5, "A"), (11, 5, 3, "B"), (13, 7, 7, "C"), (5, 11, 11, "D"), (3, 13, 13, "E"), (17, 2, 9, "F")))
)

_CANONICAL = {
    "PESEL": "pesel", "NIP": "nip", "REGON": "regon14", "KRS": "krs", "DOWOD": "dowod", "IBAN": "iban", "CARD": "card16", "PHONE": "'+486' || substr(m1, 2, 2) || m2 || m3",
    "EMAIL": "upper(split_part(email, '@', 1)) || '@' || split_part(email, '@', 2)", "PASSPORT": "passport", "PLATE": "plate", "POSTAL": "postal", "PERSON": "person", "ADDRESS": "street", "OTHER": "city",
}

ORACLE_SQL: dict[str, str] = {
    "email_spans": f"""WITH {_DOCS}, near AS (SELECT *, lower(array_to_string(list_filter(string_split_regex(substr(body, greatest(1, start - 199), least(200, start)), '\\s+'), lambda w: w <> '')[-5:], ' ')) AS before FROM found)
SELECT doc_id, start, start + length(t)::INTEGER AS "end", 'EMAIL' AS label, CASE WHEN contains(before, 'mail') OR contains(before, 'kontakt') THEN 0.95 ELSE 0.6 END::DOUBLE AS score, t AS text, 'pattern' AS source FROM near""",
    "email_counts_by_lang": f"WITH {_DOCS} SELECT lang, sum(len(h))::BIGINT AS n_spans, count(*) FILTER (len(h) > 0) AS n_docs FROM hits GROUP BY lang",
    "page_emails": f'WITH {_PAGES} SELECT page_id, start, start + length(t)::INTEGER AS "end", t AS text FROM found',
    "redact_replace": f"SELECT doc_id, regexp_replace(text, '{EMAIL}', '<EMAIL>', 'g') AS redacted_text FROM documents",
    "redact_mask": f"WITH {_DOCS} SELECT doc_id, {_spliced(chr(114) + 'epeat(' + chr(39) + '*' + chr(39) + ', length(h[i]))')} AS redacted_text FROM hits",
    "redact_hash": f"WITH {_DOCS} SELECT doc_id, {_spliced('substr(sha256(' + chr(39) + 'pepper' + chr(39) + ' || h[i]), 1, 16)')} AS redacted_text FROM hits",
    "redact_session": _TOKENIZED.replace("@NAME", "redacted_text").replace("@MORE", ""),
    "anonymize": _TOKENIZED.replace("@NAME", "anonymized_text").replace("@MORE", ", coalesce(n, 0)::INTEGER AS n_tokens"),
    "mapping": f"WITH {_NUMBERED} SELECT doc_id, token, t AS value FROM tokens",
    "restore": "SELECT doc_id, text AS restored_text FROM documents",
    "apply_results": f"SELECT doc_id, regexp_replace(text, '{EMAIL}', '<EMAIL>', 'g') AS anonymized_text, len(regexp_extract_all(text, '{EMAIL}'))::INTEGER AS n_items FROM documents",
    "applied_items": f"WITH {_DOCS} SELECT doc_id, 'replace' AS operator, 'EMAIL' AS entity_type, start, start + 7 AS \"end\" FROM found",
    "entities_allow_nothing": "SELECT doc_id, 0 AS n_results FROM documents",
    "summaries": f"WITH {_DOCS} SELECT doc_id, CASE WHEN len(h) > 0 THEN 'EMAIL×' || len(h) ELSE '' END AS summary FROM hits",
    "audit": f"WITH {_DOCS} SELECT doc_id, len(h)::INTEGER AS n_spans, len(h)::INTEGER AS n_email FROM hits",
    "audit_log": f"""WITH {_DOCS} SELECT '{{"event":"analyze","doc_id":' || doc_id || ',"n_spans":' || len(h) || ',"by_label":{{' || CASE WHEN len(h) > 0 THEN '"EMAIL":' || len(h) ELSE '' END || '}}}}' AS value FROM hits""",
    "size_guard": "SELECT doc_id, length(text) <= 5000 AS accepted, CASE WHEN length(text) > 5000 THEN 'text exceeds 5000 characters' END AS reason FROM documents",
    "response_json": f"WITH {_DOCS} SELECT doc_id, '{{\"doc_id\":' || doc_id || CASE WHEN len(h) > 0 THEN ',\"email\":\"' || h[1] || '\"' ELSE '' END || '}}' AS response FROM hits",
    "languages": "SELECT doc_id, CASE WHEN doc_id % 3 < 2 AND lang IN ('pl', 'en') THEN lang ELSE 'pl' END AS language FROM documents",
    "linkable_email": f"WITH {_DOCS} SELECT doc_id, {_spliced(_token(chr(39) + 'EMAIL' + chr(39), _CANONICAL_EMAIL.format('h[i]'), 'eval'))} AS redacted_text, len(h)::INTEGER AS pseudonymised, 0 AS replaced_fallback FROM hits",
    "luhn_runs": """WITH runs AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS digits FROM documents)
SELECT doc_id, digits, list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(digits), i, 1)::INTEGER ELSE substr(reverse(digits), i, 1)::INTEGER * 2 - CASE WHEN substr(reverse(digits), i, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0 AS valid
FROM runs WHERE length(digits) BETWEEN 13 AND 19""",
    **{f"check_{n}": f"SELECT id, CASE WHEN id % 2 = 0 THEN {good} ELSE {bad} END AS value, id % 2 = 0 AS valid FROM {_MADE}" for n, (good, bad, _) in _CHECKS.items()},
    "identifiers": f"SELECT id, {', '.join(IDENTIFIERS)} FROM {_MADE}",
    "redact_form": "SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty text' ELSE 'text exceeds 0 characters' END AS message, NULL::VARCHAR AS redacted_text FROM documents",
    "redact_form_texts": f"SELECT doc_id, message, CASE WHEN message IS NULL THEN regexp_replace(text, '{EMAIL}', '<EMAIL>', 'g') END AS redacted_text FROM (SELECT doc_id, text, CASE WHEN coalesce(trim(text), '') = '' THEN 'empty text' WHEN length(text) > 2000 THEN 'text exceeds 2000 characters' END AS message FROM documents)",
    "sql_functions": f"SELECT id, true AS a, false AS b, true AS c, false AS d, true AS e, true AS f, true AS g FROM {_IDS}",
    "canonical_forms": " UNION ALL ".join(f"SELECT id, '{label}' AS label, {_CANONICAL[label]} AS canonical FROM made" for label in _RAW).join((f"WITH made AS (SELECT * FROM {_MADE}) ", "")),
    "corpus": f"SELECT doc_id, template, language, text FROM {_CORPUS}",
    "gold": f"SELECT * FROM {_GOLD}",
    "template_histogram": f"SELECT template, count(*) AS n FROM {_CORPUS} GROUP BY template",
    "label_histogram": f"SELECT label, count(*) AS n FROM {_GOLD} GROUP BY label",
    "detect_all": f"SELECT * FROM {_GOLD} WHERE label IN ({_PUBLIC}, 'ORG')",
    "detect_counts": f"SELECT label, count(*) AS n_spans, count(DISTINCT doc_id) AS n_docs FROM {_GOLD} WHERE label IN ({_PUBLIC}, 'ORG') GROUP BY label",
    **{f"detect_{x.lower()}": f"SELECT doc_id, start, \"end\", text FROM {_GOLD} WHERE label = '{x}'" for x in (*PUBLIC, "ORG")},
    "evaluation": f"""WITH n AS (SELECT label, count(*) AS tp FROM {_GOLD} WHERE label IN ({_PUBLIC}) GROUP BY ROLLUP (label))
SELECT label, tp, 0::BIGINT AS fp, 0::BIGINT AS fn, 0::BIGINT AS invalid_fp, 1::DOUBLE AS precision, 1::DOUBLE AS recall, 1::DOUBLE AS f1, tp AS support FROM n""",
    "evaluation_noisy": f"WITH {_NOISY} SELECT * FROM measured",
    "gate_failures": f"""WITH {_NOISY}, gates(label, metric, floor) AS (VALUES ('PESEL', 'precision', 0.99), ('PESEL', 'recall', 0.5), ('PESEL', 'invalid_fp', 0), ('EMAIL', 'f1', 0.999), ('EMAIL', 'support', 1), ('CARD', 'recall', 0.1), ('NOSUCH', 'support', 3), ('micro', 'f1', 0.95)),
valued AS (SELECT g.label, g.metric, g.floor::DOUBLE AS floor, CASE g.metric WHEN 'precision' THEN precision WHEN 'recall' THEN recall WHEN 'f1' THEN f1 WHEN 'invalid_fp' THEN invalid_fp ELSE coalesce(support, 0) END::DOUBLE AS value FROM gates g LEFT JOIN measured m ON coalesce(m.label, 'micro') = g.label)
SELECT label, metric, value, floor FROM valued WHERE CASE WHEN metric = 'invalid_fp' THEN value > floor ELSE value < floor END""",
    "linkable_corpus": f"""SELECT doc_id, start, "end", label, CASE label WHEN 'DOB' THEN '<DOB>' WHEN 'EMAIL' THEN {_token("'EMAIL'", _CANONICAL_EMAIL.format("text"), "logs")} ELSE {_token("'PESEL'", "text", "logs")} END AS token FROM {_GOLD} WHERE label IN ('PESEL', 'EMAIL', 'DOB')""",
    "thresholds": f"SELECT doc_id, n::INTEGER AS low, n::INTEGER AS usual, n::INTEGER AS high FROM (SELECT doc_id, len(list_filter(entities, lambda e: e.label = 'DOWOD')) AS n FROM {_CORPUS})",
    **{f"gate_{n}": _gate(n) for n in _SENTENCES},
    "redact_all": f"SELECT doc_id, len(regexp_extract_all(text, '{EMAIL}'))::INTEGER AS n_spans, regexp_replace(text, '{EMAIL}', '<EMAIL>', 'g') AS redacted_text FROM documents",
    "phone_thresholds": f"SELECT id, 1 AS low, CASE WHEN id % 4 = 1 THEN 0 ELSE 1 END AS usual, CASE WHEN id % 4 IN (0, 3) THEN 1 ELSE 0 END AS high FROM {_MADE}",
    "detect_address": f"SELECT doc_id, start, \"end\", text FROM {_GOLD} WHERE label = 'ADDRESS' AND regexp_matches(text, '^(ul[.]|ulica|al[.]|os[.]) ')",
    "iban_foreign": f"""SELECT id, 8 AS start, 30 AS "end", 'IBAN' AS label, {FOREIGN_IBAN.replace("@TEXT", "VARCHAR")} AS text, 1.0::DOUBLE AS score FROM {_MADE} WHERE id % 2 = 0""",
    "apply_invalid": f"SELECT id, '<PERSON> ' || id || ' ends' AS anonymized_text, 1 AS n_items FROM {_IDS}",
    "pseudonym_vectors": """SELECT * FROM (VALUES (0::BIGINT, 'PESEL PESEL_v1_fzzu_5G20GpoNQQlp3ZH'), (1, 'PESEL PESEL_v1_XGPvBJJN6-rUTG3zQo_z'), (2, 'PESEL PESEL_v2_eTfHpnQFeCrpGZzI6eeL'),
 (3, 'PESEL PESEL_v1_BZPnD34ncx0LIUAiRqLo'), (4, 'NIP NIP_v1_ghXGz06HZxmAarmaoiL-'), (5, 'mail EMAIL_v1_Nq0EnCSRmSxCbQmH3IQX'), (6, 'tel. PHONE_v1_hcbj7kcotjZK9sD-tCE3'), (7, 'PESEL PESEL_v1_mblqjBAl6rbWcx1ArW32')) v(id, redacted_text)""",
    "card_digits": f"""SELECT id, 6 AS start, 37 AS "end", rtrim(regexp_replace(card16, '(.)', '\\1 ', 'g')) AS text, 1.0::DOUBLE AS score FROM {_MADE}""",
    "sql_letters": f"SELECT id, true AS a, false AS b, true AS c, false AS d, false AS e FROM {_IDS}",
    "rate_limit": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk AS (SELECT user_id, event_id, n, true AS accepted, NULL::BIGINT AS older, t AS newer FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, w.older IS NULL OR e.t - w.older > 3600000000, CASE WHEN w.older IS NULL OR e.t - w.older > 3600000000 THEN w.newer ELSE w.older END,
    CASE WHEN w.older IS NULL OR e.t - w.older > 3600000000 THEN e.t ELSE w.newer END FROM walk w JOIN e ON e.user_id IS NOT DISTINCT FROM w.user_id AND e.n = w.n + 1)
SELECT event_id, user_id, accepted FROM walk""",
    "ner_gates": f"SELECT id, 16 AS start, 20 AS \"end\", 'PERSON' AS label, substr(person || ' ' || city, 1, 4) AS text, 'ner' AS source FROM {_MADE}",
    "overlaps": f"""WITH RECURSIVE spans AS (SELECT id, unnest([{_SPANS}]) AS s FROM {_IDS}),
ordered AS (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY s.ner, s.score DESC, s.start - s.end, s.start, s.label) AS place FROM spans),
walk AS (SELECT id, 1::BIGINT AS place, [s] AS kept FROM ordered WHERE place = 1
  UNION ALL SELECT w.id, w.place + 1, CASE WHEN len(list_filter(w.kept, lambda k: o.s.end > k.start AND o.s.start < k.end)) > 0 THEN w.kept ELSE list_append(w.kept, o.s) END FROM walk w JOIN ordered o ON o.id = w.id AND o.place = w.place + 1)
SELECT id, k.start AS start, k.end AS "end", k.label AS label, CASE WHEN k.ner THEN 'ner' ELSE 'pattern' END AS source FROM (SELECT id, unnest(kept) AS k FROM walk WHERE place = 6)""",
    "vault": f"""SELECT e.event_id, 'to ' || CASE WHEN e.event_id % 5 = 0 THEN 'own' WHEN p.ts + INTERVAL 900 SECOND > TIMESTAMP '{NOW}' THEN 'u' || p.user_id ELSE '[EMAIL_001]' END || ', [EMAIL_002]' AS restored_text
FROM events e LEFT JOIN events p ON p.event_id = e.event_id - e.event_id % 2 AND p.event_id % 2 = 0""",
}
