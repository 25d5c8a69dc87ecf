"""Schemas and vocabularies."""

from __future__ import annotations

SPAN = "struct<start:int,`end`:int,label:string,score:double,text:string,source:string>"
SPANS = f"array<{SPAN}>"
CANDIDATE = "struct<start:int,`end`:int,entity:string,score:double,text:string,source:string,context:string>"
GOLD = "id string, template string, language string, text string, entities array<struct<start:int,`end`:int,label:string,text:string>>"
GATES = "label string, precision double, recall double, f1 double, max_invalid_fp int, min_support int"
VAULT = "session_id string, mapping map<string,string>, expires_at timestamp"

LANGUAGES = ("pl", "en")

# Entity types and the labels that they are reported as.
ENTITY_LABELS = {
    "PERSON": "PERSON",
    "ORGANIZATION": "ORG",
    "PL_PESEL": "PESEL",
    "PL_NIP": "NIP",
    "PL_REGON": "REGON",
    "PL_KRS": "KRS",
    "PL_ID_CARD": "DOWOD",
    "PL_PASSPORT": "PASSPORT",
    "IBAN_CODE": "IBAN",
    "PHONE_NUMBER": "PHONE",
    "EMAIL_ADDRESS": "EMAIL",
    "PL_POSTAL_CODE": "POSTAL",
    "PL_ADDRESS": "ADDRESS",
    "LOCATION": "ADDRESS",
    "PL_DOB": "DOB",
    "DATE_TIME": "DOB",
    "CREDIT_CARD": "CARD",
    "PL_PLATE": "PLATE",
}

LABELS = tuple(sorted(set(ENTITY_LABELS.values())))
# Labels whose values have a structure of their own.
STRUCTURED = ("PESEL", "NIP", "REGON", "DOWOD", "IBAN", "CARD", "EMAIL", "PHONE", "PASSPORT", "PLATE", "KRS", "POSTAL")


def entities_of(labels: list[str] | tuple[str, ...]) -> set[str]:
    """The entity types of labels; an unknown label is an error."""
    unknown = sorted(set(labels) - set(LABELS))
    if unknown:
        raise ValueError(f"unknown labels: {', '.join(unknown)}")
    return {e for e, label in ENTITY_LABELS.items() if label in labels}


def label_of(entity: str) -> str | None:
    """The label of an entity type or of a label itself; None for anything else."""
    return ENTITY_LABELS.get(entity) or (entity if entity in LABELS else None)


def labels_allowed(names: list[str] | None) -> list[str] | None:
    """An allow-list in either vocabulary as labels, in order, each once.

    None means everything, and so does an empty list. A list that names nothing
    known allows nothing: it gives an empty list.
    """
    if not names:
        return None
    return list(dict.fromkeys(label for label in map(label_of, names) if label))
