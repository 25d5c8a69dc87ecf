"""An adapter that lets any model of named entities take part in detection.

No model is bundled. A model is a function of a batch of texts that gives, for each,
(start, end, tag, score) of every entity; tags of both families below are known. It
runs over Arrow batches, once for each text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Model = Callable[[Sequence[str]], Iterable[Iterable[tuple[int, int, str, float]]]]

# Tags of the Polish and the English models, and tags that are no entity.
TAGS = {
    "pl": {"persName": "PERSON", "orgName": "ORGANIZATION", "placeName": "LOCATION", "geogName": "LOCATION", "date": "DATE_TIME"},
    "en": {"PERSON": "PERSON", "ORG": "ORGANIZATION", "GPE": "LOCATION", "LOC": "LOCATION", "FAC": "LOCATION", "DATE": "DATE_TIME"},
}
IGNORED = ("time", "TIME", "CARDINAL", "ORDINAL", "QUANTITY", "MONEY", "PERCENT", "LANGUAGE", "LAW", "WORK_OF_ART", "EVENT", "PRODUCT", "NORP")
FOUND = "array<struct<start:int,`end`:int,entity:string,score:double>>"


def entity_of(tag: str, language: str | None = None) -> str | None:
    """The entity type of a tag, None for one that is ignored or unknown."""
    if tag in IGNORED:
        return None
    families = [TAGS[language]] if language else TAGS.values()
    return next((tags[tag] for tags in families if tag in tags), None)


def adapter(model: Model, language: str | None = None) -> Callable[[Column], Column]:
    """`ner` for an Engine or for `detect`. Null texts are not shown to the model;
    entities that are empty or outside their text are passed over."""

    def run(column):
        import pandas as pd

        texts = [t for t in column if t is not None]
        answers = iter(model(texts) if texts else ())
        out = []
        for text in column:
            found = []
            for start, end, tag, score in next(answers) if text is not None else ():
                entity = entity_of(tag, language)
                if entity and 0 <= start < end <= len(text):
                    found.append({"start": start, "end": end, "entity": entity, "score": float(score)})
            out.append(found)
        return pd.Series(out, dtype="object")

    udf = F.pandas_udf(run, FOUND)

    def ner(text: Column) -> Column:
        return udf(text)

    return ner
