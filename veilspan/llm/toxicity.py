"""Toxicity by FTRL-proximal logistic regression over hashed n-grams.

Features are the words, their stems (first bytes, as many as STEMS has), word pairs,
and pairs with one word between, of the whole text, hashed into 2^BITS places, each
counted once. Follow-the-regularised-leader keeps a learning rate for each coordinate,
and its L1 term leaves most weights at zero, so the model that goes to the workers is
a short sparse vector.

The model is fitted on at most TRAIN labelled rows, those whose hashed ids are
least; everything else covers all documents. The settings were chosen by
cross-validation among rows that op1 may learn from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import crc_of_id, read

BITS = 20
STEMS = (3, 4, 5, 6, 7, 8)
ALPHA, BETA, L1, L2 = 0.5, 1.0, 10.0, 1.0
EPOCHS = 5
#: Most labelled rows that the model is fitted on.
TRAIN = 12_000
#: A score from here on predicts the label 1.
THRESHOLD = 0.3


def features(text: str | None) -> np.ndarray:
    """Places of the text's n-grams, with repeats."""
    import regex

    words = [w.encode() for w in regex.findall(r"[\w']+", (text or "").lower())]
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    skips = (h[:-2] * np.uint64(0x165667B19E3779F9)) ^ (h[2:] * np.uint64(0x27D4EB2F165667C5))
    every = [h * np.uint64(0xFF51AFD7ED558CCD), pairs, skips]
    once = set(words)
    for size in STEMS:
        stems = {w[:size] for w in once if len(w) > size}
        every.append(np.fromiter(map(zlib.crc32, stems), np.uint64, len(stems)) * np.uint64(0xD6E8FEB86659FD93 ^ size))
    return (np.concatenate(every) >> np.uint64(64 - BITS)).astype(np.int64)


def fit(texts: list[str | None], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, bias): the weights that are not zero."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    rows = [np.unique(features(t)).astype(np.int32) for t in texts]
    bz = bn = 0.0
    for _ in range(epochs):
        for at, y in zip(rows, labels, strict=True):
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= L1, 0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            bias = -bz / ((BETA + bn**0.5) / ALPHA)
            g = _sigmoid(w.sum() + bias) - y
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] += g * g
            bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / ALPHA * bias
            bn += g * g
    w = np.where(np.abs(z) <= L1, 0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    places = np.flatnonzero(w)
    return places, w[places], -bz / ((BETA + bn**0.5) / ALPHA)


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["__order"], r["__text"] or "", r["__label"]))
    places, weights, bias = fit([r["__text"] for r in rows], [r["__label"] for r in rows])
    yield pa.RecordBatch.from_arrays([pa.array(np.append(places, -1)), pa.array(np.append(weights, bias))], ["place", "weight"])


def learned(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = TRAIN) -> DataFrame:
    """(__order, __text, __label) of the labelled documents that are learned from:
    `most`, or all if there are fewer. Rows with a null id or label take no part. A
    repeated id has its greatest label and its least text."""
    named = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(label).cast("int").alias("__label"))
    named = named.join(docs.select(F.col(key).alias("__key")).distinct(), "__key", "left_semi")
    chosen = named.withColumn("__order", F.xxhash64(F.col("__key").cast("string"))).orderBy("__order", "__key").limit(most)
    # `most` short rows at most are broadcast
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__key")
    return rows.groupBy("__key", "__order", "__label").agg(F.min("__text").alias("__text")).select("__order", "__text", "__label")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = TRAIN) -> tuple[np.ndarray, np.ndarray, float]:
    """The model of the labelled rows; without any it is empty, and every score is 0.5."""
    rows = learned(docs, labels, key, text, label, most)
    model = rows.repartition(1).mapInArrow(_fit_rows, "place long, weight double").collect()
    places = np.array([r["place"] for r in model if r["place"] >= 0], np.int64)
    weights = np.array([r["weight"] for r in model if r["place"] >= 0])
    return places, weights, next((r["weight"] for r in model if r["place"] < 0), 0.0)


def scorer(spark: SparkSession, model: tuple[np.ndarray, np.ndarray, float]):
    """A function of a text column: the probability of label 1, null scored as empty."""
    # the weights that are not zero, at most 2^BITS
    held = spark.sparkContext.broadcast(model)

    def run(column):
        import pandas as pd

        places, weights, bias = held.value
        w = np.zeros(1 << BITS)
        w[places] = weights
        out = []
        for text in column:
            at = features(text)
            at = np.unique(at[w[at] != 0])
            out.append(_sigmoid(w[at].sum() + bias))
        return pd.Series(out, dtype="float64")

    udf = F.pandas_udf(run, "double")

    def score(text: Column) -> Column:
        return udf(text)

    return score


def score_toxicity(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, text: str = "text", name: str = "score", **named) -> DataFrame:
    """docs with the score column `name`; a column of that name is replaced.

    Null and empty texts get the score of no features. Repeated rows get equal
    scores. An empty table stays empty.
    """
    return docs.withColumn(name, scorer(docs.sparkSession, train(train_docs, labels, text=text, **named))(F.col(text)))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(crc_of_id(), F.lit(4)) == 2
    labels = read(spark, sf_dir, "labels").where(~held_out)
    scored = score_toxicity(docs, docs.where(~held_out), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
