"""A corpus pipeline: filter, deduplicate, mix and pack documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of docs. Rows that a stage keeps are whole, and other columns
of docs are carried along. Nulls, empty and repeated rows are as the operators
say; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import language, mixing, packing, simhash, toxicity
from veilspan.llm.common import crc_of_id, read, stored


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. The model learns from labelled
    documents outside the held-out quarter, as op1 does."""
    learned = F.pmod(crc_of_id(), F.lit(4)) != 2
    own = docs.where(learned).select("doc_id", "text")
    score = toxicity.scorer(spark, toxicity.train(own, read(spark, sf_dir, "labels").where(learned)))
    return docs.where(score(F.col("text")) < toxicity.THRESHOLD)


def reject_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; without letters, or with a margin that is
    narrow for the learned languages' texts of that length, they go."""
    own = docs.where(F.pmod(crc_of_id(), F.lit(5)) != 0)
    found = language.classifier(spark, *language.learn(own))
    named = docs.select(F.struct("*").alias("row"), found(F.col("text")).alias("found"))
    return named.where(language.accepted(F.col("found"))).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component. Of rows
    with that id, the text with the least hash, and of equal rows one."""
    found = simhash.near_duplicates(docs)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    one = stored(first.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("k")).select("k.*"), "keepers")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))

    def among(keepers: DataFrame) -> DataFrame:
        return rows.join(keepers, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")))

    single = among(one.where("n = 1")).select("row.*")
    again = among(one.where("n > 1")).groupBy("id", "hash").agg(F.first("row").alias("row")).select("row.*")
    return single.unionByName(again)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    sized = docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size"), F.struct("*").alias("row"))
    mixed = mixing.mix(sized).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, repeats included, in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("language", reject_unknown_language),
    ("simhash", one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
