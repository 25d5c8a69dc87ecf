"""Mixing sources to target weights by Pareto order sampling, natively.

Every source gets a target number of words. A document's expected copies are in
proportion to its weight (equal, unless a column of weights is named), such that
they come to the target; the whole part is certain, the rest is its inclusion
probability p. Documents are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and the sample is the prefix of that order whose
words come nearest to what the certain copies leave of the target. u is a hash
of the document's id, so reruns agree.

The prefix is found without sorting a source in one task: words are summed per
(source, bucket of the order), running sums over COARSE coarse and then COARSE fine
buckets name the one bucket where the prefix ends, and only that bucket's rows are
ordered, equal ones counted first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan.llm.common import read, stored

#: Weights that the sources take in turn, by code point of their names, null last.
WEIGHTS = (5, 2, 1)
#: The mix's size as a share of all words, and the most copies of a document.
SHARE_PERCENT = 150
MOST_COPIES = 2
#: Coarse buckets of the rank order in each source, and fine ones in each of them.
COARSE = 1 << 8
BUCKETS = COARSE * COARSE
SEED = "mix-1"


def words(text: Column) -> Column:
    """Number of words of the whole text; 0 for null."""
    # \S is WORD's class in Java; possessive, as nothing is ever given back
    return F.coalesce(F.regexp_count(text, F.lit(r"\S++")), F.lit(0)).cast("long")


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on key and seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) to (source, source_size, target), one row a source.

    The budget is shared by weight; a source stops at `most` times its size and
    what it leaves is shared among the others. That fixed point is a water level:
    with sources ordered by source_size / weight, those below the level stop, and
    the others get level * weight. Empty sources get 0.
    """
    each = F.element_at(F.array(*map(F.lit, weights)), ((F.col("__n") - 1) % len(weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.select("source", "source_size", F.row_number().over(by_name).alias("__n")).withColumn("__w", each.cast("long"))
    # exact integer comparison of source_size / weight
    order = Window.orderBy(F.col("source_size") * (F.lit(_lcm(weights)) / F.col("__w")).cast("long"), F.col("__n"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns({"__full": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "__used": F.coalesce(F.sum("__w").over(before), F.lit(0))})
    everything = Window.partitionBy()
    w = w.withColumns({"__all": F.sum("source_size").over(everything), "__weight": F.sum("__w").over(everything)})
    w = w.withColumns({"__left": F.col("__all") * share_percent - F.col("__full") * most * 100, "__rest": F.col("__weight") - F.col("__used")})
    # below the level: most * size * rest * 100 <= left * weight
    w = w.withColumn("__stops", F.col("source_size").cast("decimal(38,0)") * F.lit(most * 100) * F.col("__rest") <= F.col("__left").cast("decimal(38,0)") * F.col("__w"))
    w = w.withColumn("__top", F.min(F.when(~F.col("__stops"), F.struct(F.row_number().over(order).alias("n"), F.col("__left").alias("l"), F.col("__rest").alias("r")))).over(everything))
    level = (F.col("__top.l") * F.col("__w")).cast("double") / (F.col("__top.r") * 100).cast("double")
    target = F.when(F.col("__stops"), (F.col("source_size") * most).cast("double")).otherwise(level)
    return w.select("source", "source_size", target.alias("target"))


def _lcm(values: Sequence[int]) -> int:
    import math

    return math.lcm(*values)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _passed(sums: DataFrame, bucket: str) -> DataFrame:
    """(source, bucket, s, start, need) to (source, need, bucket, before): the first
    bucket whose running sum, from `start`, passes the need, and the sum before it;
    null if none does."""
    running = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    cuts = sums.withColumn("before", F.col("start") + F.coalesce(F.sum("s").over(running), F.lit(0)))
    over = (F.col("before") <= F.col("need")) & (F.col("before") + F.col("s") > F.col("need"))
    first = F.min(F.when(over, F.struct(F.col(bucket).alias("bucket"), "before"))).alias("m")
    return cuts.groupBy("source").agg(F.first("need").alias("need"), first).select("source", "need", "m.bucket", "m.before")


def _levels(d: DataFrame, goal: DataFrame, most: int) -> DataFrame:
    """(source, target) and documents (source, size, __w) to (source, __level): expected
    copies are weight * level, `most` at most, and come to the target if they can."""
    levels = goal.select("source", "target", F.lit(0.0).alias("__level"))
    while True:
        near = levels.select(F.col("source").alias("__src"), F.col("target").alias("__t"), "__level")
        rows = d.join(near, _same("source", "__src"))
        full = F.col("__w") * F.col("__level") >= most
        sums = rows.groupBy("source").agg(F.first("__t").alias("target"), F.first("__level").alias("__old"), F.sum(F.when(full, F.col("size")).otherwise(0)).alias("f"), F.sum(F.when(full, 0.0).otherwise(F.col("__w") * F.col("size"))).alias("m"))
        new = F.when(F.col("m") > 0, F.greatest(F.col("__old"), (F.col("target") - most * F.col("f")) / F.col("m"))).otherwise(F.col("__old"))
        found = stored(sums.select("source", "target", "__old", new.alias("__level")), "mix-levels")
        levels = found.drop("__old")
        # each round fills more documents to `most`, or ends
        if found.where(F.col("__level") > F.col("__old") * (1 + 1e-12)).isEmpty():
            return levels


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_COPIES, seed: str = SEED, odds: str | None = None) -> DataFrame:
    """(doc_id, source, size, ...) to the same with source_size, target and copies.

    `odds` names a column of weights: a document's expected copies are in proportion
    to it in its source, up to `most`; null, negative and non-finite weights are 0,
    and a document of weight 0 is never taken. Without it all weigh the same.

    Rows with the same id in a source share their random number and are told
    apart by size; rows with equal id, source and size are interchangeable. Null ids
    count as the empty id, null sources are a source of their own, an empty table
    gives an empty table. Other columns are carried along; put those whose names could
    clash into one struct. Documents without words get the certain copies alone.
    Sums over a source are taken per (source, bucket) first, and equal rows are
    counted, so neither a source with a third of all rows nor an often repeated id is
    a hot key.
    """
    carried = [c for c in docs.columns if c not in ("doc_id", "source", "size")]
    d = docs.withColumn("size", F.col("size").cast("long")).withColumn("__u", uniform(F.col("doc_id"), seed))
    goal = stored(targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share_percent, most), "mix-targets")
    if odds is None:
        expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    else:
        w = F.col(odds).cast("double")
        d = d.withColumn("__w", F.when((w > 0) & (w < float("inf")), w).otherwise(0.0))
        level = _levels(d.select("source", "size", "__w"), goal, most).select(F.col("source").alias("__src"), "__level")
        goal = goal.join(level, _same("source", "__src")).drop("__src")
        expected = F.least(F.col("__w") * F.col("__level"), F.lit(float(most)))

    def ranked(rows: DataFrame, by: DataFrame) -> DataFrame:
        """Rows with what their source has, certain copies, p, and place in the order."""
        rows = rows.join(by.withColumnRenamed("source", "__src"), _same("source", "__src")).drop("__src")
        rows = rows.withColumn("__e", expected).withColumn("__copies", F.floor("__e")).withColumn("__p", F.col("__e") - F.col("__copies"))
        # o / (1 + o) for the odds o = (u / (1 - u)) / (p / (1 - p)): the same order, within 0 and 1
        high, low = F.col("__u") * (1 - F.col("__p")), F.col("__p") * (1 - F.col("__u"))
        rows = rows.withColumn("__t", F.when(F.col("__p") > 0, high / (high + low)))
        return rows.withColumn("__b", F.least(F.floor(F.col("__t") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))

    sums = ranked(d, goal).groupBy("source", "__b").agg(F.sum("size").alias("s"), F.sum(F.col("__copies") * F.col("size")).alias("c"))
    sums = stored(sums.withColumn("k", F.floor(F.col("__b") / COARSE)), "mix-sums")
    # where the running sum passes the need: the coarse bucket, the fine one, the row
    coarse = sums.groupBy("source", "k").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    coarse = coarse.join(goal.select(F.col("source").alias("__src"), "target"), _same("source", "__src"))
    needs = coarse.withColumn("need", F.col("target") - F.sum("c").over(Window.partitionBy("source"))).withColumn("start", F.lit(0).cast("long"))
    # rows without a part that is left to chance have no bucket
    at = _passed(needs.withColumn("s", F.when(F.col("k").isNotNull() & (F.col("need") > 0), F.col("s")).otherwise(0)), "k")
    at = at.select(F.col("source").alias("__src"), "need", F.col("bucket").alias("__k"), F.col("before").alias("start"))
    fine = sums.join(at, _same("source", "__src") & (F.col("k") == F.col("__k")))
    edge = _passed(fine, "__b").select(F.col("source").alias("__s"), F.col("bucket").alias("__edge"), F.col("before").alias("__before"))
    goal = goal.join(at.select("__src", F.col("need").alias("__need")), _same("source", "__src"))
    goal = stored(goal.join(edge, _same("source", "__s"), "left").drop("__src", "__s"), "mix-edges")
    key = F.struct("__t", "__u", "doc_id", "size")
    last = ranked(d.select("doc_id", "source", "size", *d.columns[len(docs.columns) :]), goal).where(F.col("__b") == F.col("__edge"))
    groups = last.groupBy("source", key.alias("__key")).agg(F.count(F.lit(1)).alias("m"), F.first("__need").alias("need"), F.first("__before").alias("before"))
    order = Window.partitionBy("source").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("__key.size")
    groups = groups.withColumn("sum", F.col("before") + F.coalesce(F.sum(F.col("m") * size).over(order), F.lit(0)))
    # a row is in, if that brings the sum nearer to the need; of equal rows the first so many
    fits = F.floor((F.col("need") - F.col("sum")) / size - 0.5) + 1
    taken = F.when(size > 0, F.least(F.greatest(fits, F.lit(0)), F.col("m"))).when(F.col("sum") <= F.col("need"), F.col("m")).otherwise(0)
    ends = groups.withColumn("n", taken).where("n > 0").groupBy("source").agg(F.max(F.struct("__key", "n", "m")).alias("__z"))
    goal = stored(goal.join(ends.withColumnRenamed("source", "__src"), _same("source", "__src"), "left").drop("__src"), "mix-goal")
    rows = ranked(d, goal)
    # sizes are looked at in the one bucket alone: they may be dear to count
    at_edge = rows.where(F.col("__b") == F.col("__edge")).withColumn("__key", key)
    below = F.col("__t").isNotNull() & (F.col("__need") > 0) & (F.col("__b") < F.coalesce(F.col("__edge"), F.lit(BUCKETS)))
    elsewhere = rows.where(~F.coalesce(F.col("__b") == F.col("__edge"), F.lit(False))).withColumn("__in", F.coalesce(below, F.lit(False)))
    cut = F.col("__z.__key")
    whole = at_edge.withColumn("__in", F.coalesce(F.col("__key") <= cut, F.lit(False)))
    if not goal.where("__z.n < __z.m").isEmpty():
        split = F.coalesce((F.col("__key") == cut) & (F.col("__z.n") < F.col("__z.m")), F.lit(False))
        whole = whole.where(~split).unionByName(_first(at_edge.where(split)))
    marked = elsewhere.unionByName(whole.drop("__key"))
    return marked.select("doc_id", "source", "size", *carried, "source_size", "target", (F.col("__copies") + F.col("__in").cast("long")).alias("copies"))


def _first(rows: DataFrame) -> DataFrame:
    """Equal rows of each source with __in for the first __z.n of them, numbered in
    each part of the written table and by the counts of the parts before."""
    rows = stored(rows.withColumn("__part", F.spark_partition_id()), "mix-equal")
    before = Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("source", "__part").agg(F.count(F.lit(1)).alias("n")).withColumn("__base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    base = base.select(F.col("source").alias("__src"), F.col("__part").alias("__q"), "__base")
    number = F.row_number().over(Window.partitionBy("source", "__part").orderBy("__u"))
    numbered = rows.withColumn("__n", number).join(base, _same("source", "__src") & (F.col("__part") == F.col("__q")))
    return numbered.withColumn("__in", F.col("__base") + F.col("__n") <= F.col("__z.n")).drop("__part", "__q", "__n", "__base", "__src")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size"))
    mixed = mix(stored(docs, "mix-docs"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
