"""Connected components of a table of links, without gathering them anywhere.

Each round, every node points to the neighbour (or itself) whose hash is least;
two rounds of pointer jumping shorten the chains; then every node is replaced by
what it points to, and loops and repeats go. Hashed order makes long sorted
paths no worse than others: the links shrink by a factor each round. All steps
are equi-joins and grouped minima, so a node with very many links is combined
before the shuffle or split by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import stored


def _undirected(links: DataFrame) -> DataFrame:
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return links.where("a != b").select(low, high).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) to (node, root), for every node that has a link to
    another; root is one node of its component. Nulls, loops and repeats are
    ignored; no links give no rows."""
    links = stored(_undirected(links), "links")
    roots = None
    while roots is None or not links.isEmpty():
        ends = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = ends.groupBy("u").agg(F.min(F.struct(F.xxhash64("v").alias("h"), "v")).alias("m"))
        up = stored(least.select("u", F.when(F.xxhash64("u") < F.col("m.h"), F.col("u")).otherwise(F.col("m.v")).alias("p")), "up")
        two = up.alias("x").join(up.alias("y"), F.col("x.p") == F.col("y.u")).select(F.col("x.u").alias("u"), F.col("y.p").alias("p"))
        two = stored(two, "up2")
        four = stored(two.alias("x").join(two.alias("y"), F.col("x.p") == F.col("y.u")).select(F.col("x.u").alias("u"), F.col("y.p").alias("p")), "up4")
        if roots is None:
            roots = four.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            roots = stored(roots.join(four, roots.root == four.u, "left").select("node", F.coalesce("p", "root").alias("root")), "roots")
        left = four.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        right = four.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        links = stored(_undirected(links.join(left, "a").join(right, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "links")
    return roots
