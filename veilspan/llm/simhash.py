"""SimHash near-duplicates by BK-trees.

A BK-tree's children are keyed by their integer Hamming distance to the parent;
a search follows only edges within the radius of the query's own distance.

One tree over all fingerprints would have to be sent everywhere, and at radius 4
of 64 bits it prunes little. So the distinct fingerprints are dealt into shards
first: of `blocks` blocks of bits, a pair within the radius agrees in all but
`radius` of them, so each choice of blocks is a key, and every linked pair shares
a key. Each shard has its own tree, which goes with its members to the task that
searches it: shard trees are bounded in size, but all trees together are not, so
they are shuffled, not broadcast. A shard over SHARD members is split into tiles,
and each pair of tiles is a tree of its own, so no task gets an unbounded group.

A shard gives a spanning forest of its links, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import read, stored
from veilspan.llm.components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Most members of a shard before it is split into tiles.
SHARD = 1024
#: Members a shard should have on average; more blocks make smaller shards.
AIM = 256
#: Rows whose trees are built and searched at once, and pairs compared at once.
ROWS = 100_000
PAIRS = 2_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each 1 if set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, seed)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    spans = zip((ends - size)[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in spans], "<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        part = np.unpackbits(hashes[k : k + 4096].view("u1").reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs with __fp, the fingerprint as a signed long."""

    def run(column):
        import pandas as pd

        return pd.Series(np.array([fingerprint(t, shingle) for t in column], "u8").view("i8"))

    return docs.withColumn("__fp", F.pandas_udf(run, "long")(F.col(text)))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Trees:
    """One BK-tree for each run of equal `shard`; a row is a node of its tree."""

    def __init__(self, shard: np.ndarray, bits: np.ndarray):
        n = len(bits)
        starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        sizes = np.diff(np.append(starts, n))
        self.bits, self.root, self.size = bits, np.repeat(starts, sizes), np.repeat(sizes, sizes)
        key = np.full(n, -1)  # parent * 65 + edge
        rest = np.flatnonzero(self.root != np.arange(n))
        at = self.root[rest]
        while len(rest):
            edge = at * 65 + _distance(bits[rest], bits[at])
            order = np.argsort(edge, kind="stable")
            rest, edge = rest[order], edge[order]
            head = np.concatenate([[True], edge[1:] != edge[:-1]])
            new = rest[head]  # the first at this edge becomes the child, the others go below it
            key[new] = edge[head]
            at = new[np.cumsum(head) - 1][~head]
            rest = rest[~head]
        self.child = np.argsort(key, kind="stable")
        self.key = key[self.child]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row, earlier row of the same shard) within the radius, in parts."""
        n, start = len(self.bits), 0
        total = np.cumsum(self.size)
        while start < n:
            stop = max(start + 1, int(np.searchsorted(total, total[start] + PAIRS)))
            query = np.arange(start, min(stop, n))
            node = self.root[query]
            while len(query):
                d = _distance(self.bits[query], self.bits[node])
                hit = (d <= radius) & (node < query)
                if hit.any():
                    yield query[hit], node[hit]
                low = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
                many = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), side="right") - low
                query = np.repeat(query, many)
                within = np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many)
                node = self.child[np.repeat(low, many) + within]
            start = stop


def joined(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; up[x] is x's set's least member."""
    while len(a):
        a, b = up[a], up[b]
        apart = a != b
        low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        if not len(low):
            return
        np.minimum.at(up, high, low)
        while not np.array_equal(above := up[up], up):
            up[:] = above
        a, b = low, high


def _forests(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def search(shard: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
            up = np.arange(len(bits))
            for a, b in Trees(shard, bits).links(radius):
                joined(up, a, b)
            low = np.flatnonzero(up != np.arange(len(bits)))
            fp = bits.view("i8")
            return pa.RecordBatch.from_arrays([pa.array(fp[low]), pa.array(fp[up[low]])], ["a", "b"])

        shards, fps, held = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            shards.append(batch.column(0).to_numpy())
            fps.append(batch.column(1).to_numpy().view("u8"))
            held += batch.num_rows
            if held > ROWS:
                shard, bits = np.concatenate(shards), np.concatenate(fps)
                if cut := int(np.searchsorted(shard, shard[-1])):  # the last shard may go on
                    yield search(shard[:cut], bits[:cut])
                shards, fps, held = [shard[cut:]], [bits[cut:]], len(shard) - cut
        if held:
            yield search(np.concatenate(shards), np.concatenate(fps))

    return run


def blocks_for(fingerprints: int, radius: int = RADIUS, aim: int = AIM) -> int:
    """The fewest blocks whose shards have `aim` members on average, 2 * radius at most."""
    for blocks in range(radius + 1, 2 * radius):
        if fingerprints / 2.0 ** (64 * (blocks - radius) // blocks) <= aim:
            return blocks
    return max(radius + 1, 2 * radius)


def forest(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Distinct fingerprints (fp long) to links (a, b) that span its near groups."""
    blocks = blocks or blocks_for(fps.count(), radius)
    edges = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for kept in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in kept)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(len(keys)), F.col("fp").bitwiseAND(F.lit(signed).cast("long"))))
    dealt = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD)
    tiled = dealt.join(large.withColumn("tiles", F.ceil(F.col("n") / (SHARD // 2)).cast("int")), "key", "left")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.coalesce("tiles", F.lit(1))).cast("int")
    tiled = tiled.select("fp", "key", own.alias("t"), F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)).alias("u"))
    shard = F.xxhash64("key", F.least("t", "u"), F.greatest("t", "u")).alias("shard")
    return tiled.select(shard, "fp").repartition("shard").sortWithinPartitions("shard").mapInArrow(_forests(radius), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of docs: doc_id, fp, text_hash, component_id, root.

    A null text has no words, fingerprint 0, and is linked like any other.
    component_id is the smallest id of the component; nulls are passed over, and
    a component of null ids alone has a null one. Repeated rows are repeated.
    root is a fingerprint of the component. Other columns are not read.
    """
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("__text"))
    fps = stored(fingerprints(own, "__text", shingle).select("doc_id", F.col("__fp").alias("fp"), F.xxhash64("__text").alias("text_hash")), "fingerprints")
    firsts = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = stored(components(forest(firsts.select("fp"), radius)), "fp-roots")
    groups = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = groups.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(groups.drop("first").join(least, "root"), "fp")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
