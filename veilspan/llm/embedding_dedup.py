"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

A unit vector x is held as s * q + e: q are integers up to 127, s is a scale, and
|e| is known exactly. For two of them
    |<x, y> - s_x s_y <q_x, q_y>| <= |e_x| |s_y q_y| + |s_x q_x| |e_y| + |e_x| |e_y|,
so a product of two tiles of integers says which pairs may reach the threshold,
and only those are computed again in double precision. The products of the
integers are exact in single precision, which is how BLAS is used for them.

Blocks of vectors are dealt into tiles, whatever their ids. A unit of work holds one
tile, and a run of others streams past it block by block; tiles stand in a circle and
each meets the half that comes after it, so every pair of tiles meets once and all
units are alike. A pair whose bounds lie on one side of the threshold is decided by
them; all others are computed in double precision. A unit gives link counts and a
spanning forest of its links, so a group with very many members is never written out
as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from veilspan.llm.common import read, stored
from veilspan.llm.components import components
from veilspan.llm.simhash import joined
from veilspan.llm.vectors import rows_of

THRESHOLD = 0.95
#: Bytes that a held tile takes, on average; vectors in a block; rows and columns that
#: are multiplied at once; pairs that are computed again at once.
TILE_BYTES = 32 << 20
BLOCK = 1024
STRIP, CHUNK = 512, 4096
EXACT = 65_536


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(integers, scale, |s q|, |e|) of each row."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None])
    held = q * scale[:, None]
    # a little more than the error, for the roundings of these sums themselves
    return q.astype(np.int8), scale, np.linalg.norm(held, axis=1) * (1 + 1e-12), np.linalg.norm(unit - held, axis=1) * (1 + 1e-12) + 1e-13


class Tile:
    """Vectors, none of them zero, in single precision if they came so."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        exact = vectors.astype(np.float64)
        self.norm = np.sqrt(np.einsum("ij,ij->i", exact, exact))
        self.q, self.scale, self.size, self.error = quantised(exact / self.norm[:, None])

    @property
    def unit(self) -> np.ndarray:
        return self.vectors.astype(np.float64) / self.norm[:, None]


def links(a: Tile, b: Tile, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) with a cosine of `threshold` or more."""
    for c in range(0, len(b.ids), CHUNK):
        t = slice(c, c + CHUNK)
        right = b.q[t].astype(np.float32).T
        for k in range(0, len(a.ids), STRIP):
            s = slice(k, k + STRIP)
            product = a.q[s].astype(np.float32) @ right  # integers below 2^24: exact
            # threshold - bound <= s_x s_y p, divided by the scales; rounded down in single precision
            bound = a.error[s, None] * (b.size[t] + b.error[t]) + a.size[s, None] * b.error[t]
            i, j = np.nonzero(product >= ((threshold - bound) / (a.scale[s, None] * b.scale[t]) - 1.0).astype(np.float32))
            if not len(i):
                continue
            value, slack = product[i, j].astype(np.float64) * a.scale[s][i] * b.scale[t][j], bound[i, j]
            sure = value - slack >= threshold
            rest = np.flatnonzero(~sure)
            for e in range(0, len(rest), EXACT):
                part = rest[e : e + EXACT]
                x, y = k + i[part], c + j[part]
                dot = np.einsum("ij,ij->i", a.vectors[x].astype(np.float64), b.vectors[y].astype(np.float64))
                sure[part] = dot / (a.norm[x] * b.norm[y]) >= threshold
            yield k + i[sure], c + j[sure]


class Unit:
    """A held tile, and the blocks that stream past it."""

    def __init__(self, threshold: float, kind: str):
        self.threshold, self.kind = threshold, kind
        self.parts: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.tile: Tile | None = None

    def hold(self, block: int, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.parts.append((block, ids, vectors))

    def _close(self) -> None:
        self.tile = Tile(np.concatenate([p[1] for p in self.parts]), np.concatenate([p[2] for p in self.parts]))
        sizes = [len(p[1]) for p in self.parts]
        self.start = dict(zip((p[0] for p in self.parts), np.cumsum([0, *sizes[:-1]]).tolist(), strict=True))
        self.parts = []
        self.counts, self.up = np.zeros(len(self.tile.ids), np.int64), np.arange(len(self.tile.ids) + BLOCK)

    def meet(self, block: int, ids: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The links of a block with the tile; of the tile's own blocks each pair twice,
        once from either side, and counted for the tile."""
        if self.tile is None:
            if not self.parts:
                return  # the tile is empty
            self._close()
        n, own = len(self.tile.ids), self.start.get(block)
        other = Tile(ids, vectors)
        mine = np.zeros(len(ids), np.int64)
        self.up[n:] = np.arange(n, n + BLOCK)
        for j, i in links(other, self.tile, self.threshold):
            if own is not None:
                apart = i != own + j
                i, j = i[apart], own + j[apart]
            else:
                mine += np.bincount(j, minlength=len(ids))
                j = n + j
            self.counts += np.bincount(i, minlength=n)
            joined(self.up, i, j)
        if len(some := np.flatnonzero(mine)):
            # a linked row's set has its least member, which a held one is
            yield _links(ids[some], self.tile.ids[self.up[n + some]], mine[some])

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.tile is not None and len(some := np.flatnonzero(self.counts)):
            yield _links(self.tile.ids[some], self.tile.ids[self.up[some]], self.counts[some])


def _links(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])


def _units(threshold: float, kind: str):
    """Rows (tile, run, d, side, block, ids, vectors) in that order to counts and links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, unit = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                x, r, d, side, block, ids, data = (batch.column(c)[k].as_py() for c in range(7))
                if (x, r, d) != now:
                    if unit:
                        yield from unit.end()
                    now, unit = (x, r, d), Unit(threshold, kind)
                rows = np.frombuffer(ids, "<i8"), np.frombuffer(data, kind).reshape(-1, d)
                if side:
                    yield from unit.meet(block, *rows)
                else:
                    unit.hold(block, *rows)
        if unit:
            yield from unit.end()

    return run


def _blocks(kind: str):
    """(id, vector) to (block, dimension, vectors in it, ids, vectors), a row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for ids, m in rows_of(batch):
                largest = np.abs(m).max(1)
                ids, m, largest = ids[largest > 0], m[largest > 0], largest[largest > 0]
                if kind == "<f8":
                    m = m / largest[:, None]  # keeps squares within range
                for k in range(0, len(ids), BLOCK):
                    part = ids[k : k + BLOCK]
                    row = [(number, pa.int64()), (m.shape[1], pa.int64()), (len(part), pa.int64()), (part.tobytes(), pa.binary()), (m[k : k + BLOCK].astype(kind).tobytes(), pa.binary())]
                    number += 1
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in row], ["block", "d", "n", "rows", "vectors"])

    return run


def _dealt(blocks: DataFrame, tile: int | None) -> DataFrame:
    """(x, run, d, side, block, rows, vectors): what each unit of work reads."""
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    about = blocks.agg(F.sum("n").alias("n"), F.max("d").alias("d"), F.count(F.lit(1)).alias("blocks")).first()
    if not about["blocks"]:
        return blocks.select(F.lit(0).alias("x"), F.lit(0).alias("run"), "d", F.lit(0).alias("side"), "block", "rows", "vectors")
    # a held vector takes a byte a component for its integers, and four or eight for itself
    tile = tile or max(BLOCK, TILE_BYTES // (9 * about["d"]))
    # no fewer tiles than keep the cores busy, however few the vectors
    tiles = max(-(-about["n"] // tile), min(about["blocks"], math.ceil(2 * cores**0.5)))
    steps = tiles // 2 + 1
    runs = min(steps, -(-cores // tiles))
    # a task's blocks go to one tile after another
    own = F.pmod(F.col("block").bitwiseAND((1 << 32) - 1) + F.pmod(F.xxhash64(F.shiftright("block", 32)), F.lit(tiles)), F.lit(tiles))
    b = blocks.withColumn("t", own)
    held = b.select(F.col("t").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), "d", F.lit(0).alias("side"), "block", "rows", "vectors")
    # tile t passes the tiles before it in the circle, from itself to the opposite one
    passes = b.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step")).withColumn("x", F.pmod(F.col("t") - F.col("step"), F.lit(tiles)))
    once = F.lit(True) if tiles % 2 else (F.col("step") < steps - 1) | (F.col("x") < tiles // 2)
    passes = passes.where(once).select("x", F.floor(F.col("step") * runs / steps).cast("int").alias("run"), "d", F.lit(1).alias("side"), "block", "rows", "vectors")
    return held.unionByName(passes)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD, tile: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors.

    Vectors that are null, zero, or hold null or non-finite components link with
    nothing, nor do vectors of other lengths or rows with a null id; their component
    is their own id. Rows with equal ids are links of their vectors as any other,
    counted for the id. Other columns are not read. `tile` is the number of vectors
    that a unit of work holds; unset, TILE_BYTES says how many.
    """
    v = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v"))
    kind = "<f4" if v.schema["v"].dataType.elementType == FloatType() else "<f8"
    packed = stored(v.mapInArrow(_blocks(kind), "block long, d long, n long, rows binary, vectors binary"), "vector-blocks")
    order = ["x", "run", "d", "side", "block"]
    found = _dealt(packed, tile).repartition("x", "run").sortWithinPartitions(*order).mapInArrow(_units(threshold, kind), "a long, b long, n long")
    found = stored(found, "vector-links")
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
    roots = components(found.select("a", "b"))
    least = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    groups = roots.join(least, "root").select(F.col("node").alias("id"), "component_id")
    out = v.select("id").join(counts, "id", "left").join(groups, "id", "left")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
