"""Exact top-k inner products by vector-approximation files.

Every vector is approximated by the cell it falls in: each component by one of
256 intervals of its block's range. From the cells alone, the greatest score that
a vector of the cell can have with a query is its score with the cell's centre
plus sum |query component| * half a cell, so scores are distances turned round:
the greatest possible score gives the lower bound of the distance. A block's cells
are scanned first; then exact vectors are read in the order of that bound, until
the k-th best score found is no less than the next bound.

The file is a table of blocks: ids, cells and exact vectors, those in the shortest
integers that hold them. Queries are a table of blocks too. A unit of work holds some
queries, and a run of the file streams past them block by block while it carries
their k-th best scores along. Units are planned as one job, however many queries
there are; nothing of them passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan.llm.common import read, stored
from veilspan.llm.vectors import rows_of

K = 10
SCALE = 1024
#: Vectors in a block of the file, queries in a block, and queries that a unit holds.
BLOCK = 4096
QUERY_BLOCK = 512
QUERIES = 8192
#: Queries whose bounds are held at once.
STRIP = 256
#: Components up to here multiply and sum exactly as 64-bit numbers.
SAFE = 1 << 26

_FILE = "block long, d long, n long, ids binary, kind string, exact binary, low binary, width binary, cells binary"


def scaled(matrix: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), as doubles with whole values."""
    with np.errstate(over="ignore"):
        return np.floor(matrix * scale)


def _shortest(whole: np.ndarray) -> str:
    """The shortest type that holds whole numbers exactly."""
    most = np.abs(whole).max(initial=0)
    return "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"


def _write(scale: int, size: int, cells: bool):
    """(id, vector) to blocks of `size` vectors at most, with cells or without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for ids, m in rows_of(batch):
                whole = scaled(m, scale)
                good = np.isfinite(whole).all(1)
                ids, whole = ids[good], whole[good]
                for k in range(0, len(ids), size):
                    part, own = whole[k : k + size], ids[k : k + size]
                    kind = _shortest(part)
                    row = [number, part.shape[1], len(own), own.tobytes(), kind, part.astype(kind).tobytes(), None, None, None]
                    number += 1
                    if cells:
                        low, width = part.min(0), (part.max(0) - part.min(0)) / 256
                        inside = np.minimum((part - low) / np.where(width > 0, width, 1), 255).astype(np.uint8)
                        row[6:] = low.tobytes(), width.tobytes(), inside.tobytes()
                    types = [pa.int64()] * 3 + [pa.binary(), pa.string()] + [pa.binary()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["block", "d", "n", "ids", "kind", "exact", "low", "width", "cells"])

    return run


def _exact(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products: 64-bit where they can't overflow, else of any size."""
    if not rows.size or max(np.abs(q).max(), np.abs(rows).max()) < SAFE / max(1, len(q)) ** 0.5:
        return rows.astype(np.int64) @ q.astype(np.int64)
    big = [int(x) for x in q]
    most = (1 << 63) - 1
    return np.array([min(max(sum(a * int(b) for a, b in zip(big, r, strict=True)), -most), most) for r in rows], np.int64)


class Best:
    """The k best of a query so far, by score, then by smaller id."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> float:
        return float(self.scores[-1]) if len(self.ids) >= self.k else -np.inf

    def take(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]


def search_block(queries: np.ndarray, best: list[Best], ids: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray, exact: np.ndarray, batch: int = 32) -> int:
    """Brings `best` of each query up to date with a block; returns exact reads."""
    reads = 0
    centres = cells.astype(np.float64)
    for k in range(0, len(queries), STRIP):
        q = queries[k : k + STRIP]
        slack = np.abs(q) @ (width / 2) + np.abs(q) @ np.maximum(np.abs(low), np.abs(low + 256 * width)) * 1e-9 + 1
        bounds = (q * width) @ centres.T + (q @ (low + width / 2) + slack)[:, None]
        tops = best[k : k + STRIP]
        for i in np.flatnonzero(bounds.max(1, initial=-np.inf) >= np.array([t.least() for t in tops])).tolist():
            top = tops[i]
            open_ = np.flatnonzero(bounds[i] >= top.least())
            if len(open_) > 8 * batch:  # the most promising ones may close the rest
                first = open_[np.argpartition(-bounds[i][open_], batch)[:batch]]
                top.take(ids[first], _exact(q[i], exact[first].astype(float)))
                reads += len(first)
                bounds[i][first] = -np.inf
                open_ = np.flatnonzero(bounds[i] >= max(top.least(), -np.finfo(float).max))
            order = open_[np.argsort(-bounds[i][open_], kind="stable")]
            for a in range(0, len(order), batch):
                part = order[a : a + batch]
                if bounds[i][part[0]] < top.least():
                    break  # the k-th best is certain
                top.take(ids[part], _exact(q[i], exact[part].astype(float)))
                reads += len(part)
    return reads


class Unit:
    """Held queries with their best so far."""

    def __init__(self, k: int):
        self.k, self.numbers, self.ids, self.rows = k, [], [], []
        self.best: list[Best] | None = None

    def hold(self, block: int, ids: np.ndarray, rows: np.ndarray) -> None:
        self.numbers.append((block << 10) + np.arange(len(ids)))
        self.ids.append(ids)
        self.rows.append(rows.astype(float))

    def meet(self, *block: np.ndarray) -> None:
        if not self.rows:
            return
        if self.best is None:
            self.queries = np.concatenate(self.rows)
            self.best = [Best(self.k) for _ in self.queries]
        search_block(self.queries, self.best, *block)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.best is None:
            return
        many = [len(t.ids) for t in self.best]
        own = [int(_exact(q, q[None])[0]) for q in self.queries]
        columns = [np.repeat(x, many) for x in (np.concatenate(self.numbers), np.concatenate(self.ids), np.array(own, np.int64))]
        columns += [np.concatenate([t.ids for t in self.best]), np.concatenate([t.scores for t in self.best])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["number", "query_id", "self", "vec_id", "score"])


def _scan(k: int):
    """Rows (group, run, d, side, block, ...) in that order to the k best of each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, unit = None, Unit(k)
        for batch in batches:
            for r in range(batch.num_rows):
                group, part, d, side, block, ids, kind, exact, low, width, cells = (batch.column(c)[r].as_py() for c in range(11))
                if (group, part, d) != now:
                    yield from unit.end()
                    now, unit = (group, part, d), Unit(k)
                own = np.frombuffer(ids, "<i8"), np.frombuffer(exact, kind).reshape(-1, d)
                if side:
                    unit.meet(own[0], np.frombuffer(low), np.frombuffer(width), np.frombuffer(cells, np.uint8).reshape(-1, d), own[1])
                else:
                    unit.hold(block, *own)
        yield from unit.end()

    return run


def _turns(blocks: DataFrame, n: int) -> Column:
    """A number below n for each block; a task's blocks take one after another."""
    return F.pmod(F.col("block").bitwiseAND((1 << 32) - 1) + F.pmod(F.xxhash64(F.shiftright("block", 32)), F.lit(n)), F.lit(n)).cast("int")


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", column: str = "embedding", k: int = K, scale: int = SCALE, queries_at_once: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row where is_query.

    Vectors are floor(scale * x); the score is the integer inner product. Rows
    whose vector is null or holds null or non-finite components, and rows with a
    null id, take no part; vectors are compared with those of their own length.
    A query's own row is left out, other rows with its id are not; repeated query
    rows give repeated results. Ties go to the smaller id. Scores beyond 64 bits
    stop at the ends of their range.
    """
    own = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v"), is_query.alias("q"))
    file = stored(own.select("id", "v").mapInArrow(_write(scale, BLOCK, True), _FILE), "va-file")
    asked = stored(own.where("q").select("id", "v").mapInArrow(_write(scale, min(QUERY_BLOCK, queries_at_once), False), _FILE), "va-queries")
    n = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(1, -(-n // queries_at_once))
    runs = -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // groups)
    columns = ["d", "side", "block", "ids", "kind", "exact", "low", "width", "cells"]
    held = asked.select(_turns(asked, groups).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), F.lit(0).alias("side"), "*")
    passing = file.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), _turns(file, runs).alias("run"), F.lit(1).alias("side"), "*")
    units = held.select("g", "run", *columns).unionByName(passing.select("g", "run", *columns)).repartition("g", "run").sortWithinPartitions("g", "run", "d", "side", "block")
    # one more than k: the query's own row may be among them
    found = units.mapInArrow(_scan(k + 1), "number long, query_id long, self long, vec_id long, score long")
    # a unit gives k + 1 rows a query, so a query's group has k + 1 rows a run
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    itself = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("self"))
    ranked = ranked.withColumn("own", F.min(F.when(itself, F.col("place"))).over(Window.partitionBy("number")))
    ranked = ranked.where(~F.col("place").eqNullSafe(F.col("own"))).withColumn("rank", (F.col("place") - F.when(F.col("place") > F.col("own"), 1).otherwise(0)).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)
