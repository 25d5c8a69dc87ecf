"""Best-fit packing by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits a sequence. The program asks
for the fewest configurations that cover all pieces. It is solved by
multiplicative weights: each length has a price; knapsack dynamic programming
finds the dearest configuration; that gets a step, and the prices of what it
covers fall. The fractional solution is rounded to whole configurations that
the remaining pieces can fill; what is left gets a program of its own, and so on while
that helps, and the few pieces left in the end are packed best-fit decreasing.

All of that works on the histogram, at most CAPACITY rows however large the
corpus is. Pieces are numbered per length (in each task, plus the counts of the
tasks before), and the plan maps (length, number) to a place. So no group of
pieces ever meets in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan.llm.common import read, stored
from veilspan.llm.pretokens import VOCABULARY, vocabulary

CAPACITY = 2048
#: The id that ends each document.
END = 0
#: Multiplicative-weights steps of a program, the configurations priced in each (those
#: worth nearly as much as the dearest), and by how much a covered length's price falls.
STEPS = 100
PRICED, NEARLY = 8, 0.01
RATE = 0.15
#: Most programs, one on what another leaves, and tokens that a configuration may waste.
PROGRAMS = 12
WASTE = 8
#: Most entries of the plan, of 48 bytes each, that go to the workers.
ENTRIES = 2_000_000
#: Most characters that a task tokenizes at once.
BATCH_CHARS = 2_000_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, number long"


def _dearest(lengths: np.ndarray, prices: np.ndarray, capacity: int, most: int = 1) -> list[list[int]]:
    """Knapsack with repeats, by dynamic programming over the capacity: the dearest
    configurations that begin with `most` different lengths."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for w in range(1, capacity + 1):
        best[w] = best[w - 1]
        if k := fits[w]:
            values = best[w - lengths[:k]] + prices[:k]
            if values[m := values.argmax()] > best[w]:
                best[w], pick[w] = values[m], m
    every = prices + best[capacity - lengths]
    out = []
    for first in np.argsort(-every, kind="stable")[:most].tolist():
        if out and every[first] < every.max() * (1 - NEARLY):
            break
        config, w = [first], capacity - int(lengths[first])
        while w > 0:
            if pick[w] < 0:
                w -= 1
            else:
                config.append(int(pick[w]))
                w -= int(lengths[pick[w]])
        out.append(config)
    return out


def fractional(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS, rate: float = RATE) -> list[tuple[tuple[int, ...], float]]:
    """Configurations and how often each, a fractional cover in proportion."""
    lengths = np.array(sorted(histogram))
    need = np.array([histogram[x] for x in lengths], float)
    weights, uses = np.ones(len(lengths)), defaultdict(float)
    for _ in range(steps if len(lengths) else 0):
        configs = {tuple(sorted(c)) for c in _dearest(lengths, lengths / capacity * weights, capacity, PRICED)}
        for config in sorted(configs):
            items, times = np.unique(config, return_counts=True)
            ratio = times / need[items]
            step = 1 / ratio.max()
            uses[tuple(sorted((int(lengths[i]) for i in config), reverse=True))] += step
            weights[items] *= np.exp(-rate * step * ratio)
    covered = sum(sum(c) * x for c, x in uses.items())
    scale = float((lengths * need).sum()) / covered if covered else 0
    return [(c, x * scale) for c, x in uses.items()]


def configured(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(configurations by programs and how many sequences of each, lengths left over)."""
    left = {x: n for x, n in histogram.items() if n > 0}
    out = [((capacity,), left.pop(capacity))] if capacity in left else []
    for _ in range(PROGRAMS):
        if sum(x * n for x, n in left.items()) <= capacity:
            break
        used = 0
        cover = sorted(fractional(left, capacity, steps), key=lambda c: (capacity - sum(c[0]), -c[1], c[0]))
        for rounded in (np.floor, np.ceil):
            for config, x in cover:
                # a poorly filled configuration would bind pieces that fit better elsewhere
                if capacity - sum(config) > WASTE:
                    continue
                need = Counter(config)
                if k := int(min(rounded(x), *(left.get(i, 0) // m for i, m in need.items()))):
                    out.append((config, k))
                    used += k
                    for i, m in need.items():
                        left[i] -= m * k
                        if not left[i]:
                            del left[i]
        if not used:
            break
    return out, left


def plan(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how many sequences of each; every piece is in one."""
    out, left = configured(histogram, capacity, steps)
    # best fit, decreasing, on runs of equal bins
    bins: dict[int, Counter] = defaultdict(Counter)
    for x in sorted(left, reverse=True):
        n = left[x]
        while n:
            room = min((r for r in bins if r >= x), default=None)
            if room is None:
                fit = min(capacity // x, n)
                bins[capacity - fit * x][(x,) * fit] += (k := n // fit)
                n -= k * fit
            else:
                config, have = next(iter(bins[room].items()))
                k = min(have, n)
                bins[room][config] -= k
                if have == k:
                    del bins[room][config]
                if not bins[room]:
                    del bins[room]
                bins[room - x][(*config, x)] += k
                n -= k
    return out + [(c, k) for group in bins.values() for c, k in group.items()]


def places(configs: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """An entry for each length of each configuration: its first piece's number, the
    first of how many sequences, and the offset of the first of its repeats there."""
    rows, used, base = [], Counter(), 0
    for config, k in configs:
        at = 0
        for x, repeats in Counter(config).items():
            rows.append((x << 48 | used[x], base, k, at))
            used[x] += k * repeats
            at += x * repeats
        base += k
    if len(rows) > ENTRIES:
        raise ValueError(f"a plan of {len(rows)} entries; {ENTRIES} at most go to the workers")
    columns = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    return dict(zip(("key", "sequence", "many", "offset"), columns, strict=True))


def _cut(name: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, numbers, v = TaskContext.get().partitionId(), Counter(), vocabulary(name)

        def pieces(docs: list, texts: list[str]) -> pa.RecordBatch:
            rows = []
            for doc, ids in zip(docs, v.ids(texts), strict=True):
                data = ids + END.to_bytes(4, "little")
                for k, start in enumerate(range(0, len(data) // 4, capacity)):
                    part = data[4 * start : 4 * (start + capacity)]
                    rows.append((doc, k, start, n := len(part) // 4, zlib.crc32(part), chunk, numbers[n]))
                    numbers[n] += 1
            types = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "number"])

        for batch in batches:
            docs, texts, chars = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(doc)
                texts.append(text.as_py() or "")
                chars += len(texts[-1])
                if chars > BATCH_CHARS:
                    yield pieces(docs, texts)
                    docs, texts, chars = [], [], 0
            if docs:
                yield pieces(docs, texts)

    return run


def _place(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            key = length << 48 | number
            at = np.searchsorted(p["key"], key, side="right") - 1
            repeat, place = np.divmod(key - p["key"][at], p["many"][at])
            columns = [batch.column(k) for k in range(5)] + [pa.array(p["sequence"][at] + place), pa.array(p["offset"][at] + repeat * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", name: str = VOCABULARY, capacity: int = CAPACITY, steps: int = STEPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece.

    A null or empty text is the end id alone, a piece of length 1. Repeated rows
    are packed each by itself; a null id stays null; an empty table gives no rows.
    Other columns are not read.
    """
    spark = docs.sparkSession
    pieces = stored(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_cut(name, capacity), _PIECES), "pieces")
    counts = stored(pieces.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("__n")), "piece-counts")
    # at most `capacity` rows come to the driver
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    # an entry for each length of a configuration, ENTRIES at most
    where = spark.sparkContext.broadcast(places(plan(histogram, capacity, steps)))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("chunk", "length", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    numbered = pieces.join(base, ["chunk", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("__base")).alias("number"))
    return numbered.mapInArrow(_place(where), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
