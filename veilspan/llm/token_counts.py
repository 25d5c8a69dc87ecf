"""Token counts without token ids.

1. Documents are read in chunks of bounded size. A chunk keeps which of its
   documents hold each of its distinct pre-tokens, and how often: the table of
   per-document frequencies. Beside it goes one row for each distinct pre-token.
   Pre-tokens that the vocabulary has as one piece are a table of bounded size
   that each worker makes once; their frequencies are summed on the spot.
2. Those rows are dealt out by pre-token and sorted, so equal ones are adjacent;
   the pieces of each distinct pre-token are counted once, and the count goes back
   to every chunk that has it. A pre-token has a row a chunk at most, so the
   commonest is no hot key.
3. The counts are joined to the chunks' frequencies, multiplied and summed.

Rows are told apart by chunk and place, so repeated ids are no matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import read, stored
from veilspan.llm.pretokens import VOCABULARY, vocabulary

LIMIT = 2048
#: Rows of counts that a task holds at most before it sends them on.
HELD = 1_000_000
#: A chunk ends at so many characters or rows; places in a chunk take 16 bits.
CHUNK_CHARS = 12_000_000
CHUNK_ROWS = 60_000
_PARTS = "word string, chunk long, place int, body binary, meta binary"
_SCHEMA = pa.schema([("word", pa.string()), ("chunk", pa.int64()), ("place", pa.int32()), ("body", pa.binary()), ("meta", pa.binary())])


def _chunk(number: int, ids: list, texts: list[str], name: str) -> Iterator[pa.RecordBatch]:
    """A row for each distinct pre-token, and one without word for the chunk.

    Frequencies are 16-bit numbers; a larger one is several entries.
    """
    v = vocabulary(name)
    split, whole, single = v.split, v.whole, []
    seen: dict[str, int] = {}
    keys = [np.zeros(0, np.int64)]
    for row, text in enumerate(texts):
        found = split(text)
        single.append(len(found))
        found = np.array([seen.setdefault(w, len(seen)) for w in found if w not in whole], np.int64)
        single[-1] -= len(found)
        keys.append(found << 16 | row)
    words = sorted(seen)
    place = np.empty(len(words), np.int64)
    place[[seen[w] for w in words]] = np.arange(len(words))
    keys = np.concatenate(keys)
    at, times = np.unique(place[keys >> 16] << 16 | keys & 65535 if len(keys) else keys, return_counts=True)
    parts = -(-times // 65535)
    first = np.cumsum(parts) - parts
    nth = np.arange(parts.sum()) - np.repeat(first, parts)
    often = np.minimum(np.repeat(times, parts) - nth * 65535, 65535)
    at = np.repeat(at, parts)
    body = b"".join(x.tobytes() for x in (np.bincount(at >> 16, minlength=len(words)).astype("<u4"), (at & 65535).astype("<u2"), often.astype("<u2")))
    known = np.array([x is not None for x in ids])
    sizes = np.array([len(t.encode()) for t in texts], "<i8")
    meta = b"".join(x.tobytes() for x in (np.array([x or 0 for x in ids], "<i8"), sizes, np.array(single, "<i8"), known))
    for k in range(0, len(words), 20_000):
        n = len(part := words[k : k + 20_000])
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(np.full(n, number)), pa.array(np.arange(k, k + n, dtype=np.int32)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=_SCHEMA)
    head = len(words).to_bytes(4, "little")
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([number]), pa.nulls(1, pa.int32()), pa.array([head + body], pa.binary()), pa.array([meta], pa.binary())], schema=_SCHEMA)


def _chunks(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, chars = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = text.as_py() or ""
                if texts and (chars + len(t) > CHUNK_CHARS or len(texts) >= CHUNK_ROWS):
                    yield from _chunk(number, ids, texts, name)
                    number, ids, texts, chars = number + 1, [], [], 0
                ids.append(doc)
                texts.append(t)
                chars += len(t)
        if texts:
            yield from _chunk(number, ids, texts, name)

    return run


def _count(name: str):
    """(word, chunk, place) sorted by word to (chunk, packed places and counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, last, last_n = vocabulary(name), None, 0
        chunk, place, count, held = [], [], [], 0

        def leave() -> pa.RecordBatch:
            c, p, n = map(np.concatenate, (chunk, place, count))
            order = np.argsort(c, kind="stable")
            c, p, n = c[order], p[order].astype("<u4"), n[order].astype("<u4")
            cuts = np.append(np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])), len(c))
            bodies = [p[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c[cuts[:-1]]), pa.array(bodies, pa.binary())], ["chunk", "body"])

        for batch in batches:
            if not batch.num_rows:
                continue
            runs = batch.column(0).dictionary_encode()
            words = runs.dictionary.to_pylist()
            new = words[1:] if words[0] == last else words
            sizes = [len(p) // 4 for p in v.pieces(new)]
            sizes = [last_n, *sizes] if len(new) < len(words) else sizes
            last, last_n = words[-1], sizes[-1]  # the next batch may go on with this word
            chunk.append(batch.column(1).to_numpy())
            place.append(batch.column(2).to_numpy())
            count.append(np.array(sizes)[runs.indices.to_numpy()])
            held += batch.num_rows
            if held > HELD:
                yield leave()
                chunk, place, count, held = [], [], [], 0
        if held:
            yield leave()

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, body, meta) sorted by chunk, the frequencies first, to documents."""
    now = pieces = freq = meta = None

    def leave() -> pa.RecordBatch:
        runs = np.frombuffer(freq, "<u4", len(pieces), 4)
        rest = np.frombuffer(freq, "<u2", -1, 4 + 4 * len(pieces))
        row, often = rest[: len(rest) // 2], rest[len(rest) // 2 :]
        n = len(meta) // 25
        ids, sizes, single = np.frombuffer(meta, "<i8", 3 * n).reshape(3, n)
        known = np.frombuffer(meta, bool, n, 24 * n)
        tokens = np.bincount(row, np.repeat(pieces, runs) * often, n).astype(np.int64) + single
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(sizes), pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])

    for batch in batches:
        for chunk, body, about in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if about is not None:
                if meta is not None:
                    yield leave()
                now, freq, meta, pieces = chunk, body, about, np.zeros(int.from_bytes(body[:4], "little"))
            elif chunk == now:
                half = len(body) // 2
                pieces[np.frombuffer(body[:half], "<u4")] = np.frombuffer(body[half:], "<u4")
    if meta is not None:
        yield leave()


def count_tokens(docs: DataFrame, text: str = "text", key: str = "doc_id", name: str = VOCABULARY) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes (UTF-8), n_tokens.

    A null text is empty: no bytes, no tokens. A null id stays null; repeated rows
    each give a row; an empty table gives none. Other columns are not read.
    """
    rows = stored(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_chunks(name), _PARTS), "frequencies")
    words = rows.where("word is not null").select("word", "chunk", "place").repartition("word").sortWithinPartitions("word")
    counts = words.mapInArrow(_count(name), "chunk long, body binary")
    both = counts.withColumn("meta", F.lit(None).cast("binary")).unionByName(rows.where("word is null").select("chunk", "body", "meta"))
    together = both.repartition("chunk").sortWithinPartitions("chunk", F.col("meta").isNull())
    return together.mapInArrow(_documents, "doc_id long, n_bytes long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(read(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
