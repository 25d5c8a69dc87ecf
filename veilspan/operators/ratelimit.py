"""A sliding-window limit per key in which only accepted hits count.

Whether a hit is accepted depends on which before it were, so no range frame gives
it. Hits are dealt out by key and time window of the sort, and walked in order with
the state of one key: the accepted times within the window, at most `limit`. Keys
stream through a task one after another; a key's rows are never gathered.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, WINDOW_SECONDS = 30, 60.0


def accepts(accepted: deque, now: float, limit: int = LIMIT, window: float = WINDOW_SECONDS) -> bool:
    """Whether a hit at `now` is accepted; the accepted times are brought up to date."""
    while accepted and now - accepted[0] > window:
        accepted.popleft()
    if len(accepted) >= limit:
        return False
    accepted.append(now)
    return True


def _walk(limit: int, window: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, accepted, first = None, deque(), True
        for batch in batches:
            keys, times = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__key", "__at"))
            out = []
            for k, t in zip(keys, times, strict=True):
                if first or k != key:
                    key, accepted, first = k, deque(), False
                out.append(t is not None and accepts(accepted, t, limit, window))
            names = [n for n in batch.schema.names if n not in ("__key", "__at")]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.bool_())], [*names, "accepted"])

    return run


def rate_limited(hits: DataFrame, key: str, at: str, order: str | None = None, limit: int = LIMIT, window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """hits with `accepted`. Hits of a key are taken by time, then by `order`; a hit
    without a time is not accepted. A null key is a key of its own."""
    seconds = F.unix_micros(F.col(at).cast("timestamp")).cast("double") / 1e6
    rows = hits.drop("accepted").withColumns({"__key": F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("")), "__at": seconds})
    columns = ["__key", "__at", *([order] if order else [])]
    dealt = rows.repartition("__key").sortWithinPartitions(*columns)
    schema = hits.drop("accepted").schema.add("accepted", "boolean")
    return dealt.mapInArrow(_walk(limit, window_seconds), schema)
