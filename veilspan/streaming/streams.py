"""Streams: redaction as it is, a vault with expiry, and the rate limiter.

Redaction needs nothing of its own: the expressions of a batch hold for a stream
in append mode. The vault and the limiter keep state by key, with time to live.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilspan.operators.ratelimit import LIMIT, WINDOW_SECONDS, accepts

#: Rows of an answer.
ANSWERS = 10_000


class VaultProcessor(StatefulProcessor):
    """Rows (session_id, action, payload): `put` stores a JSON mapping, `get` answers
    with it until its time is up, null after.

    A micro-batch has no order, so its puts come before its gets, and of several puts
    of a session the greatest text stays. Only that and a count are held."""

    def __init__(self, ttl_ms: int = 900_000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("mapping", "mapping string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        asked, put = 0, None
        for frame in rows:
            for action, payload in zip(frame["action"], frame["payload"], strict=True):
                if action != "put":
                    asked += 1
                elif payload and json.loads(payload):
                    put = payload if put is None else max(put, payload)
        if put is not None:
            self.stored.update((put,))
        answer = self.stored.get()[0] if self.stored.exists() else None
        for k in range(0, asked, ANSWERS):
            n = min(ANSWERS, asked - k)
            yield pd.DataFrame({"session_id": [key[0]] * n, "mapping": [answer] * n}, dtype="object")

    def close(self) -> None:
        pass


class LimiterProcessor(StatefulProcessor):
    """Rows (key, hit_id, at seconds): accepted or not, in the order of time within a
    micro-batch. Two numbers a hit of one key and batch are held to put them in order."""

    def __init__(self, limit: int = LIMIT, window: float = WINDOW_SECONDS):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getValueState("accepted", "times array<double>", ttlDurationMs=int(self.window * 2000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        times = deque(self.accepted.get()[0]) if self.accepted.exists() else deque()
        at, hit = np.zeros(0), np.zeros(0, np.int64)
        for frame in rows:
            at, hit = np.append(at, frame["at"].to_numpy(float)), np.append(hit, frame["hit_id"].to_numpy(np.int64))
        order = np.lexsort((hit, at))
        for k in range(0, len(order), ANSWERS):
            part = order[k : k + ANSWERS]
            out = [accepts(times, t, self.limit, self.window) for t in at[part].tolist()]
            yield pd.DataFrame({"key": pd.Series([key[0]] * len(out), dtype="object"), "hit_id": hit[part], "accepted": out})
        self.accepted.update((list(times),))

    def close(self) -> None:
        pass


def vault(actions: DataFrame, ttl_ms: int = 900_000) -> DataFrame:
    """A stream (session_id, action, payload) to (session_id, mapping) for each get."""
    return actions.groupBy("session_id").transformWithStateInPandas(VaultProcessor(ttl_ms), "session_id string, mapping string", "append", "processingTime")


def limiter(hits: DataFrame, limit: int = LIMIT, window: float = WINDOW_SECONDS) -> DataFrame:
    """A stream (key, hit_id, at) to (key, hit_id, accepted)."""
    return hits.groupBy("key").transformWithStateInPandas(LimiterProcessor(limit, window), "key string, hit_id long, accepted boolean", "append", "processingTime")
