"""The same redaction on a stream, and the stateful operators."""

import json
import time

import pytest

from veilspan.plans.engine import Engine
from veilspan.settings import Settings
from veilspan.streaming import streams


def _run(spark, frame, name, rows):
    """What the stream has put out once there are so many rows. State with time to
    live keeps a query going, so it is stopped."""
    query = frame.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        end = time.time() + 60
        while query.isActive and spark.table(name).count() < rows and time.time() < end:
            time.sleep(0.3)
        if query.exception():
            raise query.exception()
        return spark.table(name).collect()
    finally:
        query.stop()


@pytest.fixture
def stateful(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_redaction_of_a_stream(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"text": "mail jan@example.pl"}) + "\n")
    stream = spark.readStream.schema("text string").json(str(tmp_path))
    out = Engine(Settings()).redact(stream).select("redacted_text")
    assert [r[0] for r in _run(spark, out, "redacted", 1)] == ["mail <EMAIL>"]


def test_vault_stream(stateful, tmp_path):
    rows = [("s1", "put", '{"[A_001]": "x"}'), ("s2", "put", "{}")]
    (tmp_path / "1.json").write_text("\n".join(json.dumps(dict(zip(("session_id", "action", "payload"), r, strict=True))) for r in rows))
    (tmp_path / "2.json").write_text("\n".join(json.dumps({"session_id": s, "action": "get"}) for s in ("s1", "s2")))
    stream = stateful.readStream.schema("session_id string, action string, payload string").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    got = _run(stateful, streams.vault(stream), "vaulted", 2)
    assert {r["session_id"]: r["mapping"] for r in got} == {"s1": '{"[A_001]": "x"}', "s2": None}


def test_limiter_stream(stateful, tmp_path):
    (tmp_path / "1.json").write_text("\n".join(json.dumps({"key": "a", "hit_id": n, "at": float(n)}) for n in range(4)))
    stream = stateful.readStream.schema("key string, hit_id long, at double").json(str(tmp_path))
    got = _run(stateful, streams.limiter(stream, 2, 60.0), "limited", 4)
    assert [r["accepted"] for r in sorted(got, key=lambda r: r["hit_id"])] == [True, True, False, False]
