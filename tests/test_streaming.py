"""The limits as streams: the state survives restarts, and event-time order does not depend on arrival."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from resolvent.operators import limiter
from resolvent.streaming.limiter import LATE, limited_stream, settled_stream, transport_stream

LIMITS = limiter.Limits(transport=(("per_transport", limiter.DAY, 8),), counters=(("per_day", limiter.DAY, 2),), members=("m", 5 * limiter.DAY, 3), cells=("cells", 9 * limiter.DAY, 3), formats=("f", 9 * limiter.DAY, 1))


@pytest.fixture(scope="module")
def events(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "ts", "event_type").orderBy("ts", "event_id").limit(400)
    e = e.withColumns({"tr": F.pmod("user_id", F.lit(4)), "cell": F.pmod("event_id", F.lit(5)), "code": F.pmod("event_id", F.lit(3))})
    return e.collect(), e.schema


def _arrive(spark, rows, schema, at):
    """One more file: a micro-batch of its own, taken in after the earlier ones."""
    time.sleep(1.05)
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(at))


def _source(spark, at, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(at))


def _run(df, folder, name, idle=False):
    """Take in all files that are there, and stop; a later call goes on from the checkpoint.  Without ``idle`` no batch runs
    that has no data: state with a time to live would keep such a query going for ever."""
    df.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(idle).lower())
    q = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(folder / f"ck-{name}")).trigger(availableNow=True).start(str(folder / name))
    assert q.awaitTermination(120), "the query goes on and on"


def _reasons(spark, folder, name):
    return {r.event_id: r.reason for r in spark.read.parquet(str(folder / name)).collect()}


def test_arriving_streams_equal_batch_across_a_restart(spark, tmp_path, events):
    rows, schema = events
    for k in range(2):
        _arrive(spark, rows[200 * k : 200 * k + 200], schema, tmp_path / "in")
        _run(transport_stream(_source(spark, tmp_path / "in", schema), LIMITS, "tr").coalesce(1), tmp_path, "passed")
        passed = spark.read.parquet(str(tmp_path / "passed")).schema
        _run(limited_stream(_source(spark, tmp_path / "passed", passed), LIMITS, "user_id", "event_type", "cell", "code", "reason"), tmp_path, "out")
    batch = limiter.limiter_chain(spark.createDataFrame(rows, schema), LIMITS, "user_id", "tr", "event_type", "cell", "code")
    want = {r.event_id: r.reason for r in batch.collect()}
    assert _reasons(spark, tmp_path, "out") == want and set(want.values()) == {None, "per_transport", "per_day", "m", "cells", "f"}


def test_settled_stream_equals_batch_however_events_arrive(spark, tmp_path, events):
    rows, schema = events
    # Shuffled within a bounded disorder: an event comes at most some days after younger ones.
    rng = random.Random(3)
    shuffled = sorted(rows, key=lambda r: r.ts.timestamp() + rng.random() * 4 * 86_400)
    for k in range(4):
        _arrive(spark, shuffled[100 * k : 100 * k + 100], schema, tmp_path / "in")
    end = rows[-1].asDict() | {"event_id": -1, "user_id": -1, "ts": rows[-1].ts.replace(year=rows[-1].ts.year + 1)}
    _arrive(spark, [tuple(end[c] for c in schema.names)], schema, tmp_path / "in")
    source = _source(spark, tmp_path / "in", schema)
    _run(settled_stream(source, LIMITS, "user_id", "5 days", "event_type", "cell", "code"), tmp_path, "out", idle=True)
    batch = limiter.limiter_chain(spark.createDataFrame(rows, schema), LIMITS, "user_id", None, "event_type", "cell", "code")
    want = {r.event_id: r.reason for r in batch.collect()}
    got = _reasons(spark, tmp_path, "out")
    assert {k: v for k, v in got.items() if k >= 0} == want and len(set(want.values())) > 3


def test_events_behind_the_watermark_come_out_as_late(spark, tmp_path):
    schema = "event_id long, user_id long, ts timestamp"
    at = lambda *rows: _arrive(spark, spark.createDataFrame([(i, 1, t) for i, t in rows], "i long, u long, t string").select("i", "u", F.to_timestamp("t")).toDF("event_id", "user_id", "ts").collect(), schema, tmp_path / "in")
    limits = limiter.Limits(transport=(), counters=(("per_hour", limiter.HOUR, 2),), members=None, cells=None, formats=None)
    at((1, "2024-01-01 10:00:00"), (2, "2024-01-01 10:20:00"))
    at((3, "2024-01-01 12:00:00"))
    at((4, "2024-01-01 10:10:00"), (5, "2024-01-01 11:50:00"), (6, "2024-01-01 12:10:00"))  # 4 is behind 11:30, 5 is not
    at((7, "2024-01-02 12:00:00"))
    _run(settled_stream(_source(spark, tmp_path / "in", spark.createDataFrame([], schema).schema), limits, "user_id", "30 minutes"), tmp_path, "out", idle=True)
    got = _reasons(spark, tmp_path, "out")
    got.pop(7, None)
    assert got == {1: None, 2: None, 4: LATE, 5: None, 3: None, 6: "per_hour"}
