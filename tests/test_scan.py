"""Scans over many tasks against plain loops, and busy keys against the fold of one task."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from resolvent.operators import anchored, limiter, scan
from resolvent.sources import adapters


@pytest.fixture
def small_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("seed", range(3))
def test_carried_values_and_sums(spark, small_batches, seed):
    r = random.Random(seed)
    rows = [(r.choice(["a", "a", "a", "b", None, "c"]), i, r.choice([None, None, i]), r.choice([None, 1, 5])) for i in range(300)]
    placed = scan.ordered(spark.createDataFrame(rows, "k string, i int, v int, x int"), ["k"], ["i"], 7)
    assert placed.rdd.getNumPartitions() == 7
    both = scan.carried(scan.carried(placed, ["k"], F.when(F.col("v").isNotNull(), F.array("v")), "last"), ["k"], "x", "total", "sum")
    want, last, total = {}, {}, {}
    for k, i, v, x in rows:
        last[k] = [v] if v is not None else last.get(k)
        total[k] = total.get(k, 0) + (x or 0)
        want[i] = (last[k], total[k])
    assert {g.i: (g.last, g.total) for g in both.collect()} == want


def test_numbers_run_over_the_whole_table(spark, small_batches):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("x"))
    assert {(r.x, r.place) for r in scan.numbered(df, [F.col("x").desc()], partitions=6).collect()} == {(x, 500 - x) for x in range(500)}
    assert scan.numbered(df.limit(0), ["x"]).collect() == []


def test_headers_are_carried_over_a_sheet_of_many_tasks(spark, small_batches):
    rows = [("f", n, ["Product", "Part"] if n % 50 == 0 else [f"p{n}", f"q{n}"]) if n // 50 % 2 == 0 else ("f", n, ["Part", "Product"] if n % 50 == 0 else [f"q{n}", f"p{n}"]) for n in range(5, 400)]
    rows += [("g", n, [f"p{n}", f"q{n}"]) for n in range(20)]
    got = adapters.under_headers(spark.createDataFrame(rows, "file string, row_no long, cells array<string>"), "product", {"label": "product", "part": "part"}, partitions=9)
    assert {(r.file, r.row_no, r.label, r.part) for r in got.collect()} == {("f", n, f"p{n}", f"q{n}") for n in range(51, 400) if n % 50}


@pytest.fixture(scope="module")
def mixed(spark):
    r = random.Random(5)
    rows = [(i, "hot" if r.random() < 0.6 else r.choice(["a", None, "c"]), r.randint(-200, 400), r.choice("xyz"), r.choice([None, "c1", "c2"])) for i in range(200)]
    return spark.createDataFrame(rows, "event_id long, k string, s long, m string, c string").withColumn("ts", F.timestamp_micros("s"))


def test_busy_counters_fold_as_others_do(spark, mixed):
    n = lambda **x: {(a.event_id, a.n) for a in limiter.anchored_counter(mixed, "k", 23, **x).collect()}
    assert n() == n(busy=40)


def test_busy_chains_fold_as_others_do(spark, mixed):
    limits = limiter.Limits(transport=(), counters=(("a", 50, 6),), members=None, cells=None, formats=("form", 300, 2))
    reason = lambda **x: {(a.event_id, a.reason) for a in limiter.limiter_chain(mixed, limits, "k", None, None, "c", "m", **x).collect()}
    assert reason() == reason(busy=90) and len({x for _, x in reason()}) == 3


def test_a_window_of_very_many_events_ends(spark):
    """All of a key's events lie in one window, or in the first and the last cell of many: the levels still come to an end."""
    for times in (list(range(60)), [*range(40), *range(5000, 5040)], [-3, *range(40)]):
        e = spark.createDataFrame([("hot", t) for t in times], "k string, t long")
        want, at = [], None
        for t in times:
            if at is None or t >= at + 1000:
                at = t
                want.append(t)
        assert sorted(r.t for r in anchored.window_starts(e, 1000, most=5).collect()) == want


def test_a_busy_key_is_many_tasks(spark):
    e = spark.range(4000).select(F.col("id").alias("event_id"), F.lit("hot").alias("k"), F.timestamp_micros(F.col("id") * 3).alias("ts"), (F.col("id") * 3).alias("_t"))
    rows = anchored.opened(e, "k", 100, ("event_id",), most=10, partitions=5)
    assert rows.rdd.getNumPartitions() == 5 and len({r.p for r in rows.select(F.spark_partition_id().alias("p")).distinct().collect()}) == 5
    starts = {r["__start"] for r in rows.collect()}
    want, at = set(), None
    for t in range(0, 12000, 3):
        if at is None or t >= at + 100:
            at = t
            want.add(t)
    assert starts == want
