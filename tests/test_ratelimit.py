"""The rate limit of a client that holds most of the requests."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from palisade.operators import ratelimit

WINDOW = 60


def plain(rows, limit):
    """One request after the other."""
    passed, out = {}, []
    for client, seconds, tie in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
        own = passed.setdefault(client, deque())
        while own and seconds - own[0] > WINDOW:
            own.popleft()
        if len(own) < limit:
            own.append(seconds)
            out.append(tie)
    return set(out)


def decided(spark, rows, limit):
    df = spark.createDataFrame(rows, "client string, seconds double, tie string").select(
        "client", "tie", F.expr("timestamp_micros(cast(seconds * 1000000 as long))").alias("ts")).repartition(5)
    return ratelimit.rate_limit(df, "client", "ts", "tie", limit)


@pytest.mark.parametrize("limit", [0, 1, 3, 17])
def test_a_hot_client_is_spread_and_decided_as_one_by_one(spark, monkeypatch, limit):
    monkeypatch.setattr(ratelimit, "BLOCK", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(limit)
    # nine of ten requests are one client's: bursts of equal times, dense stretches, and silences
    rows, now = [], 0.0
    for i in range(4000):
        now += rng.choice([0, 0, 0.25, 1, 5, 20]) + (rng.random() < 0.003) * 500
        rows.append(("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), now, f"t{i:05d}"))
    rows += [("hot", None, "never"), (None, None, "never2")]
    found = decided(spark, rows, limit)
    try:
        kept = found.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(kept) == len(rows)
    assert {r["tie"] for r in kept if r["admitted"]} == plain(rows, limit)
    assert len({r["task"] for r in kept if r["client"] == "hot"}) > 1


def test_two_passes_that_point_to_one_request(spark):
    # both of the first two may be followed from second 100 on; the second of them takes second 101
    rows = [("c", float(s), f"t{s}") for s in (0, 1, 100, 101, 102)]
    assert {r["tie"] for r in decided(spark, rows, 2).collect() if r["admitted"]} == {"t0", "t1", "t100", "t101"}


def test_no_requests(spark):
    assert decided(spark, [], 3).count() == 0
