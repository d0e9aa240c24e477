import time

import pytest
from pyspark.sql import functions as F

from palisade.operators import delivery
from palisade.operators.sinks import upsert_events, write_lake
from palisade.plans.ingest import run
from palisade.sources.logs import read_log_lines, read_log_stream
from palisade.streaming.ingest import start
from palisade.streaming.ratelimit import rate_limit_stream
from palisade.streaming.windows import dedupe_stream, event_rates
from tests import lines as L


def _finish(frame, name, mode="append", folder=None):
    writer = frame.writeStream.format("memory").queryName(name).outputMode(mode)
    query = writer.option("checkpointLocation", folder).start()
    query.processAllAvailable()
    query.stop()


def test_stream_equals_batch(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    lines = [x for x in L.ALL if x.strip() and "\u0000" not in x]
    (landing / "a.log").write_text("\n".join([*lines[::2], lines[0], lines[0]]) + "\n")
    (landing / "b.log").write_text("\n".join(lines[1::2]) + "\n")
    lake, events, ledger = (str(tmp_path / n) for n in ("lake", "events", "ledger"))

    def search_sink(df):
        upsert_events(df.select("event_id", "vendor", "severity"), events, 1)

    query = start(
        read_log_stream(spark, str(landing)), str(tmp_path / "staged"), str(tmp_path / "dead"), ledger,
        str(tmp_path / "checkpoint"), search_sink, lambda df: write_lake(df, lake), available_now=True,
        archive=str(tmp_path / "archive"))
    query.awaitTermination(150)
    assert query.exception() is None
    staged = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "staged"))
    batch = run(read_log_lines(spark, str(landing)), document=False)
    columns = ["raw_payload", "error_stage", "parser_used", "severity_id", "disposition_id", "src_ip", "dst_ip"]
    assert sorted(map(str, staged.select(columns).collect())) == sorted(map(str, batch.select(columns).collect()))
    good = staged.filter("error_stage is null").count()
    assert spark.read.parquet(str(tmp_path / "archive")).count() == staged.count()
    assert {r.provenance_chain[1] for r in staged.collect()} == {"RAW_ARCHIVED_SHA256"}
    assert spark.read.parquet(lake).count() == spark.read.parquet(events).count() == good
    stats = delivery.delivery_stats(spark.read.option("recursiveFileLookup", "true").parquet(ledger)).collect()
    assert [(r.state, r.events) for r in stats] == [("DELIVERY_COMPLETE", good)]


def test_failed_sink_and_failed_archive(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "a.log").write_text(L.ASA_DENY + "\n")
    events, calls = str(tmp_path / "events"), []

    def flaky(df):
        calls.append(df.count())
        if len(calls) == 1:
            raise OSError("down")
        df.select("event_id").write.mode("append").parquet(events)

    paths = [str(tmp_path / n) for n in ("staged", "dead", "ledger", "checkpoint")]

    def go(archive="archive"):
        query = start(read_log_stream(spark, str(landing)), *paths, flaky, lambda df: None, available_now=True, archive=str(tmp_path / archive))
        query.awaitTermination(150)
        assert query.exception() is None

    go()
    dead = spark.read.parquet(paths[1])
    assert [(r.error_stage, r.errors) for r in dead.collect()] == [("OUTBOX_DELIVERY", ["Search delivery failed: down"])]
    time.sleep(6)  # the first back-off
    (landing / "b.log").write_text(L.SQUID_MISS + "\n")
    go()
    assert spark.read.parquet(events).count() == 2
    done = delivery.delivered(
        spark.read.option("recursiveFileLookup", "true").parquet(paths[0]),
        spark.read.option("recursiveFileLookup", "true").parquet(paths[2])).collect()
    assert len(done) == 2 and {r.provenance_chain[-1] for r in done} == {"DELIVERY_COMPLETE_DUAL_ACK"}

    (tmp_path / "blocked").write_text("a file where the archive should be")
    (landing / "c.log").write_text(L.SQUID_MISS + "\n")
    go("blocked")
    rows = spark.read.parquet(paths[1]).filter("error_stage = 'RAW_STORE'").collect()
    assert [r.raw_payload for r in rows] == [L.SQUID_MISS] and len(calls) == 3


def _timed(spark, tmp_path, rows):
    folder = str(tmp_path / "rows")
    spark.createDataFrame(rows, "event_id string, client string, s long").selectExpr(
        "event_id", "client", "timestamp_seconds(s) as ts").write.parquet(folder)
    return spark.readStream.schema("event_id string, client string, ts timestamp").parquet(folder)


def test_rates(spark, tmp_path):
    stream = _timed(spark, tmp_path, [(f"e{i}", "c", 1_000_000 + i) for i in range(200)])
    _finish(event_rates(stream, "ts"), "rates", folder=str(tmp_path / "cp"))
    rows = spark.table("rates").collect()
    assert rows and all(r.eps == 1.0 and r.events == 5 for r in rows)


def test_dedupe(spark, tmp_path):
    stream = _timed(spark, tmp_path, [(f"e{i % 5}", "c", 1_000_000) for i in range(20)])
    _finish(dedupe_stream(stream, "ts"), "unique_events", folder=str(tmp_path / "cp"))
    assert spark.table("unique_events").count() == 5


def test_rate_limit(spark, tmp_path):
    rows = [(f"e{i:02d}", "hot", 1_000_000 + i) for i in range(8)] + [("x", "other", 1_000_001)]
    rows += [("late", "hot", 1_000_061)]
    decided = rate_limit_stream(_timed(spark, tmp_path, rows), "client", "ts", "event_id", limit=5)
    try:
        _finish(decided, "limited", folder=str(tmp_path / "cp"))
    except Exception as failure:  # noqa: BLE001
        if "transformWithState" in str(failure) and "not supported" in str(failure):
            pytest.skip("stateful processor not available here")
        raise
    admitted = {r.tie: r.admitted for r in spark.table("limited").collect()}
    assert [admitted[f"e{i:02d}"] for i in range(8)] == [True] * 5 + [False] * 3
    assert admitted["x"] and admitted["late"]
    assert spark.table("limited").filter(F.col("admitted")).count() == 7
