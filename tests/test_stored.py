"""The keyed event table, the archive's index, and rates over the last seconds."""

import datetime

import pytest
from pyspark.sql import functions as F

from palisade.operators import eventtable, metrics, onboarding
from palisade.operators.envelope import make_envelope
from palisade.plans.ingest import run
from palisade.sources import archive, archiveindex
from palisade.streaming.windows import sliding_rates
from workload import stored
from workload.corpus import corpus


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _batch(spark, ids, value):
    return spark.createDataFrame([(f"e{i}", value) for i in ids], "event_id string, value int")


def _rows(df):
    return {r.event_id: (r.value, r.batch_version) for r in df.collect()}


def test_event_table_keeps_the_newest_row(spark, tmp_path):
    path = str(tmp_path / "table")
    eventtable.append(_batch(spark, range(100), 1), path, 1)
    eventtable.append(_batch(spark, range(50, 120), 2), path, 2)
    want = {f"e{i}": (1, 1) if i < 50 else (2, 2) for i in range(120)}
    assert _rows(eventtable.read(spark, path)) == want
    eventtable.compact(spark, path, buckets=8)
    compacted = eventtable.read(spark, path)
    assert _rows(compacted) == want and "Exchange" not in _plan(compacted)
    eventtable.compact(spark, path)  # nothing new: no further generation
    assert not archive.path_exists(spark, f"{path}/generations/generation=2")
    # a batch written again replaces itself; one that is compacted already changes nothing
    eventtable.append(_batch(spark, range(0, 10), 9), path, 3)
    eventtable.append(_batch(spark, range(0, 5), 3), path, 3)
    eventtable.append(_batch(spark, range(100), 1), path, 1)
    want |= {f"e{i}": (3, 3) for i in range(5)}
    assert _rows(eventtable.read(spark, path)) == want
    found = eventtable.get_events(spark, path, ["e1", "e70", "nobody"])
    assert _rows(found) == {"e1": (3, 3), "e70": (2, 2)}
    eventtable.compact(spark, path)
    assert _rows(eventtable.read(spark, path)) == want
    assert eventtable.expire(spark, path) == ["batches/batch_version=1", "batches/batch_version=2", "generations/generation=1"]
    assert _rows(eventtable.read(spark, path)) == want and eventtable.expire(spark, path) == []


def test_a_generation_without_its_state_is_not_there(spark, tmp_path):
    path = str(tmp_path / "table")
    eventtable.append(_batch(spark, range(10), 1), path, 1)
    # what a lost driver leaves behind: files of a generation, and no row of state
    _batch(spark, range(3), 7).withColumns({"batch_version": F.lit(1), "bucket": F.lit(0)}).write.partitionBy("bucket").parquet(
        f"{path}/generations/generation=1")
    assert _rows(eventtable.read(spark, path)) == {f"e{i}": (1, 1) for i in range(10)}
    eventtable.compact(spark, path, buckets=4)
    assert _rows(eventtable.read(spark, path)) == {f"e{i}": (1, 1) for i in range(10)}


def test_lookups_read_few_partitions(spark, tmp_path):
    raw, index = str(tmp_path / "raw"), str(tmp_path / "index")
    lines = spark.range(200).selectExpr(
        "id", "concat('line ', id) as raw_payload", "timestampadd(DAY, cast(id % 20 as int), timestamp'2026-03-01 05:00:00Z') as day")
    envelopes = make_envelope(lines, position="id", ingest_ts="day")
    archive.archive_raw(envelopes.filter("cast(source_position as int) < 100"), raw)
    assert archiveindex.update_index(spark, raw, index) == 20 and archiveindex.update_index(spark, raw, index) == 0
    # late lines of days that are indexed already, and of no other
    archive.archive_raw(envelopes.filter("cast(source_position as int) % 20 < 3"), raw)
    assert archiveindex.update_index(spark, raw, index) == 3
    assert archiveindex.read_index(spark, index).count() == archive.read_archive(spark, raw).count() == 115
    ids = envelopes.filter("source_position in ('1', '21', '161', '180')").select("event_id")
    found = archiveindex.lookup(spark, raw, index, ids)
    assert sorted(r.raw_payload for r in found.collect()) == ["line 1", "line 161", "line 180", "line 21"]
    assert {(r.month, r.day) for r in found.select("month", "day").distinct().collect()} == {("03", "02"), ("03", "01")}
    pruned = [line for line in _plan(found).splitlines() if "PartitionFilters" in line and "raw" in line]
    assert pruned and all("day" in line for line in pruned)
    assert archiveindex.lookup(spark, raw, index, ids.filter("false")).count() == 0


def test_trailing_rate_against_counting(spark):
    seconds = [-700.5, -640.0, -639.0, 0.0, 0.0, 0.0, 4.999999, 5.0, 5.000001, 9.0, 319.0, 320.0, 320.5, 324.0, 326.0, 640.0, 644.9, 645.0, 1000.0]
    rows = spark.createDataFrame([(s,) for s in [*seconds, None]], "s double").selectExpr(
        "timestamp_micros(cast(round(s * 1000000) as long)) as ts")
    got = {r.ts_us: (r.events, r.eps) for r in metrics.trailing_rate(rows, "ts", 5).collect()}
    us = [round(s * 1_000_000) for s in seconds]
    counts = {t: sum(t - 5_000_000 <= o <= t for o in us) for t in us}
    assert got == {t: (n, round(n / 5, 1)) for t, n in counts.items()}
    assert metrics.trailing_rate(rows.limit(0), "ts").count() == 0


def test_sliding_rates_of_a_stream_with_late_rows(spark, tmp_path):
    t0 = datetime.datetime(2026, 8, 27, 10, tzinfo=datetime.timezone.utc)
    source = str(tmp_path / "source")
    for batch in ([0.5, 1.5, 1.7], [3.2, 90.0], [2.0, 91.0], [89.0, 200.0], [500.0]):  # 2.0 comes too late, 89.0 does not
        spark.createDataFrame([(t0 + datetime.timedelta(seconds=s),) for s in batch], "ts timestamp").coalesce(1).write.mode(
            "append").parquet(source)
        stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        query = sliding_rates(stream, "ts", seconds=5, every=1, late="30 seconds").writeStream.format("parquet").option(
            "checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    got = {r.at_ms - int(t0.timestamp() * 1000): r.events for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    kept = [0.5, 1.5, 1.7, 3.2, 90.0, 91.0, 89.0, 200.0]
    wanted = {w * 1000: sum(w - 5 <= s < w for s in kept) for w in range(1, 206)}
    assert got == {w: n for w, n in wanted.items() if n}


def test_publishing_all_sessions(spark):
    t0 = datetime.datetime(2026, 8, 27, 10)
    texts = ["alpha beta gamma 1", "alpha beta gamma 2", "one two three four five 6"]
    lines = spark.createDataFrame([(t, t0 + datetime.timedelta(seconds=i)) for i, t in enumerate(texts)], "raw_payload string, ingest_ts timestamp")
    found = onboarding.onboarding_sessions(lines).cache()
    entries, sessions, audit = onboarding.publish_pending(found, onboarding.empty_catalogue(spark), "rev")
    assert entries.count() == 2 and {r.status for r in sessions.collect()} == {"PUBLISHED"} and audit.count() == 2
    assert {r.published_parser_id for r in sessions.collect()} == {r.parser_id for r in entries.collect()}
    with pytest.raises(ValueError):
        onboarding.publish_pending(found, entries, "rev")
    none, same, _ = onboarding.publish_pending(sessions, entries, "rev")
    assert none.count() == 0 and same.count() == 2
    found.unpersist()


def test_trailing_rate_sums_a_full_window_once(spark):
    rows = spark.range(5000).selectExpr("timestamp_micros(id * 100) as ts")
    found = metrics.trailing_rate(rows, "ts", 5)
    assert [r.events for r in found.orderBy("ts_us").collect()] == list(range(1, 5001))
    frames = [line for line in _plan(found).splitlines() if "RangeFrame" in line]
    assert frames and all("unboundedpreceding" in line for line in frames)


def test_counters_judge_the_corpus_once(spark, tmp_path, monkeypatch):
    spark.range(120).selectExpr(
        "id as event_id", "timestampadd(SECOND, cast(id as int), timestamp_ntz'2024-01-01 00:00:00') as ts", "id as user_id",
        "if(id % 4 = 0, 'error', 'view') as event_type", "id + 0.5D as value", "'{}' as props").write.parquet(f"{tmp_path}/events.parquet")
    judged = []
    monkeypatch.setattr(stored, "corpus", lambda *given: judged.append(given) or corpus(*given))
    row = stored.counters(spark, str(tmp_path)).first()
    assert len(judged) == 1
    dead = run(corpus(spark, str(tmp_path)), position="event_id", ingest_ts="ingest_ts", document=False, enriched=False).filter(
        "error_stage is not null")
    assert row.total_ingested == 120 and row.total_ingested - row.total_normalized == dead.count()
    assert row.unresolved_errors_count == dead.filter("raw_payload like '[APPLIANCE%'").count()
    judged.clear()
    listed = stored.dead_letters_listed(spark, str(tmp_path)).collect()
    assert len(judged) == 1 and sum(r.records for r in listed if r.letters == "all") == dead.count()
