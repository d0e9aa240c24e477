import datetime
import hashlib
import ipaddress
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from palisade.functions.text import sanitize_text
from palisade.functions.values import ipv4_to_long, is_private, long_to_ipv4, protocol_name, protocol_number
from palisade.operators import audit, deadletter, delivery, metrics, mining, onboarding, ratelimit, search, sinks
from palisade.operators.dimensions import geo_intervals
from palisade.operators.enrich import enrich_geo
from palisade.operators.envelope import make_envelope
from palisade.operators.parsers import Definition, Rule
from palisade.plans.ingest import run
from palisade.sources import archive, digests, logs
from tests import lines as L
from tests.conftest import payload_frame

T0 = datetime.datetime(2026, 8, 27, 10, 0, 0, tzinfo=datetime.timezone.utc)


def test_log_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\n\n  # note\n  two  \n\xff three\n")
    rows = logs.read_log_lines(spark, str(tmp_path / "a.log"), vendor_hint="V").collect()
    assert sorted(r.raw_payload for r in rows) == ["one", "two", "� three"]
    assert len({r.source_position for r in rows}) == 3 and rows[0].vendor_hint == "V"


def test_json_array_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"b": 1, "a": 2.5}, "plain"]')
    rows = logs.read_json_array_files(spark, str(tmp_path)).collect()
    assert sorted(r.raw_payload for r in rows) == sorted(['{"a":2.5,"b":1}', "plain"])


def test_archive_is_write_once_and_checkable(spark, tmp_path):
    path = str(tmp_path / "archive")
    envelopes = make_envelope(payload_frame(spark, L.ALL), position="i")
    archive.archive_raw(envelopes, path)
    archive.archive_raw(envelopes, path)
    stored = archive.read_archive(spark, path)
    assert stored.count() == len(L.ALL)
    assert archive.verify_integrity(stored).filter("not is_valid").count() == 0
    first = stored.orderBy("event_id").first()
    broken = stored.withColumn(
        "raw_payload",
        F.when(F.col("event_id") == first.event_id, F.lit(None)).otherwise(F.concat("raw_payload", F.lit("x"))))
    ids = spark.createDataFrame([(first.event_id,), ("none",)], "event_id string")
    found = {r.event_id: r for r in archive.verify_integrity(broken, ids).collect()}
    assert found[first.event_id].tampered and "missing" in found[first.event_id].details
    assert not found["none"].tampered and not found["none"].is_valid
    assert archive.verify_integrity(broken).filter("tampered").count() == len(L.ALL)
    assert archive.read_raw_archive(stored, ids=ids).count() == 1
    uris = stored.limit(1).selectExpr("concat(bucket, '/', object_key) as raw_storage_uri")
    assert archive.read_raw_archive(stored, uris=uris).count() == 1


def test_line_ends_are_alike_in_whole_and_split_files(spark, tmp_path, monkeypatch):
    (tmp_path / "m.log").write_bytes(b"one\r\ntwo\rthree\n\n# note\nfour\xff")
    (tmp_path / "empty.log").write_bytes(b"")

    def read():
        return sorted((r.raw_payload, r.source_position.rsplit("#", 1)[1]) for r in logs.read_log_lines(spark, str(tmp_path)).collect())

    whole = read()
    assert whole == [("four\ufffd", "5"), ("one", "0"), ("three", "2"), ("two", "1")]
    monkeypatch.setattr(logs, "WHOLE_BYTES", -1)
    assert read() == whole


def test_archive_reads_its_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    lines = payload_frame(spark, L.ALL)
    envelopes = make_envelope(lines.mapInArrow(count, lines.schema), position="i")
    for n in (1, 2):
        kept = archive.archive_raw(envelopes, str(tmp_path / "raw"), staged=str(tmp_path / "staged"))
        run(lines, position="i").select("event_id").join(kept, "event_id", "left_anti").count()
        assert seen.value == n * len(L.ALL)
    assert archive.read_archive(spark, str(tmp_path / "raw")).count() == kept.count() == len(L.ALL)


def test_days_of_a_batch_are_bounded(spark, monkeypatch):
    days = spark.createDataFrame([("2026", "01", f"{d:02d}") for d in range(1, 5)], "year string, month string, day string")
    assert len(archive.distinct_days(days)) == 4
    monkeypatch.setattr(archive, "MOST_DAYS", 3)
    with pytest.raises(ValueError, match="more than 3 days"):
        archive.distinct_days(days)


def test_manifest(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_text("hello")
    (tmp_path / "y.txt").write_text("world")
    manifest = archive.dataset_manifest(spark, str(tmp_path)).collect()
    assert {r.path for r in manifest} == {"d/x.txt", "y.txt"}
    kept = spark.createDataFrame(manifest)
    (tmp_path / "y.txt").write_text("changed")
    (tmp_path / "d" / "x.txt").rename(tmp_path / "new.txt")
    status = archive.verify_manifest(kept, archive.dataset_manifest(spark, str(tmp_path)))
    assert {r.path: r.status for r in status.collect()} == {"d/x.txt": "missing", "y.txt": "mismatch"}


def test_manifest_of_files_larger_than_a_task_may_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "PIECE_BYTES", 100, raising=False)
    (tmp_path / "d").mkdir()
    sizes = {"d/99": 99, "d/100": 100, "101": 101, "d/a %41 b": 199, "200.gz": 200, "d/201": 201, "1000": 1000}
    for name, size in sizes.items():
        (tmp_path / name).write_bytes(random.Random(size).randbytes(size))
    expected = {name: hashlib.sha256((tmp_path / name).read_bytes()).hexdigest() for name in sizes}
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")
    try:
        rows = archive.dataset_manifest(spark, str(tmp_path)).collect()
        view = spark._jsc.hadoopConfiguration()
        view.set("fs.viewfs.mounttable.manifest.link./in", f"file://{tmp_path}")
        seen_from_afar = archive.dataset_manifest(spark, "viewfs://manifest/in").collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert len(rows) == len(seen_from_afar) == len(sizes)
    assert {r.path: r.sha256 for r in rows} == {r.path: r.sha256 for r in seen_from_afar} == expected


def test_piece_of_a_file_is_all_a_task_reads(tmp_path):
    file = tmp_path / "f"
    file.write_bytes(b"a" * 250)
    first = digests._advanced(("k", str(file), 250, 0, None, None), 100)
    assert first[3] == 100
    second = digests._advanced(first, 100)
    assert second[3] == 200
    assert digests._advanced(second, 100)[3:5] == (250, hashlib.sha256(b"a" * 250).hexdigest())
    file.write_bytes(b"b" * 251)
    with pytest.raises(OSError, match="was changed"):
        digests._advanced(second, 100)


def test_lake_holds_each_event_once(spark, tmp_path):
    path = str(tmp_path / "lake")
    good = run(payload_frame(spark, L.ALL), position="i", document=False).filter("error_stage is null")
    sinks.write_lake(good, path)
    sinks.write_lake(good, path)
    lake = sinks.read_lake(spark, path)
    assert lake.count() == lake.select("event_id").distinct().count() == good.count()
    assert archive.lake_files(spark, path).count() >= 1


def test_upsert_last_write_wins(spark, tmp_path):
    path = str(tmp_path / "events")
    for batch, value in ((1, "a"), (2, "b"), (2, "b")):
        sinks.upsert_events(spark.createDataFrame([("e", value)], "event_id string, v string"), path, batch)
    assert [r.v for r in sinks.current_events(spark.read.parquet(path)).collect()] == ["b"]


def test_dead_letters_and_replay(spark, tmp_path):
    path = str(tmp_path / "dead")
    judged = run(payload_frame(spark, [*L.UNKNOWN, "   "]), position="i", document=False, enriched=False)
    deadletter.record_failures(judged.filter("error_stage is not null"), path)
    records = spark.read.parquet(path)
    assert deadletter.list_errors(records, "UNRESOLVED").count() == 4
    rule = Definition(
        "custom", "V", "P", "1.0.0", r"SRC=((?:[0-9]{1,3}\.){3}[0-9]{1,3}).*ACTION=(\w+)", ("src_0", "action_1"),
        (Rule("src_0", "src_ip"), Rule("action_1", "action", "to_lower"), Rule("none", "bytes", "to_int", "7")))
    outcome, states = deadletter.replay(
        records, lambda rows: run(rows, [rule], document=False, enriched=False))
    summary = deadletter.replay_summary(outcome).first()
    assert (summary.total_replayed, summary.successful_normalizations) == (4, 3)
    parsed = {r.raw_payload: r for r in outcome.collect()}
    assert parsed[L.UNKNOWN[0]].disposition == "Blocked" and parsed[L.UNKNOWN[2]].disposition == "Allowed"
    assert parsed[L.UNKNOWN[0]].bytes_total == 7 and parsed[L.UNKNOWN[0]].parser_used == "custom"
    states.write.mode("append").parquet(path)
    again = spark.read.parquet(path)
    assert deadletter.list_errors(again, "UNRESOLVED").count() == 0
    assert {r.replay_count for r in deadletter.list_errors(again).collect()} == {1}
    deadletter.clear_resolved(spark, path, str(tmp_path / "open"))
    assert spark.read.parquet(str(tmp_path / "open")).count() == 0


def _ten_events(spark):
    rows = [
        (f"evt-{i:03d}", i, "Cisco" if i < 5 else "Palo Alto", "ASA" if i < 5 else "PAN-OS", "syslog_rfc3164",
         "High" if i % 2 else "Low", 4 if i % 2 else 2, "Blocked" if i % 2 else "Allowed", f"192.168.1.{10 + i}",
         f"log from {'ASA' if i < 5 else 'PAN-OS'} number {i}", 100, "p")
        for i in range(10)]
    return spark.createDataFrame(
        rows, "event_id string, time_epoch long, vendor string, product string, detected_format string, severity string,"
        " severity_id int, disposition string, src_ip string, raw_payload string, byte_length int, parser_used string")


def test_search(spark):
    events = _ten_events(spark)
    assert search.search(events, vendor="Cisco").total.first().total == 5
    assert search.search(events, src_ip="1.10").total.first().total == 1
    assert search.search(events, src_ip="168.1.1", ip_match="exact").total.first().total == 0
    assert search.search(events, query='"PAN-OS"').total.first().total == 5
    assert search.search(events, query="OS PAN").total.first().total == 0
    assert search.search(events, query="os nothing", query_mode="terms").total.first().total == 5
    page = search.search(events, limit=3, offset=3).page.collect()
    assert [r.event_id for r in page] == ["evt-006", "evt-005", "evt-004"]
    assert search.get_event(events, "evt-001").count() == 1
    with pytest.raises(ValueError):
        search.search(events, limit=501)


def test_facets_and_totals(spark):
    counts = {(r.facet, r.value): r.events for r in search.facet_counts(_ten_events(spark)).collect()}
    assert counts[("vendor", "Cisco")] == 5 and counts[("parser_used", "p")] == 10
    assert search.totals(_ten_events(spark)).first().total_bytes == 1000
    many = spark.range(100).selectExpr("concat('v', id % 15) as vendor")
    assert search.facet_counts(many, {"vendor": 10}).count() == 10


def test_exact_percentiles_against_sorting(spark):
    rows = spark.range(0, 30000).selectExpr(
        "case when id % 3 = 0 then 'hot' else concat('g', id % 7) end as g", "pmod(xxhash64(id), 100000) / 7D as v")
    found = {r.g: r for r in metrics.exact_percentiles(rows, "v", ["g"], {"a": 0.5, "b": 0.95, "c": 0.99}).collect()}
    lists = {r.g: sorted(r.vs) for r in rows.groupBy("g").agg(F.collect_list("v").alias("vs")).collect()}
    for g, values in lists.items():
        n = len(values)
        assert (found[g].a, found[g].b, found[g].c) == tuple(values[int(n * q)] for q in (0.5, 0.95, 0.99))
        assert found[g].n == n


def test_latency_of_the_last_rows(spark):
    rows = spark.range(100).selectExpr("id", "cast(id as double) as ms")
    assert metrics.latency_percentiles(rows, "ms", last=10, order="id").first().p50 == 95.0


def _brute(times, limit, window):
    history, out = deque(), []
    for t in times:
        while history and history[0] < t - window:
            history.popleft()
        out.append(len(history) < limit)
        if out[-1]:
            history.append(t)
    return out


def test_rate_limit(spark):
    rows = spark.range(400).selectExpr(
        "lpad(cast(id as string), 5, '0') as id", "case when id % 4 = 0 then 'cold' when id % 4 = 1 then null else 'hot' end as client",
        "timestamp_micros(1700000000000000 + id * 700000 + pmod(xxhash64(id), 600000) + if(id > 300, 300000000, 0)) as ts")
    rows = rows.union(rows.limit(1).selectExpr("'x' as id", "'hot' as client", "cast(null as timestamp) as ts"))
    # One record per Arrow batch boundary or many: the passes are carried from batch to batch.
    for records in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
        got = ratelimit.rate_limit(rows, "client", "ts", "id", limit=5).collect()
        assert len(got) == 401 and [r.admitted for r in got if r.ts_us is None] == [False]
        for client in ("hot", "cold", None):
            mine = sorted((r for r in got if r.client == client and r.ts_us is not None), key=lambda r: (r.ts_us, r.tie))
            assert mine and [r.admitted for r in mine] == _brute([r.ts_us for r in mine], 5, 60_000_000)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_mining_to_published_parser(spark):
    lines = spark.createDataFrame(
        [(t, T0 + datetime.timedelta(seconds=i)) for i, t in enumerate(L.UNKNOWN[:2])],
        "raw_payload string, ingest_ts timestamp")
    sessions = onboarding.onboarding_sessions(lines).cache()
    row = sessions.first()
    assert sessions.count() == 1 and row.status == "PENDING" and row.vendor == "Custom-Appliance"
    assert row.raw_sample_logs == L.UNKNOWN[:2]
    fields = {v.suggested_ocsf_field: v.inferred_type for v in row.variables}
    assert fields["src_ip"] == fields["dst_ip"] == "ipv4" and fields["action"] == "action"
    edited = onboarding.update_mapping(sessions, row.session_id, 0, "timestamp", "timestamp")
    assert edited.first().variables[0].confidence == 1.0
    entry, published, log = onboarding.publish(edited, onboarding.empty_catalogue(spark), row.session_id, "rev")
    assert published.first().status == "PUBLISHED" and log.first().action == "ONBOARDING_APPROVED_AND_PUBLISHED"
    with pytest.raises(ValueError):
        onboarding.publish(sessions, entry, row.session_id, "rev")
    definitions = onboarding.load_definitions(entry)
    judged = run(payload_frame(spark, L.UNKNOWN), definitions, position="i", document=False, enriched=False)
    found = {r.raw_payload: r for r in judged.collect()}
    assert all(r.error_stage is None for r in found.values())
    assert found[L.UNKNOWN[2]].disposition == "Allowed" and found[L.UNKNOWN[2]].src_ip == "8.8.8.8"
    assert found[L.UNKNOWN[0]].disposition == "Blocked" and found[L.UNKNOWN[0]].time_epoch == 1787825740000
    rejected, reason = onboarding.reject(sessions, row.session_id, "noise", "rev")
    assert rejected.first().status == "REJECTED" and "noise" in reason.first().details
    assert onboarding.list_parsers(entry).count() == 13
    assert onboarding.latest_parser(entry, definitions[0].parser_id).count() == 1
    sessions.unpersist()


def test_mining_covers_every_line(spark):
    lines = spark.range(600).selectExpr(
        "concat('svc', chr(97 + id % 3), ' user ', repeat(chr(97 + id % 26), 1 + id div 26), ' did ',"
        " chr(97 + id % 5), ' ok') as raw_payload", "timestamp_seconds(id) as ingest_ts")
    whole, all_lines = mining.mine_templates(lines)
    assert sum(r.size for r in whole.collect()) == 600 and all_lines.count() == lines.distinct().count()
    assert {r.template for r in whole.collect()} == {f"svc{c} user <*> did <*> ok" for c in "abc"}
    matched = mining.match_template(lines, whole).filter("template_id is not null")
    assert matched.count() == 600 and len(matched.first().parameters) == 2


def test_mining_ends_on_lines_that_never_merge(spark):
    word = "concat(chr(97 + {0} % 26), chr(97 + {0} div 26 % 26), chr(97 + {0} div 676 % 26))"
    lines = spark.range(3000).selectExpr(
        "concat_ws(' ', 'start', " + ", ".join(word.format(f"(id * 7 + {k} * 3001)") for k in range(4)) + ") as raw_payload",
        "timestamp_seconds(id) as ingest_ts")
    found, assigned = mining.mine_templates(lines)
    assert found.count() == 3000 and assigned.count() == 3000
    assert {r.size for r in found.collect()} == {1}


def _templates(spark, texts, **options):
    lines = spark.createDataFrame(
        [(t, T0 + datetime.timedelta(seconds=i)) for i, t in enumerate(texts)], "raw_payload string, ingest_ts timestamp")
    return {r.template: r.size for r in mining.mine_templates(lines, **options)[0].collect()}


def test_first_token_rules_of_the_tree(spark):
    # A first token with a digit opens the wildcard child; a new first token is looked for there.
    assert _templates(spark, ["k1x a b", "one a b", "one x y", "one x z", "three q r s"]) == {
        "<*> a b": 2, "one x <*>": 2, "three q r s": 1}
    # The third first token finds no room and shares the wildcard child with the fourth.
    assert _templates(spark, ["one p", "two p", "three p", "four p"], max_children=3) == {
        "one p": 1, "two p": 1, "<*> p": 2}
    assert _templates(spark, ["one p", "two p", "three p", "four p"]) == {
        "one p": 1, "two p": 1, "three p": 1, "four p": 1}


def test_delivery_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    events = spark.createDataFrame([(f"e{i}",) for i in range(4)], "event_id string")
    sent = []

    def broken(df):
        raise OSError("down")

    def works(df):
        sent.append(df.count())

    assert delivery.deliver_dual(events, works, broken, path) is False
    rows = spark.read.parquet(path)
    state = delivery.delivery_status(rows, "e1").first()
    assert (state.state, state.search_ack, state.lake_ack, state.attempt_count) == ("FAILED_RETRYABLE", True, False, 1)
    wait = (state.next_attempt_at - state.last_attempt).total_seconds()
    assert 2.0 <= wait < 2.5
    assert delivery.due_for_retry(rows, now="timestamp_micros(0)").count() == 0
    assert delivery.retry_pending(rows, events, broken, works, path, force=True) == 4
    assert sent == [4, 4]
    stats = {r.state: r.events for r in delivery.delivery_stats(spark.read.parquet(path)).collect()}
    assert stats == {"DELIVERY_COMPLETE": 4}


def test_fifth_failure_is_a_dead_letter(spark):
    rows = delivery.stage(spark.createDataFrame([("e",)], "event_id string"), "timestamp_micros(0)")
    for attempt in range(5):
        rows = delivery.attempt_rows(rows, "false", "false", "timestamp_micros(0)", "'x'")
        assert rows.first().state == ("DEAD_LETTER" if attempt == 4 else "FAILED_RETRYABLE")


def test_audit(spark, tmp_path):
    path = str(tmp_path / "audit")
    for i in range(3):
        audit.append_audit(audit.audit_rows(spark, [dict(user="u", action=f"A{i % 2}", details={"i": i})]), path)
    trail = spark.read.parquet(path)
    assert audit.list_audits(trail, user="u", action="A0").count() == 2
    assert audit.list_audits(trail, limit=2, offset=2).count() == 1


def test_geo_first_network_wins(spark):
    geo = spark.createDataFrame(
        [(0, "9.9.9.0/24", "A"), (1, "9.0.0.0/8", "B"), (2, "9.9.9.128/25", "C"), (3, "20.0.0.0/15", "D")],
        "position int, network string, country string").selectExpr(
        "*", "'' as country_code", "'' as city", "'' as as_name", "1 as as_num")
    ips = ["9.9.9.1", "9.9.9.200", "9.9.8.1", "9.255.255.255", "10.0.0.1", "20.1.255.255", "20.2.0.0", "bad", None]
    rows = spark.createDataFrame([(ip, ip) for ip in ips], "src_ip string, dst_ip string")
    found = {r.src_ip: r.src_location and r.src_location.country for r in enrich_geo(rows, geo).collect()}
    assert found == {
        "9.9.9.1": "A", "9.9.9.200": "A", "9.9.8.1": "B", "9.255.255.255": "B", "10.0.0.1": None,
        "20.1.255.255": "D", "20.2.0.0": None, "bad": None, None: None}
    spans = geo_intervals(geo).orderBy("low").collect()
    assert all(a.high < b.low for a, b in zip(spans, spans[1:]))


def test_value_functions(spark):
    ips = ["10.0.0.1", "8.8.8.8", "192.0.0.9", "172.31.255.255", "198.51.100.7", "255.255.255.255", "0.1.2.3", "100.64.0.1"]
    df = spark.createDataFrame([(ip,) for ip in ips], "ip string").selectExpr(
        "ip", f"{ipv4_to_long('ip')} as n").selectExpr("ip", "n", f"{is_private('n')} as p", f"{long_to_ipv4('n')} as back")
    for r in df.collect():
        assert r.n == int(ipaddress.ip_address(r.ip)) and r.back == r.ip
        assert r.p == ipaddress.ip_address(r.ip).is_private
    protocols = spark.createDataFrame([("6",), ("tcp ",), ("250",), ("weird",), (None,), ("",)], "p string").selectExpr(
        "p", f"{protocol_name('p')} as name", f"{protocol_number('p')} as number")
    assert {r.p: (r.name, r.number) for r in protocols.collect()} == {
        "6": ("TCP", 6), "tcp ": ("TCP", 6), "250": ("PROTO-250", 250), "weird": ("WEIRD", 6), None: ("TCP", 6),
        "": ("TCP", 6)}
    text = spark.createDataFrame([("a\r\nb\x00c ",), ("x" * 600,), (None,)], "t string").selectExpr(
        f"{sanitize_text('t')} as s")
    assert [r.s for r in text.collect()] == ["a  b c", "x" * 512 + "...", ""]


def test_positions_do_not_depend_on_splits_or_other_files(spark, tmp_path, monkeypatch):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "b.log").write_text("".join(f"line {i}\n" if i % 7 else "\n" for i in range(3000)))

    def positions():
        return {r.raw_payload: r.source_position.rsplit("/", 1)[1] for r in logs.read_log_lines(spark, str(folder)).collect()}

    first = positions()
    assert first["line 1"] == "b.log#1" and first["line 2999"] == "b.log#2999"
    monkeypatch.setattr(logs, "WHOLE_BYTES", 1000)  # now b.log is read by splits, and a.log below whole
    assert positions() == first
    (folder / "a.log").write_text("other\n" * 10)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert {k: v for k, v in positions().items() if k != "other"} == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_of_either_kind_and_repeated_keys(spark, tmp_path):
    (tmp_path / "array.json").write_text('[{"a": 1, "a": 2}, "plain"]')
    (tmp_path / "broken.json").write_text('[{"a": 1}\nsecond]')
    (tmp_path / "lines.log").write_text("one\ntwo\n")
    got = sorted(r.raw_payload for r in logs.read_log_files(spark, str(tmp_path)).collect())
    assert got == sorted(['{"a":2}', "plain", '[{"a": 1}', "second]", "one", "two"])
    line = '{"event_type":"alert","src_ip":"1.2.3.4","alert":{"action":"allowed","action":"blocked"},"src_ip":"9.9.9.9"}'
    row = run(payload_frame(spark, [line]), position="i", document=False, enriched=False).first()
    assert (row.detected_format, row.disposition, row.src_ip) == ("json", "Blocked", "9.9.9.9")


def test_percentiles_of_a_null_group(spark):
    rows = spark.range(100).selectExpr("if(id < 50, null, 'g') as g", "cast(id as double) as v")
    got = {r.g: (r.events, r.p50) for r in metrics.latency_percentiles(rows, "v", ["g"]).collect()}
    assert got == {None: (50, 25.0), "g": (50, 75.0)}
