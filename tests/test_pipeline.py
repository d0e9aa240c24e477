import hashlib

import pytest

from palisade.operators.envelope import nest_envelope
from palisade.operators.parse import parse_with
from palisade.operators.validate import split_valid
from palisade.plans.ingest import run
from tests import lines as L
from tests.conftest import payload_frame


@pytest.fixture(scope="module")
def rows(spark):
    judged = run(payload_frame(spark, L.ALL), position="i")
    return {r.raw_payload: r for r in judged.collect()}


# line -> expected values
CASES = {
    L.ASA_BUILT: dict(
        src_ip="198.51.100.25", src_port=443, dst_ip="10.0.0.5", dst_port=54321, protocol_name="TCP", action="allow",
        disposition="Allowed", severity_id=1, src_zone="outside", vendor="Cisco", confidence=1.0),
    L.ASA_DENY: dict(disposition="Blocked", severity_id=3, rule_name="OUTSIDE_BLOCK", src_zone="dmz"),
    L.ASA_TEARDOWN: dict(bytes_total=48123, action="close", disposition="Allowed"),
    L.ASA_DENIED: dict(
        severity_id=4, disposition_id=2, protocol_name="UDP", src_ip="8.8.8.8", dst_port=99, src_zone="outside",
        product="ASA"),
    L.ASA_NAT: dict(src_ip="10.0.0.9", dst_ip="8.8.4.4", disposition_id=1, dst_port=2048),
    L.ASA_LOOSE: dict(src_ip="1.2.3.4", dst_ip="5.6.7.8", action="deny", disposition_id=2, severity_id=1),
    L.PANOS_ALLOW: dict(bytes_in=1420, bytes_out=5820, disposition="Allowed", rule_name="RULE_WEB_PERMIT", bytes_total=7240),
    L.PANOS_THREAT: dict(disposition="Blocked", severity_id=4),
    L.PANOS_CSV: dict(
        parser_used="palo-alto-panos-parser", src_ip="10.1.1.1", src_port=1111, dst_port=2222, protocol_name="UDP",
        protocol_num=17, disposition_id=2, rule_name="rule-x", message="PAN-OS TRAFFIC drop 10.1.1.1->10.2.2.2"),
    L.FORTI_KV: dict(protocol_name="TCP", disposition="Allowed", bytes_out=512, bytes_in=1024, severity_id=3, rule_uid="1"),
    L.FORTI_LEEF: dict(disposition="Blocked", meta_product="FortiOS", src_port=44123, severity_id=3),
    L.CHECKPOINT: dict(dst_port=23, disposition="Blocked", rule_name="DROP_TELNET", src_port=55123),
    L.SQUID_DENIED: dict(
        disposition="Blocked", dst_hostname="malicious-domain.xyz", dst_port=80, bytes_out=1420,
        message="Squid GET http://malicious-domain.xyz/payload.exe -> 403 (TCP_DENIED)"),
    L.SQUID_MISS: dict(dst_ip="198.51.100.25", disposition="Allowed"),
    L.ZEEK: dict(app_name="postgresql", disposition="Allowed", time_epoch=1693131334500, bytes_in=4096),
    L.SURICATA_ALERT: dict(
        class_uid=2001, disposition="Blocked", severity_id=4, finding_uid="2001219", time_epoch=1787825733123,
        action=None, protocol_name=None),
    L.SURICATA_HTTP: dict(class_uid=4001, dst_hostname="internal.example.org", bytes_in=10, packets_out=2, bytes_total=30),
    L.RFC5424: dict(
        src_hostname="edge-firewall", app_name="Router", time_epoch=1787825730123, src_ip="192.168.1.10", severity_id=1,
        detected_format="syslog_rfc5424", time_dt="2026-08-27T10:15:30.123000+00:00"),
    L.RFC3164: dict(action="deny", severity_id=3, src_ip="8.8.8.8", dst_ip="10.0.0.1", meta_product="sshd"),
    L.GENERIC_JSON: dict(
        src_ip="8.8.8.1", severity_id=4, disposition_id=2, status_id=2, time_epoch=1787825730000, meta_vendor="Acme"),
    L.CEF_ESCAPED: dict(meta_vendor="a|b", meta_product="pro\\d", severity_id=5, src_port=99, src_hostname="h"),
    L.LEEF_CARET: dict(severity_id=4, bytes_total=77, action="allowed", disposition_id=1),
    L.LEEF_HEX: dict(severity_id=3, src_ip="1.1.1.1", dst_ip="2.2.2.2"),
    L.LEEF_LOOSE: dict(src_ip="1.1.1.1", dst_ip="2.2.2.2", severity_id=1),
    L.UNKNOWN[0]: dict(error_stage="UNKNOWN_FORMAT", parser_used="drain3-onboarding-queue", vendor="Unknown-Vendor"),
    "   ": dict(error_stage="INGESTION"),
    "CEF:0|a|b": dict(error_stage=None, confidence=0.5, action="allow", message="a b network event"),
    "CheckPoint: src=10.0.1; dst=10.0.0.1; action=accept": dict(error_stage="OCSF_VALIDATION"),
    '{"a":1}{"b":2}': dict(detected_format="unknown", parser_used="json-generic-parser", confidence=0.5),
    "[1,2,3]": dict(error_stage="UNKNOWN_FORMAT"),
    "LEEF:1.0|a|b": dict(confidence=0.5),
}


@pytest.mark.parametrize("line", list(CASES), ids=range(len(CASES)))
def test_line(rows, line):
    got = rows[line].asDict()
    assert {k: got[k] for k in CASES[line]} == CASES[line]


def test_nothing_lost_and_payload_untouched(rows):
    assert set(rows) == set(L.ALL)
    for line, row in rows.items():
        assert row.raw_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert row.byte_length == len(line.encode())


def test_unmapped_keeps_vendor_fields(rows):
    assert rows[L.FORTI_KV].unmapped["devname"] == "FGT-60D"
    assert rows[L.GENERIC_JSON].unmapped["nested"] == '{"a":1}'
    assert rows[L.ASA_TEARDOWN].unmapped["duration"] == "0:02:15"
    assert rows[L.CEF_ESCAPED].unmapped["msg"] == "a=b c"
    assert rows[L.LEEF_LOOSE].unmapped["msg"] == "two words"
    assert "src_ip" not in rows[L.FORTI_KV].unmapped


def test_enrichment(rows):
    assert rows[L.ASA_BUILT].dst_asset_info.criticality == "Critical"
    assert rows[L.ASA_BUILT].dst_zone == "inside"
    assert rows[L.SURICATA_ALERT].src_location.country_code == "NL"
    assert rows[L.SURICATA_ALERT].ocsf.src_endpoint.autonomous_system.number == 60729
    assert rows[L.ASA_DENY].dst_location is None


def test_document_and_provenance(rows):
    row = rows[L.SURICATA_ALERT]
    assert row.ocsf.finding_info.title == "ET SCAN SSH"
    assert row.ocsf.connection_info is None and row.ocsf.rule is None
    assert row.provenance_chain[2] == "PARSED:suricata-eve-json-parser:1.0.0"
    assert rows["   "].provenance_chain == ["INGESTION_RECEIVED"]


def test_ids_are_replay_stable(spark, rows):
    again = run(payload_frame(spark, L.ALL), position="i", document=False, enriched=False)
    assert {r.event_id for r in again.select("event_id").collect()} == {r.event_id for r in rows.values()}
    good, dead = split_valid(again)
    assert good.count() + dead.count() == len(L.ALL)


def test_parse_failures_can_be_dead_letters(spark):
    judged = run(payload_frame(spark, ["CEF:0|a|b"]), position="i", on_parse_error="dead_letter", document=False)
    assert judged.first().error_stage == "PARSER"


def test_dry_run(spark):
    good, bad = parse_with(payload_frame(spark, [L.ASA_DENY, "no code"]), "cisco-asa-firewall-parser").orderBy("i").collect()
    assert good.success and good.parsed_fields.src_ip == "192.168.1.50"
    assert not bad.success and "No Cisco ASA/FTD message code found" in bad.parse_errors[0]


def test_duplicate_pairs_last_wins(spark):
    line = 'devname="A" srcip=1.1.1.1 srcip=2.2.2.2 action=deny'
    assert run(payload_frame(spark, [line]), position="i", document=False).first().src_ip == "2.2.2.2"


def test_nested_envelope(spark):
    row = nest_envelope(run(payload_frame(spark, [L.ZEEK]), position="i")).first()
    assert row.source.vendor == "Zeek" and row.raw.sha256 == row.traceability.raw_sha256
    assert row.raw.object_key.endswith(f"/source=unknown/{row.event_id}.raw")


def test_hints_win_over_detection(spark):
    df = payload_frame(spark, [L.ZEEK]).selectExpr("*", "'Mine' as vendor_hint")
    row = run(df, position="i", document=False).first()
    assert row.vendor == "Mine" and row["product"] == "Network-Monitor"


def test_fuzzed_prefixes(spark):
    hypothesis = pytest.importorskip("hypothesis")
    from hypothesis import strategies as st

    prefixes = ["<166>", "%ASA-6-", "CEF:0|", "LEEF:2.0|", '{"event_type":', "CheckPoint ", "date=", "169.1 ", "<134>1 "]

    @hypothesis.settings(max_examples=2, deadline=None)
    @hypothesis.given(st.lists(st.text(max_size=60), min_size=20, max_size=20))
    def every_line_ends_somewhere(tails):
        text = [prefixes[i % len(prefixes)] + t.encode("utf-8", "ignore").decode() for i, t in enumerate(tails)]
        judged = run(payload_frame(spark, text), position="i", document=False).collect()
        assert sorted(r.raw_payload for r in judged) == sorted(text)
        assert all(r.error_stage or r.class_uid for r in judged)

    every_line_ends_somewhere()


def test_plan_is_one_narrow_pass(spark, tmp_path):
    path = str(tmp_path / "lines")
    payload_frame(spark, L.ALL).write.parquet(path)
    plan = run(spark.read.parquet(path), position="i")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert plan.count("FileScan") == 1 and "BatchEvalPython" not in plan and "NestedLoop" not in plan


def test_filters_do_not_copy_parser_expressions(spark):
    from palisade import fixed_values as fx

    judged = run(payload_frame(spark, L.ALL), position="i").filter("src_ip = '8.8.8.8' and error_stage is null")
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    # One copy of the captures expression: the match test, the replacement, and one extract for
    # each of the nine groups in the branch for text that holds the separator.
    assert plan.count(fx.ASA_BUILT) == 2 + 9


def test_search_filters_reach_the_scan(spark, tmp_path):
    from palisade.operators.search import matching

    path = str(tmp_path / "silver")
    run(payload_frame(spark, L.ALL), position="i").write.parquet(path)
    found = matching(spark.read.parquet(path), vendor="Cisco", severity_id=3).select("event_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(vendor,Cisco)" in plan and "EqualTo(severity_id,3)" in plan and "raw_payload" not in plan
    assert found.count() == 1


def test_cef_values_are_split_once_and_headers_captured_once():
    from palisade.operators.parsers import cef

    assert cef._extension_values().count("split(") == 2  # one for each way, with and without escapes
    assert cef._header_parts().count("regexp_replace(p, ") == 1
