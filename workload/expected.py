"""What the corpora must parse to, stated in SQL over the events table for the oracle engine.

Nothing here reads log text: every expected field is arithmetic on the event's own columns.
"""

from __future__ import annotations

from workload.corpus import facts_sql


def _by_kind(default: str, **arms: str) -> str:
    return "case kind " + " ".join(f"when '{k}' then {v}" for k, v in arms.items()) + f" else {default} end"


_MS = "cast(floor(cast(epoch_us(ts) as double) / 1e6 * 1e3) as bigint)"
_TEXT_MS = "cast(floor(cast(epoch_us(ts) // 1000 * 1000 as double) / 1e6 * 1e3) as bigint)"
_SECOND_MS = "cast(floor(cast(epoch_us(ts) // 1000000 * 1000000 as double) / 1e6 * 1e3) as bigint)"
_NUMBER_MS = "cast(trunc(cast(epoch_us(ts) as double) / 1e6 * 1000) as bigint)"
_UNPARSED = ("blank", "short_cef", "unknown")


def _unless(kinds, value: str) -> str:
    return f"case when kind in ({', '.join(repr(k) for k in kinds)}) then null else {value} end"


_COLUMNS = {
    "line_id": "event_id",
    "kind": "kind",
    "detected_format": _by_kind(
        "'syslog_rfc3164'", blank="'unknown'", short_cef="'cef'", panos="'cef'", suricata="'json'", zeek="'json'",
        squid="'proprietary'", rfc5424="'syslog_rfc5424'", unknown="'proprietary'"),
    "vendor": _by_kind(
        "'Checkpoint'", blank="'unknown'", big_port="'Fortinet'", fortinet="'Fortinet'", short_cef="'Acme'",
        asa_built="'Cisco'", asa_deny="'Cisco'", panos="'Palo Alto Networks'", suricata="'Suricata'", zeek="'Zeek'",
        squid="'Squid'", rfc5424="'Generic-Syslog'", unknown="'Unknown-Vendor'"),
    "product": _by_kind(
        "'Firewall-1'", blank="'unknown'", big_port="'FortiOS'", fortinet="'FortiOS'", short_cef="'Gate'",
        asa_built="'ASA'", asa_deny="'ASA'", panos="'PAN-OS'", suricata="'EVE-IDS'", zeek="'Network-Monitor'",
        squid="'Proxy'", rfc5424="concat('app', event_id % 3)", unknown="'Proprietary-Appliance'"),
    "parser_used": _by_kind(
        "'checkpoint-fw1-parser'", blank="'drain3-onboarding-queue'", unknown="'drain3-onboarding-queue'",
        big_port="'fortinet-fortios-parser'", fortinet="'fortinet-fortios-parser'", short_cef="'cef-standard-parser'",
        asa_built="'cisco-asa-firewall-parser'", asa_deny="'cisco-asa-firewall-parser'",
        panos="'palo-alto-panos-parser'", suricata="'suricata-eve-json-parser'", zeek="'zeek-conn-parser'",
        squid="'squid-proxy-parser'", rfc5424="'syslog-rfc5424-generic'"),
    "error_stage": _by_kind("null", blank="'INGESTION'", unknown="'UNKNOWN_FORMAT'", bad_ip="'OCSF_VALIDATION'"),
    "class_uid": _by_kind("4001", suricata="2001"),
    "severity_id": _by_kind(
        "1", big_port="2", bad_ip="case when blocked then 3 else 1 end", asa_deny="3", panos="2",
        fortinet="case when blocked then 3 else 1 end", suricata="4 - cast(event_id % 4 as int)",
        zeek="case when blocked then 2 else 1 end", checkpoint="case when blocked then 3 else 1 end",
        squid="case when blocked then 3 else 1 end", rfc5424="case when blocked then 4 else 1 end"),
    "disposition_id": _by_kind(
        "case when blocked then 2 else 1 end", blank="1", short_cef="1", asa_built="1", asa_deny="2", rfc5424="1",
        unknown="1"),
    "action": _by_kind(
        "null", blank="'allow'", short_cef="'allow'", unknown="'allow'",
        big_port="case when blocked then 'deny' else 'accept' end",
        fortinet="case when blocked then 'deny' else 'accept' end",
        bad_ip="case when blocked then 'drop' else 'accept' end",
        checkpoint="case when blocked then 'drop' else 'accept' end",
        asa_built="'allow'", asa_deny="'deny'", panos="case when blocked then 'deny' else 'allow' end",
        zeek="case when blocked then 'reject' else 'allow' end", squid="case when blocked then 'deny' else 'allow' end",
        rfc5424="'allow'"),
    "src_ip": _unless(_UNPARSED, "case when kind = 'bad_ip' then '10.0.1' else src_ip end"),
    "src_port": _unless((*_UNPARSED, "big_port", "squid", "rfc5424"), "src_port"),
    "dst_ip": _unless(_UNPARSED, "dst_ip"),
    "dst_port": _unless((*_UNPARSED, "rfc5424"), "dst_port"),
    "protocol_name": _by_kind("'TCP'", fortinet="'UDP'", suricata="null"),
    "bytes_in": _by_kind(
        "null", big_port="bytes_in", panos="bytes_in", fortinet="bytes_in", zeek="nullif(bytes_in, 0)"),
    "bytes_out": _by_kind(
        "null", big_port="bytes_out", panos="bytes_out", fortinet="bytes_out", zeek="nullif(bytes_out, 0)",
        squid="bytes_out"),
    "app_name": _by_kind(
        "null", panos="'web-browsing'", fortinet="'DNS'", zeek="'http'", squid="'HTTP'",
        rfc5424="concat('app', event_id % 3)", checkpoint="cast(dst_port as varchar)",
        bad_ip="cast(dst_port as varchar)"),
    "rule_name": _by_kind(
        "null", big_port="'Policy-7'", bad_ip="'R1'", asa_deny="concat('ACL_', event_id % 7)",
        panos="concat('RULE_', event_id % 5)", fortinet="concat('Policy-', event_id % 9)",
        checkpoint="concat('RULE_', event_id % 6)"),
    "line_hostname": _by_kind("null", squid="concat('host-', event_id % 50, '.example.org')"),
    "line_zone": _by_kind("null", asa_built="'inside'", asa_deny="'outside'"),
    "time_epoch": _by_kind(_MS, zeek=_NUMBER_MS, rfc5424=_TEXT_MS),
    "finding_title": _by_kind("null", suricata="concat('ET TEST ', event_id % 13)"),
    "finding_uid": _by_kind("null", suricata="cast(event_id % 1000 as varchar)"),
    "blocked": "blocked",
    "event_type": "event_type",
    "user_id": "user_id",
    "ts": "ts",
    "raw_src_ip": "src_ip",
    "raw_src_port": "src_port",
    "raw_dst_ip": "dst_ip",
    "raw_dst_port": "dst_port",
    "raw_bytes_in": "bytes_in",
}

_COLUMNS2 = {
    "line_id": "event_id",
    "kind2": "kind2",
    "detected_format": "case kind2 when 'leef' then 'leef' when 'rfc3164' then 'syslog_rfc3164' else 'json' end",
    "parser_used": "case kind2 when 'leef' then 'leef-standard-parser' when 'rfc3164' then 'syslog-rfc3164-generic'"
                   " else 'json-generic-parser' end",
    "severity_id": "case kind2 when 'leef' then case when event_id % 10 >= 8 then 4 when event_id % 10 >= 5 then 3"
                   " when event_id % 10 >= 3 then 2 else 1 end"
                   " when 'rfc3164' then case when blocked then 3 else 1 end else cast(event_id % 7 as int) end",
    "disposition_id": "case when blocked then 2 else 1 end",
    "action": "case kind2 when 'leef' then case when blocked then 'deny' else 'permit' end"
              " when 'rfc3164' then case when blocked then 'deny' else 'allow' end"
              " else case when blocked then 'block' else 'allow' end end",
    "src_ip": "src_ip",
    "src_port": "case when kind2 = 'rfc3164' then null else src_port end",
    "dst_ip": "dst_ip",
    "dst_port": "case when kind2 = 'rfc3164' then null else dst_port end",
    "protocol_name": "case when kind2 = 'rfc3164' then 'TCP' else 'UDP' end",
    "bytes_in": "case when kind2 = 'json' then bytes_in end",
    "bytes_total": "case when kind2 = 'leef' then bytes_in end",
    "app_name": "case when kind2 = 'rfc3164' then 'daemon' end",
    "rule_name": "case when kind2 = 'leef' then concat('Policy-', event_id % 8) end",
    "time_epoch": f"case kind2 when 'leef' then {_MS} when 'rfc3164' then {_SECOND_MS} else epoch_us(ts) // 1000 end",
    "meta_vendor": "case kind2 when 'rfc3164' then 'Generic-Syslog' else 'Acme' end",
}


def _expected(columns: dict[str, str]) -> str:
    listed = ", ".join(f"{x} as {name}" for name, x in columns.items())
    return (
        f"with f as (select event_id, user_id, event_type, value, ts, {facts_sql()} from events),"
        f" e as (select {listed} from f)")


def first(query: str) -> str:
    """A query over ``e``, the expected rows of the mixed corpus."""
    return f"{_expected(_COLUMNS)} {query}"


def second(query: str) -> str:
    """A query over ``e``, the expected rows of the LEEF / RFC 3164 / JSON corpus."""
    return f"{_expected(_COLUMNS2)} {query}"
