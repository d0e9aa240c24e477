"""Log corpora rendered from the ``events`` table.

Every event becomes one line in a vendor's format; the fields come from the event's own
columns by plain arithmetic, so an oracle can state the expected parse from those columns
without reading text. ``FACTS`` holds that arithmetic once, in SQL both engines run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisade.functions.text import apart, lit
from palisade.functions.values import plain_utc, utc_timestamp

ASSET_IPS = [
    "10.0.0.1", "10.0.0.5", "10.0.0.10", "10.0.1.50", "192.168.1.1", "192.168.1.100", "192.168.1.105", "172.16.0.1",
]
PORTS = [22, 80, 443, 5432, 8080]


def _pick(expr: str, values: list) -> str:
    arms = " ".join(f"when {i} then {v!r}" for i, v in enumerate(values))
    return f"case {expr} {arms} end"


# Column name -> SQL over events(event_id, ts, user_id, event_type, value); valid in Spark and DuckDB.
FACTS = {
    "kind": """case when event_id % 101 = 0 then 'blank' when event_id % 103 = 0 then 'big_port'
        when event_id % 107 = 0 then 'short_cef' when event_id % 109 = 0 then 'bad_ip'
        else """ + _pick("event_id % 10", [
            "asa_built", "asa_deny", "panos", "fortinet", "suricata", "zeek", "checkpoint", "squid",
            "rfc5424", "unknown"]) + " end",
    "kind2": _pick("event_id % 3", ["leef", "rfc3164", "json"]),
    "src_ip": "concat(" + _pick("user_id % 4", ["10.0.1.", "8.8.8.", "185.220.101.", "203.0.113."])
              + ", cast(1 + user_id % 200 as varchar(10)))",
    "dst_ip": _pick("event_id % 8", ASSET_IPS),
    "src_port": "cast(1024 + event_id % 60000 as int)",
    "dst_port": "cast(" + _pick("event_id % 5", PORTS) + " as int)",
    "blocked": "event_type = 'error'",
    "bytes_in": "cast(floor(value * 100) as bigint)",
    "bytes_out": "cast(floor(value * 100) as bigint) % 977",
}


def facts_sql() -> str:
    """The facts as a SELECT list."""
    return ", ".join(f"{sql} as {name}" for name, sql in FACTS.items())


def facts(events: DataFrame) -> DataFrame:
    """Events with their facts; ``ts`` becomes a UTC timestamp."""
    stated = [f"{sql} as {name}" for name, sql in FACTS.items()]
    return events.selectExpr(
        "event_id", "user_id", "event_type", "value", f"{utc_timestamp('ts')} as ts", *stated)


def _join(*parts: str) -> str:
    """Concatenation: '=x' is SQL, anything else literal text."""
    return "concat(" + ", ".join(p[1:] if p.startswith("=") else lit(p) for p in parts) + ")"


def _time(style: str) -> str:
    return f"=date_format({plain_utc('ts')}, {lit(style)})"


def _word(no: str, yes: str) -> str:
    return f"=if(blocked, {lit(no)}, {lit(yes)})"


_CLOCK = _time("MMM dd HH:mm:ss")
_DATE, _HOUR = _time("yyyy-MM-dd"), _time("HH:mm:ss")
LINES = {
    "blank": _join("   "),
    "big_port": _join(
        "date=", _DATE, " time=", _HOUR, ' devname="FGT-1" level="notice" srcip=', "=src_ip",
        " srcport=70000 dstip=", "=dst_ip", " dstport=", "=dst_port", ' proto=6 action="', _word("deny", "accept"),
        '" policyid=7 sentbyte=', "=bytes_out", " rcvdbyte=", "=bytes_in"),
    "short_cef": _join("CEF:0|Acme|Gate|", "=event_id"),
    "bad_ip": _join(
        "<134>", _CLOCK, " chkp CheckPoint: action=", _word("drop", "accept"), "; src=10.0.1; dst=", "=dst_ip",
        "; proto=tcp; s_port=", "=src_port", "; service=", "=dst_port", "; rule_name=R1;"),
    "asa_built": _join(
        "<166>", _CLOCK, " fw-1 %ASA-6-302013: Built inbound TCP connection ", "=event_id", " for outside:", "=src_ip",
        "/", "=src_port", " (", "=src_ip", "/", "=src_port", ") to inside:", "=dst_ip", "/", "=dst_port", " (",
        "=dst_ip", "/", "=dst_port", ")"),
    "asa_deny": _join(
        "<164>", _CLOCK, " fw-1 %ASA-4-106023: Deny tcp src dmz:", "=src_ip", "/", "=src_port", " dst outside:",
        "=dst_ip", "/", "=dst_port", ' by access-group "ACL_', "=event_id % 7", '" [0x0, 0x0]'),
    "panos": _join(
        "CEF:0|Palo Alto Networks|PAN-OS|10.1.0|TRAFFIC|end|3|src=", "=src_ip", " dst=", "=dst_ip", " spt=",
        "=src_port", " dpt=", "=dst_port", " proto=TCP act=", _word("deny", "allow"), " in=", "=bytes_in", " out=",
        "=bytes_out", " app=web-browsing cs1=RULE_", "=event_id % 5"),
    "fortinet": _join(
        "date=", _DATE, " time=", _HOUR, ' devname="FGT-60D" type="traffic" srcip=', "=src_ip", " srcport=",
        "=src_port", " dstip=", "=dst_ip", " dstport=", "=dst_port", ' proto=17 action="', _word("deny", "accept"),
        '" policyid=', "=event_id % 9", ' service="DNS" sentbyte=', "=bytes_out", " rcvdbyte=", "=bytes_in"),
    "suricata": _join(
        '{"timestamp":"', _time("yyyy-MM-dd\'T\'HH:mm:ss.SSSSSS"), '+0000","flow_id":', "=event_id",
        ',"event_type":"alert","src_ip":"', "=src_ip", '","src_port":', "=src_port", ',"dest_ip":"', "=dst_ip",
        '","dest_port":', "=dst_port", ',"proto":"UDP","alert":{"action":"', _word("blocked", "allowed"),
        '","signature_id":', "=event_id % 1000", ',"signature":"ET TEST ', "=event_id % 13",
        '","category":"Misc","severity":', "=event_id % 4 + 1", "}}"),
    "zeek": _join(
        '{"ts":', "=unix_seconds(ts)", ".", "=lpad(unix_micros(ts) % 1000000, 6, '0')", ',"uid":"C', "=event_id",
        '","id.orig_h":"', "=src_ip", '","id.orig_p":', "=src_port", ',"id.resp_h":"', "=dst_ip", '","id.resp_p":',
        "=dst_port", ',"proto":"tcp","service":"http","orig_bytes":', "=bytes_out", ',"resp_bytes":', "=bytes_in",
        ',"conn_state":"', _word("REJ", "SF"), '"}'),
    "checkpoint": _join(
        "<134>", _CLOCK, " chkp CheckPoint: action=", _word("drop", "accept"), "; src=", "=src_ip", "; dst=",
        "=dst_ip", "; proto=tcp; s_port=", "=src_port", "; service=", "=dst_port", "; rule_name=RULE_",
        "=event_id % 6", ";"),
    "squid": _join(
        "=unix_seconds(ts)", ".", "=lpad(unix_millis(ts) % 1000, 3, '0')", "     ", "=event_id % 500", " ", "=src_ip",
        " ", _word("TCP_DENIED/403", "TCP_MISS/200"), " ", "=bytes_out", " GET http://host-", "=event_id % 50",
        ".example.org:", "=dst_port", "/path - DIRECT/", "=dst_ip", " text/html"),
    "rfc5424": _join(
        "<", "=if(blocked, 131, 134)", ">1 ", _time("yyyy-MM-dd\'T\'HH:mm:ss.SSS"), "Z gw-1 app", "=event_id % 3",
        " 77 ID1 - conn from ", "=src_ip", " to ", "=dst_ip", " done"),
    "unknown": _join(
        "[APPLIANCE-FW] ", _time("yyyy-MM-dd\'T\'HH:mm:ss"), "Z DEV=EDGE-FW-", "=event_id % 20",
        " RULE=BLOCK_SSH SRC=", "=src_ip", ":", "=src_port", " DST=", "=dst_ip", ":", "=dst_port",
        " PROTO=TCP ACTION=", _word("DENY", "ALLOW"), " BYTES=", "=bytes_in", ' REASON="', "=event_type", '"'),
    "cef": _join(
        "CEF:0|Acme|Gate\\|Way|2.1|", "=event_id % 9", "|Seen \\| passed ", "=event_id", "|", "=event_id % 11", "|src=", "=src_ip", " dst=",
        "=dst_ip", " spt=", "=src_port", " dpt=", "=dst_port", " proto=UDP act=", _word("block", "allow"), " in=", "=bytes_in", " out=",
        "=bytes_out", " app=two words shost=host ", "=event_id % 4", " smac=00:11:22:33:44:0", "=event_id % 10", " cs1=rule\\=",
        "=event_id % 6"),
    "leef": _join(
        "LEEF:2.0|Acme|Gate|1.0|EV", "=event_id % 4", "|^|src=", "=src_ip", "^dst=", "=dst_ip", "^srcPort=",
        "=src_port", "^dstPort=", "=dst_port", "^proto=UDP^action=", _word("deny", "permit"), "^usrName=u",
        "=user_id", "^policyid=", "=event_id % 8", "^totalBytes=", "=bytes_in", "^sev=", "=event_id % 10"),
    "rfc3164": _join(
        "<", "=if(blocked, 132, 134)", ">", _CLOCK, " host-", "=event_id % 4", " daemon: session ",
        _word("dropped", "opened"), " from ", "=src_ip", " to ", "=dst_ip"),
    "json": _join(
        '{"vendor":"Acme","product":"Edge","message":"m', "=event_id", '","source_ip":"', "=src_ip",
        '","destination_ip":"', "=dst_ip", '","source_port":', "=src_port", ',"destination_port":', "=dst_port",
        ',"proto":"udp","action":"', _word("block", "allow"), '","bytes_in":', "=bytes_in", ',"severity_id":',
        "=event_id % 7", ',"timestamp":', "=unix_millis(ts)", "}"),
}


def _render(events: DataFrame, kind: str, kinds: list[str]) -> DataFrame:
    arms = " ".join(f"when '{name}' then {LINES[name]}" for name in kinds)
    return facts(events).selectExpr(apart("event_id"), f"case {kind} {arms} end as raw_payload", "ts as ingest_ts")


FIRST_KINDS = [
    "blank", "big_port", "short_cef", "bad_ip", "asa_built", "asa_deny", "panos", "fortinet", "suricata", "zeek",
    "checkpoint", "squid", "rfc5424", "unknown",
]
SECOND_KINDS = ["leef", "rfc3164", "json"]
THIRD_KINDS = ["cef"]


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """Rows over all cores: a small table is one file, hence one scan task."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, raw_payload, ingest_ts: the mixed vendor corpus with noise lines."""
    return _render(_spread(events_table(spark, sf_dir)), "kind", FIRST_KINDS)


def third_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, raw_payload, ingest_ts: generic CEF with escapes, spaces in values and every severity."""
    return _render(_spread(events_table(spark, sf_dir)), "'cef'", THIRD_KINDS)


#: Appliances that no parser knows: word, verb and last words of each one's lines.
APPLIANCES = [
    (f"unit{chr(97 + k)}", ("opened", "closed", "moved", "locked")[k % 4], ("by policy", "after a long wait", "now", "without any reason given here")[k // 6])
    for k in range(24)
]


def appliance_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, appliance, raw_payload, ingest_ts: a third of the lines are the first appliance's. Letters spell the event's number."""
    letters = "translate(cast({} as string), '0123456789', 'abcdefghij')"
    arms = " ".join(
        f"when {k} then concat('{word}: gate ', event_id % 50, ' {verb} for ', {letters.format('event_id')}, ' from ', src_ip, ' {rest}')"
        for k, (word, verb, rest) in enumerate(APPLIANCES))
    events = facts(_spread(events_table(spark, sf_dir))).selectExpr(
        "*", f"cast(if(event_id % 3 = 0, 0, event_id % {len(APPLIANCES) - 1} + 1) as int) as appliance")
    return events.selectExpr("event_id", "appliance", f"case appliance {arms} end as raw_payload", "ts as ingest_ts")


#: Members of the edge lines: name and SQL over the facts that both engines run. A null member is left out.
EDGE = {
    "vendor": "'Acme'", "product": "'Edge'", "source_ip": "dst_ip", "destination_ip": "src_ip", "source_port": "src_port",
    "destination_port": "dst_port", "proto": "'udp'", "action": "'allow'",
    "status": _pick("event_id % 5", ["failed login", "ok", "DENY by rule", "no ERROR", "fine"]),
    "direction": "case event_id % 4 when 0 then 'inbound' when 1 then 'Outbound' when 2 then 'lateral' end",
    "packets_in": "event_id % 13", "packets_out": "event_id % 17", "bytes_in": "bytes_in", "bytes_out": "bytes_out",
    "note": "concat('n', event_id)", "queue": "event_id % 3",
}


def edge_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, raw_payload, ingest_ts: JSON lines from known hosts to public addresses, of every status and direction."""
    members = ", ".join(f"'{name}', {sql}" for name, sql in EDGE.items())
    return facts(_spread(events_table(spark, sf_dir))).selectExpr(
        "event_id", f"to_json(named_struct({members}, 'timestamp', unix_millis(ts))) as raw_payload", "ts as ingest_ts")


def second_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, raw_payload, ingest_ts: LEEF, RFC 3164 and generic JSON lines."""
    return _render(_spread(events_table(spark, sf_dir)), "kind2", SECOND_KINDS)
