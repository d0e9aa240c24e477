"""Oracle SQL per registered query, for DuckDB over the same tables."""

from __future__ import annotations

from palisade import fixed_values as fx
from palisade.functions.values import network_bounds
from workload.corpus import APPLIANCES, EDGE, facts_sql
from workload.expected import first, second
from workload.queries import PARSED, PARSED2, PARSERS, PARSERS2, PHRASE, TERMS

GOOD = "error_stage is null"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _names(table: dict, column: str) -> str:
    return f"case {column} " + " ".join(f"when {k} then {_q(v)}" for k, v in table.items()) + " end"


def _sanitized(column: str, length: int) -> str:
    space = r"[\s\x{0b}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    clean = (
        f"regexp_replace(regexp_replace(regexp_replace(coalesce({column}, ''), '[\\x00-\\x1f\\x7f-\\x{{9f}}]', ' ', 'g'),"
        f" '^{space}', ''), '{space}$', '')")
    return f"case when length({clean}) > {length} then concat(left({clean}, {length}), '...') else {clean} end"


def _masked(column: str) -> str:
    out = f"trim({column})"
    for name, pattern in fx.LINE_MASKS:
        out = f"regexp_replace({out}, {_q(pattern)}, '<{name}>', 'g')"
    return out


def _uuid(position: str, payload: str) -> str:
    h = f"sha256(concat(cast({position} as varchar), chr(1), {payload}))"
    return (
        f"concat(substring({h}, 1, 8), '-', substring({h}, 9, 4), '-8', substring({h}, 13, 3), '-a',"
        f" substring({h}, 16, 3), '-', substring({h}, 19, 12))")


def _uuid_of(text: str) -> str:
    h = f"sha256({text})"
    return (f"concat(substring({h}, 1, 8), '-', substring({h}, 9, 4), '-8', substring({h}, 13, 3), '-a', substring({h}, 16, 3), '-',"
            f" substring({h}, 19, 12))")


def _percentile(column: str, q: float) -> str:
    return f"list_sort(list({column}))[cast(floor(count(*) * {q}) as bigint) + 1]"


def _number(ip: str) -> str:
    return " + ".join(f"cast(split_part({ip}, '.', {i + 1}) as bigint) * {256 ** (3 - i)}" for i in range(4))


def _private(ip: str) -> str:
    spans = " or ".join(f"n between {a} and {b}" for a, b in map(network_bounds, fx.PRIVATE_NETWORKS))
    return f"(select ({spans}) from (select {_number(ip)} as n))"


_ASSET = {name: f"(case dst_ip " + " ".join(f"when '{a[0]}' then {_q(a[i])}" for a in fx.ASSETS) + " end)"
          for i, name in enumerate(("ip", "name", "role", "zone", "criticality"))}
_TEMPLATE = (
    "[APPLIANCE-FW] <TIMESTAMP> DEV=EDGE-FW-<NUM> RULE=BLOCK_SSH SRC=<IP>:<NUM> DST=<IP>:<NUM> PROTO=TCP <*>"
    " BYTES=<NUM> REASON=<STR>")
_MASKED = _TEMPLATE.replace("<*>", "ACTION=")
_UNKNOWN = "kind = 'unknown'"
_LINE_TIME = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
_VARIABLES = [
    ("timestamp_0", "<TIMESTAMP>", "timestamp", "timestamp", 0.90),
    ("dev_1", "<DEV>", "string", "unmapped_dev_1", 0.65),
    ("rule_2", "<RULE>", "string", "rule_name", 0.88),
    ("src_3", "<IP>", "ipv4", "src_ip", 0.95),
    ("num_4", "<NUM>", "integer", "unmapped_num_4", 0.70),
    ("dst_5", "<IP>", "ipv4", "dst_ip", 0.95),
    ("num_6", "<NUM>", "integer", "unmapped_num_6", 0.70),
    ("proto_7", "<PROTO>", "protocol", "protocol", 0.95),
    ("var_8", "<*>", "string", "unmapped_var_8", 0.65),
    ("bytes_9", "<NUM>", "integer", "bytes", 0.90),
    ("reason_10", "<STR>", "string", "message", 0.80),
]
_WORDS = "regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')"
_FACETS = {"vendor": "vendor", "detected_format": "detected_format",
           "severity": _names(fx.SEVERITY_NAMES, "severity_id"),
           "disposition": _names(fx.DISPOSITION_NAMES, "disposition_id"), "parser_used": "parser_used"}
_FACET_UNION = " union all ".join(
    f"select * from (select '{name}' as facet, {x} as value, count(*) as events from e where {GOOD} group by 2"
    f" order by events desc, value{' limit 10' if name in ('vendor', 'parser_used') else ''})"
    for name, x in _FACETS.items())

def appliances(sql: str) -> str:
    """SQL over the appliances' lines: l (event_id, appliance, template, raw, ts, spelled and the facts) and t, one row per template."""
    names = ", ".join(
        f"({k}, {_q(f'{word}: gate <NUM> {verb} for <*> from <IP> {rest}')}, {_q(word)}, {_q(verb)}, {_q(rest)})"
        for k, (word, verb, rest) in enumerate(APPLIANCES))
    return (
        f"with a as (select *, case when event_id % 3 = 0 then 0 else event_id % {len(APPLIANCES) - 1} + 1 end as appliance,"
        f" translate(cast(event_id as varchar), '0123456789', 'abcdefghij') as spelled, {facts_sql()} from events),"
        " l as (select *, concat(word, ': gate ', event_id % 50, ' ', verb, ' for ', spelled, ' from ', src_ip, ' ', rest) as raw"
        f" from a join (values {names}) as n(appliance, template, word, verb, rest) using (appliance)),"
        " t as (select *, row_number() over (order by seen, template) as template_id from (select appliance, template, min(ts) as seen,"
        f" count(*) as size from l group by 1, 2)) {sql}")


def _samples(column: str) -> str:
    """The first distinct values of a variable per template, in the order seen."""
    return (f"(select template, string_agg(v, '|' order by seen, v) as values_ from (select template, cast({column} as varchar) as v,"
            f" min(ts) as seen from l group by 1, 2 qualify row_number() over (partition by template order by min(ts), v) <= {fx.DISCOVERED_SAMPLES})"
            " group by 1)")


_BUILT_IN = ", ".join(f"({_q(p)}, {_q(v)}, {_q(d)})" for p, v, d, _ in fx.BUILT_IN_PARSERS)
_APPLIANCE_PARSER = "concat('custom-appliance-device-model-', template_id, '-parser')"
_MERGED = ("select event_id, event_type, value + case when event_id % 5 = 0 then 2 when event_id % 3 = 0 then 1 else 0 end as value,"
           " cast(case when event_id % 5 = 0 then 3 when event_id % 3 = 0 then 2 else 1 end as int) as batch from events")
_EDGE_STATUS = "case event_id % 5 when 0 then 2 when 2 then 2 when 3 then 2 else 1 end"
_EDGE_DIRECTION = "case event_id % 4 when 1 then 2 when 2 then 3 else 1 end"
_EDGE_REST = sorted(name for name in [*EDGE, "timestamp"] if name not in fx.KNOWN_KEYS)
_EDGE_TEXT = ", ".join(
    f"concat('{name}=', {'epoch_ms(ts)' if name == 'timestamp' else EDGE[name]})" for name in _EDGE_REST)
_GEO = {name: "case " + " ".join(f"when src_ip like {_q(n[0].rsplit('.', 1)[0] + '.%')} then {_q(n[i]) if i < 5 else n[i]}" for n in fx.GEO_NETWORKS
                                 if n[0][:3] in ("8.8", "185")) + " end"
        for name, i in (("country", 1), ("country_code", 2), ("city", 3), ("as_name", 4), ("as_number", 5))}
STORED_SQL = {
    "edge_events":
        f"select event_id, {_EDGE_STATUS} as status_id, {_names(fx.STATUS_NAMES, _EDGE_STATUS)} as status, {_EDGE_DIRECTION} as direction_id,"
        f" {_names(fx.DIRECTION_NAMES, _EDGE_DIRECTION)} as direction, event_id % 13 as packets_in, event_id % 17 as packets_out,"
        f" bytes_in + bytes_out as bytes_total, {_ASSET['name']} as src_hostname, {_ASSET['zone']} as src_zone, {_ASSET['role']} as src_role,"
        f" {_ASSET['criticality']} as src_criticality, {_GEO['country']} as dst_country, {_GEO['city']} as dst_city,"
        f" {_GEO['country_code']} as dst_country_code, {_GEO['as_name']} as dst_as_name, {_GEO['as_number']} as dst_as_number,"
        f" concat_ws(';', {_EDGE_TEXT}) as unmapped from (select *, {facts_sql()} from events)",
    "event_table": _MERGED,
    "event_lookup": f"select event_id, value, batch from ({_MERGED}) where event_id in (select doc_id from labels)",
    "archive_index_lookup": "select doc_id, cast(strlen(text) as int) as byte_length,"
                            " strftime(date '2026-01-01' + cast(doc_id % 40 as int), '%Y-%m-%d') as day from documents"
                            " where trim(text) != '' and doc_id in (select doc_id from labels)",
    "trailing_rate": "select distinct epoch_us(ts) as ts_us, n as events, round(n / 1800.0::double, 1) as eps from (select ts, count(*) over"
                     " (order by ts range between interval 1800 seconds preceding and current row) as n from events)",
    "log_files": appliances("select raw as raw_payload, 'Acme' as vendor_hint, 'file' as transport, 2 as lines, 2 as places from l"),
    "capture_files": appliances(
        "select concat('<13>', raw, ' é') as raw_payload, 'tcp' as transport, 1 as times, 1 as places from l"),
    "json_files": appliances(
        "select case when event_id % 2 = 0 then raw else concat('{\"event\":', event_id, ',\"line\":\"', raw, '\"}') end as raw_payload,"
        " 2 as times from l"),
    "dead_letters_listed": first(
        f"select letters, case when {_UNKNOWN} then 'UNRESOLVED' else 'REPLAYED' end as status,"
        f" cast(case when {_UNKNOWN} then 0 else 1 end as int) as replay_count, count(*) as records from e, (values ('all'), ('kept')) as v(letters)"
        f" where error_stage is not null and (letters = 'all' or {_UNKNOWN}) group by all"),
    # Class names stand in the OCSF text alone; forms of deny in lines that say so.
    "search_stems": first(
        f"select line_id, 'phrase' as query from e where {GOOD} and class_uid = 4001 union all"
        f" select line_id, 'terms' from e where {GOOD} and (class_uid = 2001 or lower(coalesce(action, '')) in ('deny', 'denied')"
        " or kind = 'squid' and blocked or kind = 'asa_deny')"),
    "lake_readback": first(
        "select line_id, time_epoch, vendor, coalesce(src_ip, '') as src_ip, coalesce(dst_ip, '') as dst_ip, disposition_id,"
        f" strftime(make_timestamp(time_epoch * 1000), '%Y-%m-%d') as day from e where {GOOD}"),
    "dry_run": appliances(
        "select event_id, own, own as success, 'cef-standard-parser' as parser_used, case when own then src_ip end as src_ip,"
        " cast(case when own then dst_port end as bigint) as dst_port from l, (values (true), (false)) as v(own)"),
    "field_samples": appliances(
        "select template, name, placeholder, ocsf_field, values_ as sample_values from ("
        f" select template, 'num_0' as name, '<NUM>' as placeholder, 'unmapped_num_0' as ocsf_field, values_ from {_samples('event_id % 50')}"
        f" union all select template, 'var_1', '<*>', 'unmapped_var_1', values_ from {_samples('spelled')}"
        f" union all select template, 'ip_2', '<IP>', 'src_ip', values_ from {_samples('src_ip')})"),
    "sessions_listed": appliances(
        "select listed, template, case when appliance = 3 then 'reviewer' else '' end as reviewed_by,"
        " case when appliance = 2 then 'src_ip_seen|src_ip_seen|trim' else 'src_ip|src_ip' end as third from t,"
        " (values ('pending'), ('rejected'), ('one')) as v(listed) where case listed when 'pending' then appliance <> 3"
        " when 'rejected' then appliance = 3 else appliance = 2 end"),
    "catalogue_listed": appliances(
        f"select {_APPLIANCE_PARSER} as parser_id, '1.0.0' as version, 'Custom-Appliance' as vendor,"
        " concat('Device-Model-', template_id) as product, 'drain3_template' as kind, 'ACTIVE' as status, template_id = 1 as looked_up,"
        f" 'reviewer' as approved_by from t union all select p, '1.0.0', v, d, 'native', 'ACTIVE', false, '' from (values {_BUILT_IN}) as b(p, v, d)"),
    "appliance_parse": appliances(
        f"select event_id, {_APPLIANCE_PARSER} as parser_used, src_ip, '' as error_stage, 'Custom-Appliance' as meta_vendor"
        " from l join t using (appliance)"),
    "service_counters": first(
        f"select count(*) as total_ingested, count(*) filter (where {GOOD}) as total_normalized,"
        f" count(*) filter (where kind in ('blank', 'bad_ip')) as total_errors, count(*) filter (where {_UNKNOWN}) as total_unknowns,"
        f" count(*) filter (where {_UNKNOWN}) as unresolved_errors_count, {len(fx.BUILT_IN_PARSERS) + len(APPLIANCES)} as active_parsers_count,"
        f" {len(APPLIANCES)} as onboarding_sessions_count, count(*) filter (where line_id % 4 = 0 or line_id % 3 = 0) as outbox_pending_count,"
        " count(*) filter (where line_id % 4 = 0 or line_id % 3 = 0) as outbox_failed_count, 0 as dlq_count,"
        " count(*) filter (where line_id % 4 != 0 and line_id % 3 != 0) as outbox_complete_count from e"),
}


ORACLE = {
    **STORED_SQL,
    "detect_format_counts": first(
        "select detected_format, vendor, product, count(*) as lines from e group by all"),
    "route_parser_counts": first("select parser_used, count(*) as lines from e group by all"),
    **{name: first(f"select {', '.join(PARSED)} from e where parser_used = '{p}'") for name, p in PARSERS.items()},
    **{name: second(f"select {', '.join(PARSED2)} from e where parser_used = '{p}'") for name, p in PARSERS2.items()},
    "parse_outcome": first(
        "select parser_used, case when kind = 'short_cef' then 0.5 else 1.0 end::double as confidence,"
        " case when kind = 'short_cef' then 'Parsing error in cef-standard-parser: Malformed CEF header:"
        " expected 7 pipes, found 3' else '' end as parse_error, count(*) as lines from e group by all"),
    "unmapped_fields": first(
        "select line_id, cast(case when kind = 'big_port' then 11 else 12 end + 1 as int) as unmapped_count,"
        " case when kind = 'big_port' then 'FGT-1' else 'FGT-60D' end as devname,"
        " case when kind = 'big_port' then '7' else cast(line_id % 9 as varchar) end as policyid,"
        " cast(bytes_out as varchar) as sentbyte from e where kind in ('big_port', 'fortinet')"),
    "ocsf_flat": first(
        "select line_id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), case when epoch_us(ts) % 1000000 = 0 then '' else"
        " concat('.', lpad(cast(epoch_us(ts) % 1000000 as varchar), 6, '0')) end, '+00:00') as ingest_timestamp,"
        " time_epoch, vendor, product, detected_format, class_uid,"
        " case when class_uid = 2001 then 'Security Finding' else 'Network Activity' end as class_name, severity_id,"
        f" {_names(fx.SEVERITY_NAMES, 'severity_id')} as severity, 1 as status_id, 'Success' as status,"
        f" disposition_id, {_names(fx.DISPOSITION_NAMES, 'disposition_id')} as disposition,"
        " coalesce(action, 'Create') as action, coalesce(src_ip, '') as src_ip, coalesce(src_port, 0) as src_port,"
        " coalesce(dst_ip, '') as dst_ip, coalesce(dst_port, 0) as dst_port,"
        " coalesce(protocol_name, 'TCP') as protocol, coalesce(bytes_in, 0) as bytes_in,"
        f" coalesce(bytes_out, 0) as bytes_out, parser_used from e where {GOOD}"),
    "ocsf_documents": first(
        "select line_id, class_uid, finding_title, finding_uid, case when class_uid = 2001 then 'Misc' end as"
        f" finding_type, protocol_name, bytes_in, rule_name from e where {GOOD}"),
    "lean_documents": first(
        "select line_id, line_id as trace_id, vendor, coalesce(action, 'Create') as action,"
        " coalesce(protocol_name, 'TCP') as protocol_name, src_ip, dst_port,"
        " case when class_uid = 2001 then 'Security Finding' else 'Network Activity' end as class_name,"
        f" '1.1.0' as ocsf_schema_version, vendor as meta_vendor from e where {GOOD}"),
    "provenance": first(
        "select line_id, case when error_stage is null then concat('INGESTION_RECEIVED>RAW_ARCHIVED_SHA256>"
        "FORMAT_DETECTED:', detected_format, '>PARSED:', parser_used, ':1.0.0>OCSF_NORMALIZED_1.1.0>ENRICHED_OFFLINE>"
        "INDEXED_DUAL_SINK>DELIVERY_COMPLETE_DUAL_ACK') else 'INGESTION_RECEIVED>RAW_ARCHIVED_SHA256' end as provenance from e"),
    "severity_map": first(
        f"select parser_used, severity_id, {_names(fx.SEVERITY_NAMES, 'severity_id')} as severity, count(*) as events"
        f" from e where {GOOD} group by all"),
    "disposition_map": first(
        f"select coalesce(action, '') as action, {_names(fx.DISPOSITION_NAMES, 'disposition_id')} as disposition,"
        f" count(*) as events from e where {GOOD} group by all"),
    "protocol_map": first(
        "select protocol_name, case protocol_name when 'TCP' then 6 when 'UDP' then 17 end as protocol_num,"
        f" count(*) as events from e where {GOOD} group by all"),
    "timestamp_norm": first("select line_id, time_epoch from e"),
    "envelope_hash": f"select doc_id, {_uuid('doc_id', 'text')} as event_id, sha256(text) as raw_sha256,"
                     " cast(strlen(text) as int) as byte_length from documents where trim(text) != ''",
    "integrity_check": "select doc_id, doc_id % 10 != 0 as is_valid, doc_id % 10 = 0 as tampered, case when"
                       " doc_id % 10 = 0 then 'ALERT: Stored SHA-256 hash mismatch! Payload has been tampered with.'"
                       " else 'Cryptographic integrity verified: SHA-256 matches exactly' end as details"
                       " from documents where trim(text) != ''",
    "integrity_of_ids": "select coalesce(doc_id % 10 != 0, false) as is_valid, coalesce(doc_id % 10 = 0, false) as"
                        " tampered, count(*) as events from events left join (select doc_id from documents where"
                        " trim(text) != '') on doc_id = event_id group by all",
    "archive_lookup": "select doc_id, cast(strlen(text) as int) as byte_length from documents where trim(text) != ''"
                      " and doc_id in (select doc_id from labels)",
    "validate_ocsf_errors": first(
        "select line_id, error_stage, case kind when 'blank' then 'Ingestion Error: Raw payload is empty'"
        " when 'unknown' then 'Unrecognized log format routed to template onboarding'"
        " else 'OCSF Validation Error: Malformed IPv4 address in src_endpoint: ''10.0.1''' end as errors"
        " from e where error_stage is not null"),
    "dead_letter_stages": first(
        "select error_stage, 'UNRESOLVED' as status, 0 as replay_count, count(*) as records from e"
        " where error_stage is not null group by all"),
    "replay_outcome": first(
        f"select count(*) as total_replayed, count(*) filter (where {_UNKNOWN}) as successful_normalizations"
        " from e where error_stage is not null"),
    "catalogue_parse": first(
        "select line_id, raw_src_ip as src_ip, raw_dst_ip as dst_ip, raw_bytes_in as bytes_total,"
        " 'BLOCK_SSH' as rule_name, 'TCP' as protocol_name, 1 as disposition_id,"
        " cast(floor(cast(epoch_us(ts) // 1000000 * 1000000 as double) / 1e6 * 1e3) as bigint) as time_epoch,"
        f" concat('\"', event_type, '\"') as message from e where {_UNKNOWN}"),
    "pipeline_counters": first(
        f"select count(*) as total_ingested, count(*) filter (where {GOOD}) as total_normalized,"
        " count(*) filter (where kind in ('blank', 'bad_ip')) as total_errors,"
        f" count(*) filter (where {_UNKNOWN}) as total_unknowns from e"),
    "asset_enrich": first(
        f"select line_id, coalesce(line_hostname, {_ASSET['name']}) as dst_hostname,"
        f" coalesce(line_zone, {_ASSET['zone']}) as dst_zone, {_ASSET['role']} as role,"
        f" {_ASSET['criticality']} as criticality from e where {GOOD}"),
    "geo_enrich": first(
        "select line_id, case when src_ip like '8.8.8.%' then 'United States' when src_ip like '185.220.101.%' then"
        " 'Netherlands' end as country, case when src_ip like '8.8.8.%' then 'Mountain View' when src_ip like"
        " '185.220.101.%' then 'Amsterdam' end as city, case when src_ip like '8.8.8.%' then 15169 when src_ip like"
        f" '185.220.101.%' then 60729 end as as_number from e where {GOOD}"),
    "private_flag": first(
        f"select case when src_ip is not null then {_private('src_ip')} end as src_is_private,"
        f" case when dst_ip is not null then {_private('dst_ip')} end as dst_is_private, count(*) as events"
        f" from e where {GOOD} group by all"),
    "facet_counts": first(_FACET_UNION),
    "totals": "select count(*) as total_events, cast(sum(strlen(text)) as bigint) as total_bytes from documents"
              " where trim(text) != ''",
    "search_page": first(
        f"select line_id, time_epoch, vendor, src_ip, dst_ip from e where {GOOD} and disposition_id = 2"
        " and contains(src_ip, '185.220') order by time_epoch desc, line_id limit 100 offset 25"),
    "search_total": first(
        f"select count(*) as total from e where {GOOD} and vendor = 'Cisco' and dst_ip = '10.0.0.1'"),
    "search_phrase": f"select doc_id, lang from documents where contains(concat(' ', {_WORDS}, ' '), ' {PHRASE} ')",
    "search_terms": "select doc_id, lang from documents where "
                    + " or ".join(f"contains(concat(' ', {_WORDS}, ' '), ' {t} ')" for t in TERMS.split()),
    "audit_page": "select lpad(cast(o_orderkey as varchar), 12, '0') as audit_id, 'user-3' as user,"
                  " 'ORDER_F' as action from orders where o_custkey % 7 = 3 and o_orderstatus = 'F'"
                  " order by o_orderdate desc, audit_id limit 100 offset 20",
    "latency_percentiles": "select event_type, count(*) as events, "
                           + ", ".join(f"round({_percentile('value', q)}, 2) as p{n}"
                                       for n, q in ((50, 0.5), (95, 0.95), (99, 0.99)))
                           + ", round(avg(value), 2) as mean from events group by event_type",
    "eps_windows": "select cast(epoch_ms(time_bucket(interval '1 hour', ts)) as bigint) as window_start_ms,"
                   " count(*) as events, round(count(*) / 3600.0::double, 1) as eps from events group by 1",
    "throughput_report": "with r as (select count(*) as n, sum(length(props)) as b,"
                         " (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as s, avg(value) as m, "
                         + ", ".join(f"{_percentile('value', q)} as p{n}"
                                     for n, q in ((50, 0.5), (95, 0.95), (99, 0.99)))
                         + " from events) select n as total_events_processed, cast(b as bigint) as total_data_bytes,"
                         " round(s, 3) as duration_seconds, round(n / s, 1) as throughput_eps,"
                         " round(b / 1048576e0 / s, 2) as throughput_mb_sec, round(m, 3) as latency_avg_ms,"
                         " round(p50, 3) as latency_p50_ms, round(p95, 3) as latency_p95_ms,"
                         " round(p99, 3) as latency_p99_ms,"
                         " round(round(n / s, 1) * 86400e0 / 1000000e0, 1) as million_events_per_day from r",
    "parse_cef_events":
        f"select event_id as line_id, 'cef-standard-parser' as parser_used, 'Gate|Way' as meta_product, src_ip, src_port, dst_ip, dst_port,"
        " 'UDP' as protocol_name, cast(case when event_id % 11 >= 9 then 5 when event_id % 11 >= 7 then 4 when event_id % 11 >= 4 then 3"
        " when event_id % 11 >= 2 then 2 else 1 end as int) as severity_id, case when blocked then 2 else 1 end as disposition_id,"
        " case when blocked then 'block' else 'allow' end as action, bytes_in, bytes_out, 'two words' as app_name,"
        " concat('rule=', event_id % 6) as rule_name, concat('host ', event_id % 4) as src_hostname,"
        " concat('00:11:22:33:44:0', event_id % 10) as src_mac, concat('Seen | passed ', event_id) as message"
        f" from (select *, {facts_sql()} from events)",
    "dedupe": "select event_type, count(*) as events, cast(sum(event_id) as bigint) as id_sum from events group by 1",
    "latest_events": "select event_id, 2 as version, value + 1 as value from events",
    # Requests of each type one after the other, with the last three passes carried along.
    "rate_limit": "with recursive r as (select event_type, event_id, epoch_us(ts) as ts_us,"
                  " row_number() over (partition by event_type order by ts, cast(event_id as varchar)) as n from events),"
                  " s as (select event_type, event_id, ts_us, n, true as admitted, [ts_us] as passes from r where n = 1"
                  " union all select r.event_type, r.event_id, r.ts_us, r.n,"
                  " len(s.passes) < 3 or r.ts_us > s.passes[1] + 1800000000,"
                  " case when len(s.passes) < 3 then list_append(s.passes, r.ts_us)"
                  " when r.ts_us > s.passes[1] + 1800000000 then list_append(s.passes[2:], r.ts_us) else s.passes end"
                  " from s join r on r.event_type = s.event_type and r.n = s.n + 1)"
                  " select event_type as client, cast(event_id as varchar) as tie, ts_us, admitted from s",
    "delivery_state": "select case when event_id % 3 = 2 then 'DEAD_LETTER' else 'DELIVERY_COMPLETE' end as state,"
                      " count(*) as events from events group by 1",
    "retry_schedule": "select event_id, case when event_id % 5 = 4 then 'DEAD_LETTER' else 'FAILED_RETRYABLE' end as"
                      " state, cast(event_id % 5 + 1 as int) as attempt_count, false as search_ack, true as lake_ack,"
                      " cast(least(60, 2 * power(2, event_id % 5)) as bigint) as wait_seconds from events",
    "sanitize_documents": f"select doc_id, {_sanitized('text', 512)} as clean from documents",
    "sanitize_pages": f"select page_id, {_sanitized('html', 100000)} as clean from pages",
    "mask_lines": first(
        f"select line_id, replace({_q(_MASKED)}, 'ACTION=', concat('ACTION=', case when blocked then 'DENY'"
        f" else 'ALLOW' end)) as masked from e where {_UNKNOWN}"),
    "mask_documents": f"select doc_id, md5({_masked('text')}) as masked_md5 from documents",
    "mine_templates": first(
        f"select 1 as template_id, {_q(_TEMPLATE)} as template, count(*) as size from e where {_UNKNOWN}"),
    "appliance_templates": appliances("select cast(template_id as int) as template_id, template, size from t"),
    "appliance_params": appliances(
        "select event_id, cast(template_id as int) as template_id, concat_ws('|', event_id % 50, spelled, src_ip) as parameters"
        " from l join t using (appliance)"),
    "session_merge": appliances(
        "select " + _uuid_of("if(appliance < 20, template, replace(template, ': gate ', ': <*> '))") + " as session_id,"
        " replace(template, ': gate ', ': <*> ') as template, size, if(appliance = 1, 'REJECTED', 'PENDING') as status,"
        " cast(least(20, size) as int) as samples, if(appliance = 0, '1:gate_number', '') as reviewed, '<*> <NUM> <*> <IP>' as placeholders from t"),
    "template_params": first(
        f"select line_id, 1 as template_id, concat_ws('|', {_LINE_TIME}, line_id % 20, raw_src_ip, raw_src_port,"
        " raw_dst_ip, raw_dst_port, case when blocked then 'ACTION=DENY' else 'ACTION=ALLOW' end, raw_bytes_in,"
        f" concat('\"', event_type, '\"')) as parameters from e where {_UNKNOWN}"),
    "infer_fields": first(
        "select size, name, placeholder, inferred_type, ocsf_field, confidence from (select count(*) as size from e"
        f" where {_UNKNOWN}), (values "
        + ", ".join(f"({', '.join(_q(v) for v in row[:4])}, {row[4]}::double)" for row in _VARIABLES)
        + ") as v(name, placeholder, inferred_type, ocsf_field, confidence)"),
}

__all__ = ["ORACLE"]
