"""Normalise parsed fields to OCSF 1.1.0, flat first, nested on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame

from palisade import fixed_values as fx
from palisade.functions.text import apart, case, coalesce, contains_any, isin, lit, matches, strip, truthy
from palisade.functions.values import (
    by_words, epoch_millis, lookup, protocol_name, protocol_number, utc_date, utc_text,
)
from palisade.operators.parsers.base import SLOTS

_CLOCK = r"\d{1,2}:\d{1,2}:\d{1,2}"
_MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}


def timestamp_from_text(t: str, year: str) -> str:
    """Timestamp of one of the accepted spellings, null otherwise.

    The text is brought to ISO form with a zone and then cast once: text without a zone is
    UTC, text without a year (or with 1900) takes the given year.
    """
    iso = rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}T{_CLOCK}(?:\.\d{{1,6}})?(?:Z|[+-]\d{{2}}:?\d{{2}})$"
    plain = rf"^\d{{4}}(?:-\d{{1,2}}-\d{{1,2}}|/\d{{1,2}}/\d{{1,2}})\s+{_CLOCK}$"
    short = rf"^[A-Za-z]{{3}}\s+\d{{1,2}}\s+{_CLOCK}$"
    blanks = lit(r"\s+")
    words = f"split({t}, {blanks})"
    spelled = case(
        (matches(t, iso), t),
        (matches(t, plain), f"concat(regexp_replace(translate({t}, '/', '-'), {blanks}, 'T'), 'Z')"),
        (matches(t, short),
         f"concat({year}, '-', {lookup(_MONTHS, f'lower(get({words}, 0))')}, '-', get({words}, 1), 'T',"
         f" get({words}, 2), 'Z')"),
    )
    return f"try_cast(regexp_replace({spelled}, '^1900-', concat({year}, '-')) as timestamp)"


def normalize_ocsf(df: DataFrame) -> DataFrame:
    """Flat OCSF columns from parsed rows; the ``ir_*`` columns are consumed."""
    ir = {name: f"ir_{name}" for name in SLOTS}
    text = {name: truthy(f"ir_{name}") for name in SLOTS}
    rest = [c for c in df.columns if c != "ir_src_port"]
    df = df.selectExpr(
        *rest,
        apart("ir_src_port"),
        f"{strip(text['time_text'])} as _time_text",
        f"cast(year({utc_date('ingest_ts')}) as string) as _year",
    )
    number = "nullif(ir_time_number, 0D)"
    df = df.selectExpr("*", f"{timestamp_from_text('_time_text', '_year')} as _text_ts").selectExpr(
        "*",
        "coalesce(_text_ts, ingest_ts) as _moment",
        f"cast(case when {number} > 1e11D then {number} else {number} * 1000 end as bigint) as _number_ms",
        f"cast(round(case when {number} > 1e11D then {number} * 1000 else {number} * 1000000 end) as bigint)"
        " as _number_us",
    )
    rest = [c for c in df.columns if c != "ir_src_port"]
    df = df.selectExpr(
        *rest,
        apart("ir_src_port"),
        f"coalesce(ir_target_class_uid = {fx.CLASS_SECURITY_FINDING}, false) or ir_has_signature as _finding",
        f"coalesce(_number_ms, {epoch_millis('_moment')}) as time_epoch",
        f"{utc_text('coalesce(timestamp_micros(_number_us), _moment)')} as time_dt",
        case(
            (isin("ir_severity_id", fx.SEVERITY_NAMES), "ir_severity_id"),
            default=coalesce(by_words("lower(ir_severity)", fx.SEVERITY_WORDS), "1")) + " as severity_id",
        case(
            (isin("ir_status_id", fx.STATUS_NAMES), "ir_status_id"),
            (contains_any("lower(ir_status)", fx.STATUS_FAILURE_MARKS), "2"), default="1") + " as status_id",
        case(
            (isin("ir_disposition_id", fx.DISPOSITION_NAMES), "ir_disposition_id"),
            (isin("lower(ir_action)", fx.BLOCK_ACTIONS), "2"), default="1") + " as disposition_id",
        coalesce(text["device_vendor"], truthy("vendor"), "'Generic'") + " as meta_vendor",
        coalesce(text["device_product"], truthy("product"), "'Device'") + " as meta_product",
        "lower(coalesce(ir_direction, 'inbound')) as _direction",
    )

    def activity(x: str) -> str:
        return f"case when not _finding then {x} end"

    def finding(x: str) -> str:
        return f"case when _finding then {x} end"

    def by_class(of_finding: str, of_activity: str) -> str:
        return f"case when _finding then {of_finding} else {of_activity} end"

    direction = case(("_direction = 'inbound'", "1"), ("_direction = 'outbound'", "2"), default="3")
    allowed = "case when disposition_id = 1 then 'allow' else 'deny' end"
    has_rule = f"{coalesce(text['rule_name'], text['rule_id'])} is not null"
    columns = {
        "class_uid": by_class(str(fx.CLASS_SECURITY_FINDING), str(fx.CLASS_NETWORK_ACTIVITY)),
        "class_name": by_class("'Security Finding'", "'Network Activity'"),
        "category_uid": by_class("2", "4"),
        "category_name": by_class("'Findings'", "'Network Activity'"),
        "activity_id": by_class("1", "coalesce(ir_activity_id, 6)"),
        "activity_name": by_class("'Create'", "coalesce(ir_activity_name, 'Traffic')"),
        "severity": lookup(fx.SEVERITY_NAMES, "severity_id"),
        "status": lookup(fx.STATUS_NAMES, "status_id"),
        "disposition": lookup(fx.DISPOSITION_NAMES, "disposition_id"),
        "action": activity(coalesce(text["action"], allowed)),
        "message": by_class(
            coalesce(text["message"], text["signature"], "'Security alert detected'"),
            coalesce(text["message"], "concat(meta_vendor, ' ', meta_product, ' network event')")),
        "meta_version": ir["device_version"],
        "original_time": coalesce(text["time_text"], f"cast({number} as string)", "time_dt"),
        "protocol_name": activity(protocol_name("ir_protocol")),
        "protocol_num": activity(protocol_number("ir_protocol")),
        "direction_id": activity(direction),
        "direction": activity(lookup(fx.DIRECTION_NAMES, direction)),
        "bytes_in": activity(ir["bytes_in"]),
        "bytes_out": activity(ir["bytes_out"]),
        "bytes_total": activity("coalesce(ir_bytes, ir_bytes_in + ir_bytes_out)"),
        "packets_in": activity(ir["packets_in"]),
        "packets_out": activity(ir["packets_out"]),
        "app_name": activity(coalesce(text["app_name"], text["service"])),
        "rule_name": activity(text["rule_name"]),
        "rule_uid": f"case when not _finding and {has_rule} then coalesce(ir_rule_id, '') end",
        "finding_title": finding(coalesce(text["signature"], text["message"], "'Security Alert'")),
        "finding_desc": finding(coalesce(text["message"], "''")),
        "finding_uid": finding(coalesce(text["signature_id"], "event_id")),
        "finding_type": finding(coalesce(text["category"], "'Network Intrusion'")),
    }
    for side in ("src", "dst"):
        columns[f"{side}_ip"] = strip(text[f"{side}_ip"])
        columns[f"{side}_port"] = f"case when ir_{side}_port between 1 and 65535 then cast(ir_{side}_port as int) end"
        for part in ("hostname", "mac", "zone"):
            columns[f"{side}_{part}"] = text[f"{side}_{part}"]
    rest = [c for c in df.columns if not c.startswith(("ir_", "_")) and c != "time_epoch"]
    return df.selectExpr(*rest, apart("time_epoch"), *[f"{x} as {name}" for name, x in columns.items()])


_ENDPOINT_TYPES = {
    "ip": "string", "port": "int", "hostname": "string", "mac": "string", "zone": "string",
    "asset_info": "struct<name:string,role:string,zone:string,criticality:string>",
    "location": "struct<country:string,city:string,country_code:string>",
    "autonomous_system": "struct<name:string,number:int>",
}


def _endpoint(df: DataFrame, side: str) -> str:
    parts = []
    for name, kind in _ENDPOINT_TYPES.items():
        full = f"{side}_{name}"
        parts.append(f"'{name}', {full if full in df.columns else f'cast(null as {kind})'}")
    return f"named_struct({', '.join(parts)})"


def ocsf_document(df: DataFrame) -> DataFrame:
    """Add the nested document ``ocsf``; parts a class does not have are null."""
    activity = f"class_uid = {fx.CLASS_NETWORK_ACTIVITY}"
    profiles = ", ".join(lit(p) for p in fx.PROFILES)
    return df.selectExpr("*", f"""struct(
        class_uid, category_uid, class_name, category_name, activity_id, activity_name,
        severity_id, severity, status_id, status, disposition_id, disposition, action,
        time_epoch as time, time_dt, message,
        struct(
            {lit(fx.OCSF_VERSION)} as version,
            struct(meta_product as name, meta_vendor as vendor_name, meta_version as version) as product,
            original_time, array({profiles}) as profiles) as metadata,
        {_endpoint(df, 'src')} as src_endpoint,
        {_endpoint(df, 'dst')} as dst_endpoint,
        case when {activity} then struct(protocol_name, protocol_num, direction_id, direction) end as connection_info,
        case when {activity} then
            struct(bytes_in, bytes_out, bytes_total as bytes, packets_in, packets_out) end as traffic,
        app_name,
        case when rule_uid is not null then struct(rule_name as name, rule_uid as uid) end as rule,
        case when not {activity} then struct(
            finding_title as title, finding_desc as desc, finding_uid as uid, time_epoch as created_time,
            array(finding_type) as types) end as finding_info,
        unmapped) as ocsf""")


_ACTION_SHOWN = coalesce(truthy("action"), truthy("activity_name"), "'allow'")


def flatten_events(df: DataFrame) -> DataFrame:
    """Lake rows: 24 flat columns without nulls."""
    return df.selectExpr(
        "event_id",
        f"{utc_text('ingest_ts')} as ingest_timestamp",
        "cast(coalesce(time_epoch, 0) as bigint) as time_epoch",
        "vendor",
        "product",
        "detected_format",
        "coalesce(class_uid, 4001) as class_uid",
        "coalesce(class_name, 'Network Activity') as class_name",
        "coalesce(severity_id, 1) as severity_id",
        "coalesce(severity, 'Informational') as severity",
        "coalesce(status_id, 1) as status_id",
        "coalesce(status, 'Success') as status",
        "coalesce(disposition_id, 1) as disposition_id",
        "coalesce(disposition, 'Allowed') as disposition",
        f"{_ACTION_SHOWN} as action",
        "coalesce(src_ip, '') as src_ip",
        "coalesce(src_port, 0) as src_port",
        "coalesce(dst_ip, '') as dst_ip",
        "coalesce(dst_port, 0) as dst_port",
        f"{coalesce(truthy('protocol_name'), lit('TCP'))} as protocol",
        "coalesce(bytes_in, 0L) as bytes_in",
        "coalesce(bytes_out, 0L) as bytes_out",
        "raw_sha256",
        f"{coalesce(truthy('parser_used'), lit('unknown'))} as parser_used",
    )


def lean_document(df: DataFrame) -> DataFrame:
    """Search documents: no payload, pointers to the archive instead; absent ips and ports stay null."""
    return df.selectExpr(
        "event_id", f"{utc_text('ingest_ts')} as ingest_timestamp", "time_dt", "time_epoch",
        "event_id as trace_id", "vendor", "product", "detected_format", "collector_host",
        "class_uid", "class_name", "category_uid", "category_name", "severity_id", "severity",
        "status_id", "status", "disposition_id", "disposition", f"{_ACTION_SHOWN} as action",
        "coalesce(protocol_name, 'TCP') as protocol_name", "app_name",
        "src_ip", "src_port", "dst_ip", "dst_port",
        "raw_sha256", "raw_sha256 as sha256_hash", "concat(bucket, '/', object_key) as raw_storage_uri",
        "byte_length", "parser_used", "parser_version", f"{lit(fx.OCSF_VERSION)} as ocsf_schema_version",
        "confidence", "ocsf",
    )
