"""Format detection and parser routing: ordered rules, the first hit wins."""

from __future__ import annotations

from pyspark.sql import DataFrame

from palisade import fixed_values as fx
from palisade.functions.text import apart, case, coalesce, contains_any, fenced, item, last_key_wins, lit, matches, strip
from palisade.operators.parsers import Definition, ordered_parsers, shape_list
from palisade.operators.parsers.base import LOWER, MEMBERS, OBJ, RAW, json_has


def prepare_lines(df: DataFrame) -> DataFrame:
    """Working columns of a line: stripped text, lower case, JSON object and its members.

    The JSON reader stops after the first value, so a braced line is read as the first
    element of an array with a sentinel behind it: trailing text breaks the array.
    """
    last_key_wins(df.sparkSession)
    braced = f"(startswith({RAW}, '{{') and endswith({RAW}, '}}'))"
    df = df.selectExpr("*", f"{strip('raw_payload')} as {RAW}")
    df = df.selectExpr(
        "*", f"lower({RAW}) as {LOWER}", f"case when {braced} then try_parse_json(concat('[', {RAW}, ',7]')) end as _all")
    complete = "try_variant_get(_all, '$[1]', 'string') = '7'"
    df = df.selectExpr("*", f"case when {complete} then try_variant_get(_all, '$[0]', 'variant') end as {OBJ}").drop("_all")
    return df.selectExpr("*", f"try_variant_get({OBJ}, '$', 'map<string,string>') as {MEMBERS}")


def _verdict(form: str, vendor: str, product: str, confidence: float) -> str:
    return (
        f"named_struct('detected_format', '{form}', 'vendor', {vendor}, 'product', {product},"
        f" 'confidence', {confidence}D)"
    )


def _fixed(form: str, vendor: str, product: str, confidence: float) -> str:
    return _verdict(form, lit(vendor), lit(product), confidence)


def _header(tag: str, i: int, default: str) -> str:
    return coalesce(strip(item(f"split(substring({RAW}, instr({RAW}, '{tag}')), '[|]', 4)", i)), lit(default))


def _tagged(tag: str) -> str:
    return f"(startswith({RAW}, '{tag}') or contains({RAW}, ' {tag}'))"


def _detection() -> str:
    def any_of(*paths: str) -> str:
        return "(" + " or ".join(json_has(p) for p in paths) + ")"

    is_json = f"{OBJ} is not null"
    group = f"regexp_extract({RAW}, {{}}, 4)"
    return case(
        (f"coalesce({RAW}, '') = ''", _fixed("unknown", "unknown", "unknown", 0.0)),
        (f"{is_json} and {json_has('$.event_type')} and {any_of('$.src_ip', '$.flow_id', '$.alert')}",
         _fixed("json", "Suricata", "EVE-IDS", 0.99)),
        (f"{is_json} and {json_has('$.ts')} and " + any_of("$['id.orig_h']", "$['id.resp_h']", "$.proto"),
         _fixed("json", "Zeek", "Network-Monitor", 0.99)),
        (f"{is_json} and {any_of('$.rule_name', '$.firewall')}", _fixed("json", "Generic-Firewall", "Cloud-FW", 0.95)),
        (is_json, _fixed("json", "Generic", "JSON-Telemetry", 0.90)),
        (_tagged("CEF:"),
         _verdict("cef", _header("CEF:", 1, "Generic-CEF"), _header("CEF:", 2, "CEF-Device"), 0.98)),
        (_tagged("LEEF:"),
         _verdict("leef", _header("LEEF:", 1, "Generic-LEEF"), _header("LEEF:", 2, "LEEF-Device"), 0.98)),
        # The contains tests repeat what the patterns require; they spare most lines the pattern.
        (f"{contains_any(LOWER, ['devname=', 'subtype='])} and {matches(RAW, fx.FORTINET_KV)}", _fixed("syslog_rfc3164", "Fortinet", "FortiOS", 0.95)),
        (f"{contains_any(LOWER, ['%asa-', '%ftd-'])} and {matches(RAW, fx.ASA_CODE_ANY_CASE)}", _fixed("syslog_rfc3164", "Cisco", "ASA", 0.98)),
        (contains_any(RAW, fx.CHECKPOINT_MARKS), _fixed("syslog_rfc3164", "Checkpoint", "Firewall-1", 0.92)),
        (matches(RAW, fx.SQUID_HEAD), _fixed("proprietary", "Squid", "Proxy", 0.96)),
        (f"startswith({RAW}, '<') and {matches(RAW, fx.SYSLOG_5424)}",
         _verdict("syslog_rfc5424", "'Generic-Syslog'", group.format(lit(fx.SYSLOG_5424)), 0.90)),
        (f"startswith({RAW}, '<') and {matches(RAW, fx.SYSLOG_3164)}",
         _verdict("syslog_rfc3164", "'Generic-Syslog'", group.format(lit(fx.SYSLOG_3164)), 0.85)),
        (f"contains({RAW}, '=') and {contains_any(LOWER, fx.KEY_VALUE_MARKS)}",
         _fixed("proprietary", "Unknown-Vendor", "Proprietary-Appliance", 0.70)),
        default=_fixed("unknown", "Unknown", "Unknown-Device", 0.50),
    )


def detect_format(df: DataFrame) -> DataFrame:
    """Add ``detection`` (detected_format, vendor, product, confidence)."""
    lines = df if OBJ in df.columns else prepare_lines(df)
    rest = [c for c in lines.columns if c != LOWER]
    return lines.selectExpr(*rest, apart(LOWER), f"{_detection()} as detection")


def apply_hints(df: DataFrame) -> DataFrame:
    """Detected vendor and product fill in only where the source gave none."""
    rest = [c for c in df.columns if c not in ("vendor", "product", "detection", "detected_format")]
    filled = {n: f"case when {n} = 'unknown' then detection.{n} else {n} end" for n in ("vendor", "product")}
    return fenced(df, filled | {
        "detected_format": "detection.detected_format", "detection_confidence": "detection.confidence"}, rest)


def route_parser(df: DataFrame, definitions: list[Definition] | None = None) -> DataFrame:
    """Add ``_route`` (place of the first matching parser, null when none matches), ``_shape``
    (the form of its lines), ``parser_used`` and ``parser_version``.

    Built-in and published parsers form one lazy CASE, so a pattern of the catalogue runs only
    on lines no earlier parser took; the catalogue needs no join with the lines.
    """
    parsers = ordered_parsers(definitions)
    route = case(*[(p.match, str(i)) for i, p in enumerate(parsers)])
    rest = [c for c in df.columns if c != LOWER]
    split = df.selectExpr(*rest, apart(LOWER), f"case when {RAW} != '' then {route} end as _found")
    return with_shape(fenced(split, {"_route": "_found"}, df.columns), parsers)


def with_shape(df: DataFrame, parsers) -> DataFrame:
    """Parser identity and line shape for a known ``_route``."""
    place = {shape.name: i for i, shape in enumerate(shape_list(parsers))}
    arms = []
    for i, p in enumerate(parsers):
        for condition, shape in p.shapes:
            arms.append((f"_route = {i}" + (f" and {condition}" if condition else ""), str(place[shape.name])))
    ids = ", ".join(lit(p.parser_id) for p in parsers)
    versions = ", ".join(lit(p.version) for p in parsers)
    return df.selectExpr(
        "*",
        f"{case(*arms)} as _shape",
        f"coalesce(get(array({ids}), _route), {lit(fx.ONBOARDING_QUEUE)}) as parser_used",
        f"get(array({versions}), _route) as parser_version",
    )
