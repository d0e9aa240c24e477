"""JSON lines: Suricata EVE, Zeek conn, and any other JSON object."""

from __future__ import annotations

from palisade import fixed_values as fx
from palisade.functions.text import case, coalesce, concat, contains_any, isin, lit, to_long, truthy
from palisade.functions.values import lookup
from palisade.operators.parsers.base import (
    MEMBERS, OBJ, RAW, Shape, blocked_id, has, json, json_has, json_token, json_truthy, kv, parser,
)

BRACED = f"(startswith({RAW}, '{{') and endswith({RAW}, '}}'))"
_NOT_JSON = case((f"{OBJ} is null", "'invalid JSON'"))


def _is_text(token: str) -> str:
    return f"startswith({token}, '\"')"


def _time_fields(path: str) -> dict[str, str]:
    """A time member is a number of seconds / milliseconds or a text."""
    token = json_token(path)
    return {
        "time_number": case((f"not {_is_text(token)}", f"try_cast({token} as double)")),
        "time_text": case((_is_text(token), json(path))),
    }


# --- Suricata ---------------------------------------------------------------------------

_KIND = case((json_has("$.event_type"), json("$.event_type")), default="'flow'")
_IS_ALERT = f"(coalesce({json('$.event_type')} = 'alert', false) and {json_has('$.alert')})"
_ALERT_ACTION = case((json_has("$.alert.action"), json("$.alert.action")), default="'allowed'")
_LEVEL = case((json_has("$.alert.severity"), f"try_cast({json_token('$.alert.severity')} as int)"), default="3")


_SURICATA_ERROR = coalesce(_NOT_JSON, case((f"not {_is_text(json_token('$.proto'))}", "'proto is not a text'")))
_SURICATA_FIELDS = {
    "device_vendor": "'Suricata'",
    "device_product": "'EVE-IDS'",
    **_time_fields("$.timestamp"),
    "src_ip": json("$.src_ip"),
    "src_port": json("$.src_port"),
    "dst_ip": json_truthy("$.dest_ip", "$.dst_ip"),
    "dst_port": json_truthy("$.dest_port", "$.dst_port"),
    "protocol": f"upper({coalesce(json('$.proto'), lit('TCP'))})",
    "app_name": json("$.app_proto"),
}
_SURICATA_OWN = {
    "event_type": _KIND,
    "flow_id": json("$.flow_id"),
    "in_iface": json("$.in_iface"),
}

SURICATA = parser(
    fx.BUILT_IN_PARSERS[4],
    f"({BRACED} and contains({RAW}, 'event_type') and {contains_any(RAW, ['flow_id', 'src_ip', 'alert'])})",
    (_IS_ALERT, Shape(
        "suricata_alert",
        error=_SURICATA_ERROR,
        fields=_SURICATA_FIELDS | {
            "message": case(
                (json_has("$.alert.signature"), json("$.alert.signature")), default="'Suricata Alert'"),
            "target_class_uid": "2001",
            "has_signature": "'1'",
            "signature": json("$.alert.signature"),
            "signature_id": json("$.alert.signature_id"),
            "category": json("$.alert.category"),
            "severity_id": coalesce(lookup(fx.SURICATA_SEVERITY, _LEVEL), "1"),
            "action": _ALERT_ACTION,
            "disposition_id": blocked_id(isin(_ALERT_ACTION, fx.SURICATA_BLOCK)),
        },
        own=_SURICATA_OWN | {"target_class": "'Security Finding'"},
    )),
    Shape(
        "suricata_other",
        error=_SURICATA_ERROR,
        fields=_SURICATA_FIELDS | {
            "message": concat("'Suricata '", _KIND, "' event'"),
            "target_class_uid": "4001",
            "severity_id": "1",
            "action": "'allow'",
            "disposition_id": "1",
            "dst_hostname": case(
                (json_has("$.dns"), json("$.dns.rrname")), (json_has("$.http"), json("$.http.hostname"))),
            "bytes_in": json("$.flow.bytes_toclient"),
            "bytes_out": json("$.flow.bytes_toserver"),
            "packets_in": json("$.flow.pkts_toclient"),
            "packets_out": json("$.flow.pkts_toserver"),
        },
        own=_SURICATA_OWN | {
            "target_class": "'Network Activity'",
            "http_hostname": json("$.http.hostname"),
            "http_url": json("$.http.url"),
            "http_method": json("$.http.http_method"),
            "http_status": json("$.http.status"),
            "dns_query": json("$.dns.rrname"),
            "dns_type": json("$.dns.rrtype"),
        },
    ),
)

# --- Zeek -------------------------------------------------------------------------------

_SRC = json_truthy("$['id.orig_h']", "$.src_ip", "$.orig_h")
_DST = json_truthy("$['id.resp_h']", "$.dst_ip", "$.resp_h")
_SRC_PORT = json_truthy("$['id.orig_p']", "$.src_port", "$.orig_p")
_DST_PORT = json_truthy("$['id.resp_p']", "$.dst_port", "$.resp_p")
_REJECTED = isin(f"upper({json('$.conn_state')})", fx.ZEEK_REJECTED)


def _no_number(x: str) -> str:
    return f"({x} is not null and {to_long(x)} is null)"


def _shown(x: str) -> str:
    return coalesce(x, "'None'")


ZEEK = parser(
    fx.BUILT_IN_PARSERS[5],
    f"({BRACED} and ({contains_any(RAW, ['id.orig_h', 'id.resp_h'])}"
    f" or (contains({RAW}, 'ts') and contains({RAW}, 'conn_state'))))",
    Shape(
        "zeek",
        error=coalesce(
            _NOT_JSON,
            case((f"{_no_number(_SRC_PORT)} or {_no_number(_DST_PORT)}", "'port is not a number'"))),
        fields={
            "device_vendor": "'Zeek'",
            "device_product": "'Network-Monitor'",
            **_time_fields("$.ts"),
            "src_ip": _SRC,
            "src_port": to_long(_SRC_PORT),
            "dst_ip": _DST,
            "dst_port": to_long(_DST_PORT),
            "protocol": f"upper({coalesce(truthy(json('$.proto')), lit('TCP'))})",
            "service": json("$.service"),
            "app_name": json("$.service"),
            "bytes_out": json_truthy("$.orig_bytes", "$.orig_ip_bytes"),
            "bytes_in": json_truthy("$.resp_bytes", "$.resp_ip_bytes"),
            "action": case((_REJECTED, "'reject'"), default="'allow'"),
            "disposition_id": blocked_id(_REJECTED),
            "severity_id": case((_REJECTED, "2"), default="1"),
            "message": concat(
                "'Zeek connection '", _shown(_SRC), "':'", _shown(_SRC_PORT),
                "' -> '", _shown(_DST), "':'", _shown(_DST_PORT)),
        },
        own={name: json(f"$.{name}") for name in ("uid", "service", "duration", "conn_state", "history")},
    ),
)

# --- generic JSON -----------------------------------------------------------------------


def _first_present(names: list[str]) -> str:
    """Value of the first key the object has, even when that value is null."""
    return case(*[(has(name), kv(name)) for name in names])


def _number_member(name: str) -> str:
    """An integer member; the same digits as text do not count."""
    token = json_token(f"$.{name}")
    return case((f"{token} rlike '^-?[0-9]+$'", token))


_ACTION = f"lower({coalesce(case((has('action'), kv('action')), default=kv('act')), lit('allow'))})"

GENERIC_JSON = parser(
    fx.BUILT_IN_PARSERS[9],
    BRACED,
    Shape(
        "json",
        keys=f"map_keys({MEMBERS})",
        values=f"map_values({MEMBERS})",
        error=_NOT_JSON,
        fields={
            "device_vendor": case((has("vendor"), kv("vendor")), default="'Generic-JSON'"),
            "device_product": case((has("product"), kv("product")), default="'JSON-Telemetry'"),
            "message": coalesce(json_truthy("$.message", "$.msg"), "'JSON Event'"),
            "src_ip": _first_present(fx.JSON_SRC_IP),
            "dst_ip": _first_present(fx.JSON_DST_IP),
            "src_port": to_long(_first_present(fx.JSON_SRC_PORT)),
            "dst_port": to_long(_first_present(fx.JSON_DST_PORT)),
            "protocol": f"upper({_first_present(fx.JSON_PROTOCOL)})",
            "disposition_id": blocked_id(isin(_ACTION, fx.JSON_BLOCK)),
            "severity_id": _number_member("severity_id"),
            "status_id": _number_member("status_id"),
            "target_class_uid": _number_member("target_class_uid"),
            **_time_fields("$.timestamp"),
        },
    ),
)
