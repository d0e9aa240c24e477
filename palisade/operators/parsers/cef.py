"""Common Event Format, and Palo Alto PAN-OS, which sends CEF, CSV or plain pairs."""

from __future__ import annotations

from palisade import fixed_values as fx
from palisade.functions.text import (
    all_matches, captures, case, coalesce, concat, contains_any, is_digits, isin, lit, matches, strip, to_long, truthy,
)
from palisade.functions.values import by_floor, by_words
from palisade.operators.parsers.base import LOWER, RAW, TOKENS, VENDOR, Shape, blocked_id, kv, parser, tok

# A header part that may hold backslash escapes; possessive, so long parts cannot overflow the stack.
_PART = r"([^|\\]*+(?:\\[\s\S][^|\\]*+)*+)"
_ESCAPED_HEADER = "^" + _PART + (r"\|" + _PART) * 6 + r"\|([\s\S]*)$"
# A key from its first letter, in one step: a word without a '=' behind it is looked at once, not from each of its letters.
_KEY = "(?<![a-zA-Z0-9_])[a-zA-Z0-9_]++"


def _header_parts() -> str:
    """Seven header parts and the extension; fewer elements when pipes are missing."""
    event = f"substring({RAW}, instr({RAW}, 'CEF:'))"
    escape, pair = lit(r"\\([\s\S])"), lit(r"\\[\s\S]")
    parts = captures(event, _ESCAPED_HEADER, 8)
    escaped = coalesce(
        f"transform({parts}, (p, i) -> if(i < 7, regexp_replace(p, {escape}, '$1'), p))",
        f"split(regexp_replace({event}, {pair}, ''), {lit('[|]')}, 8)")
    return case((f"contains({event}, {lit(chr(92))})", escaped), default=f"split({event}, {lit('[|]')}, 8)")


def _extension_values() -> str:
    """Values of the extension: each runs to the next ``key=`` and is unescaped."""
    text = strip(tok(7))
    delimiter = lit(rf"\s*+{_KEY}=\s*+")
    values = f"slice(split({text}, {delimiter}), 2, {2**30})"
    unescaped = "v"
    for old, new in (("\\=", "="), ("\\|", "|"), ("\\\\", "\\"), ("\\n", "\n")):
        unescaped = f"replace({unescaped}, {lit(old)}, {lit(new)})"
    return case((f"contains({text}, {lit(chr(92))})", f"transform({values}, v -> {unescaped})"), default=values)


_ACTION = kv("act", "action")
_WORD = f"lower({_ACTION})"
_SEVERITY_TEXT = strip(coalesce(kv("severity_raw"), tok(6)))

_CUT = dict(
    tokens=_header_parts(),
    keys=all_matches(strip(tok(7)), f"({_KEY})=", 1),
    values=_extension_values(),
    error=case((
        f"size({TOKENS}) < 8",
        f"concat('Malformed CEF header: expected 7 pipes, found ', size({TOKENS}) - 1)")),
    own={
        "cef_version": strip(f"replace({tok(0)}, 'CEF:', '')"),
        "device_event_class_id": strip(tok(4)),
        "severity_raw": strip(tok(6)),
    },
)
_FIELDS = {
    "device_vendor": coalesce(kv("device_vendor"), strip(tok(1))),
    "device_product": coalesce(kv("device_product"), strip(tok(2))),
    "device_version": coalesce(kv("device_version"), strip(tok(3))),
    "message": coalesce(kv("message"), strip(tok(5))),
    "src_ip": kv("src"),
    "dst_ip": kv("dst"),
    "src_port": to_long(kv("spt")),
    "dst_port": to_long(kv("dpt")),
    "protocol": kv("proto"),
    "action": kv("act"),
    "bytes_in": to_long(kv("in")),
    "bytes_out": to_long(kv("out")),
    "app_name": kv("app"),
    "src_hostname": kv("shost"),
    "dst_hostname": kv("dhost"),
    "src_mac": kv("smac"),
    "dst_mac": kv("dmac"),
    "rule_name": kv("cs1", "deviceCustomString1"),
    "severity_id": case(
        (is_digits(_SEVERITY_TEXT), by_floor(to_long(_SEVERITY_TEXT), fx.CEF_SEVERITY_FLOORS, 1)),
        default=by_words(f"lower({_SEVERITY_TEXT})", fx.CEF_SEVERITY_WORDS)),
    "disposition_id": case(
        (isin(_WORD, fx.CEF_BLOCK), "2"),
        (f"{isin(_WORD, fx.CEF_ALLOW)} or {truthy(kv('disposition'))} is null", "1")),
}

CEF = parser(fx.BUILT_IN_PARSERS[7], f"contains({RAW}, 'CEF:')", Shape("cef", fields=_FIELDS, **_CUT))

# --- Palo Alto PAN-OS ---------------------------------------------------------------------

_PANOS_NAME = {"device_vendor": "'Palo Alto Networks'", "device_product": "'PAN-OS'"}
_PANOS_CEF = Shape(
    "panos_cef",
    fields=_FIELDS | _PANOS_NAME | {
        "disposition_id": blocked_id(isin(f"lower({coalesce(truthy(_ACTION), kv('act'))})", fx.PANOS_CEF_BLOCK))},
    **_CUT,
)


def _cell(i: int) -> str:
    return strip(tok(i))


def _port_cell(first: int, second: int) -> str:
    return case((is_digits(_cell(first)), _cell(first)), (is_digits(_cell(second)), _cell(second)), default="'0'")


_CSV_ACTION = coalesce(_cell(30), _cell(14))
_PANOS_CSV = Shape(
    "panos_csv",
    tokens=f"split({RAW}, ',')",
    fields=_PANOS_NAME | {
        "src_ip": _cell(7),
        "dst_ip": _cell(8),
        "src_port": _port_cell(24, 9),
        "dst_port": _port_cell(25, 10),
        "protocol": f"upper({coalesce(_cell(29), _cell(13))})",
        "action": _CSV_ACTION,
        "rule_name": _cell(11),
        "app_name": _cell(14),
        "message": concat("'PAN-OS '", _cell(3), "' '", _CSV_ACTION, "' '", _cell(7), "'->'", _cell(8)),
        "disposition_id": blocked_id(isin(f"lower({_CSV_ACTION})", fx.PANOS_CSV_BLOCK)),
    },
    own={"log_type": _cell(3)},
)
_PANOS_PAIRS = Shape(
    "panos_pairs",
    keys=all_matches(RAW, fx.PANOS_KV, 1),
    values=all_matches(RAW, fx.PANOS_KV, 2),
    fields=_PANOS_NAME | {"message": RAW},
)

PANOS = parser(
    fx.BUILT_IN_PARSERS[1],
    f"({contains_any(LOWER, fx.PANOS_MARKS)} or contains({RAW}, {lit(fx.PANOS_CSV_MARK)})"
    f" or lower({VENDOR}) = 'palo alto')",
    (f"contains({RAW}, 'CEF:')", _PANOS_CEF),
    (f"{contains_any(RAW, ['TRAFFIC', 'THREAT'])} and size(split({RAW}, ',')) >= 15", _PANOS_CSV),
    _PANOS_PAIRS,
)
