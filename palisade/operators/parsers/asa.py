"""Cisco ASA / FTD firewall messages."""

from __future__ import annotations

from palisade import fixed_values as fx
from palisade.functions.text import captures, case, coalesce, contains_any, ipv4_list, lit, matches, truthy
from palisade.functions.values import lookup
from palisade.operators.parsers.base import RAW, Shape, blocked_id, parser, sub, tok

# Body forms in the order they are tried: tag, pattern, group count, group number per field.
FORMS = [
    ("built", fx.ASA_BUILT, 9, dict(
        direction=1, protocol=2, connection=3, src_zone=4, src_ip=5, src_port=6, dst_zone=7, dst_ip=8, dst_port=9)),
    ("teardown", fx.ASA_TEARDOWN, 11, dict(
        direction=1, protocol=2, connection=3, src_zone=4, src_ip=5, src_port=6, dst_zone=7, dst_ip=8, dst_port=9,
        duration=10, bytes=11)),
    ("deny", fx.ASA_DENY, 8, dict(
        protocol=1, src_zone=2, src_ip=3, src_port=4, dst_zone=5, dst_ip=6, dst_port=7, rule=8)),
    ("denied", fx.ASA_DENIED, 8, dict(
        direction=1, protocol=2, src_ip=3, src_port=4, dst_ip=5, dst_port=6, flags=7, src_zone=8)),
    ("nat", fx.ASA_NAT, 7, dict(
        protocol=1, src_zone=2, src_ip=3, src_port=4, dst_zone=5, dst_ip=6, dst_port=7)),
]
BODY = tok(3)
TAG = sub(0)


def _form_captures() -> str:
    """Tag of the body form followed by its captures; loose lines give their addresses."""
    forms = [f"concat(array({lit(tag)}), {captures(BODY, pattern, n)})" for tag, pattern, n, _ in FORMS]
    changed = f"filter({ipv4_list(BODY)}, (ip, i) -> i = 0 or ip != get({ipv4_list(BODY)}, i - 1))"
    return coalesce(*forms, f"concat(array('loose'), {changed})")


def _field(name: str, *extra: tuple[str, str]) -> str:
    """The capture that holds a field, for whichever form the body has."""
    arms = [(f"{TAG} = {lit(tag)}", truthy(sub(g[name]))) for tag, _, _, g in FORMS if name in g]
    return case(*arms, *extra)


_LOOSE_BLOCK = f"({TAG} = 'loose' and {contains_any(f'lower({BODY})', ['denied', 'deny'])})"
_BLOCKED = f"({TAG} in ('deny', 'denied') or {_LOOSE_BLOCK})"

_DEFAULT_PROTOCOL = case((f"{TAG} = 'denied'", "'TCP'"))

_SHAPE = Shape(
    "asa",
    tokens=captures(RAW, fx.ASA_HEADER, 4),
    subs=_form_captures(),
    error=case((f"{tok(0)} is null", "'No Cisco ASA/FTD message code found'")),
    fields={
        "device_vendor": "'Cisco'",
        "device_product": "'ASA'",
        "message": RAW,
        "severity_id": case(
            (f"{TAG} = 'deny'", "3"), (f"{TAG} = 'denied'", "4"),
            default=coalesce(lookup(fx.ASA_SEVERITY, f"try_cast({tok(1)} as int)"), "1")),
        "direction": case(
            (f"{TAG} in ('built', 'teardown', 'denied')", coalesce(f"lower({_field('direction')})", "'inbound'"))),
        "protocol": f"upper({coalesce(_field('protocol'), _DEFAULT_PROTOCOL)})",
        "src_zone": _field("src_zone"),
        "src_ip": _field("src_ip", (f"{TAG} = 'loose'", sub(1))),
        "src_port": _field("src_port"),
        "dst_zone": _field("dst_zone"),
        "dst_ip": _field("dst_ip", (f"{TAG} = 'loose'", sub(2))),
        "dst_port": _field("dst_port"),
        "bytes": _field("bytes"),
        "rule_name": case((f"{TAG} = 'deny'", coalesce(_field("rule"), "'access-group'"))),
        "action": case((_BLOCKED, "'deny'"), (f"{TAG} = 'teardown'", "'close'"), default="'allow'"),
        "disposition_id": blocked_id(_BLOCKED),
    },
    own={
        "facility": tok(0),
        "cisco_severity": f"try_cast({tok(1)} as int)",
        "cisco_message_id": tok(2),
        "message_body": BODY,
        "connection_id": _field("connection"),
        "duration": _field("duration"),
        "tcp_flags": _field("flags"),
    },
)

ASA = parser(
    fx.BUILT_IN_PARSERS[0],
    f"({contains_any(RAW, ['%ASA-', '%FTD-'])} and {matches(RAW, fx.ASA_CODE)})",
    _SHAPE,
)
