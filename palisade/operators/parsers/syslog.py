"""Generic syslog lines, RFC 5424 and RFC 3164."""

from __future__ import annotations

from palisade import fixed_values as fx
from palisade.functions.text import captures, case, coalesce, concat, contains_any, ipv4_list, matches, strip, truthy
from palisade.functions.values import lookup
from palisade.operators.parsers.base import RAW, Shape, blocked_id, parser, sub, tok

_PRIORITY = f"try_cast({tok(0)} as int)"
_FACILITY = f"shiftright({_PRIORITY}, 3)"
_CODE = f"({_PRIORITY} & 7)"


def _present(i: int) -> str:
    return f"nullif({truthy(tok(i))}, '-')"


RFC5424 = parser(
    fx.BUILT_IN_PARSERS[10],
    matches(RAW, fx.SYSLOG_5424),
    Shape(
        "rfc5424",
        tokens=captures(RAW, fx.SYSLOG_5424, 8),
        subs=ipv4_list(tok(7)),
        error=case((f"{tok(0)} is null", "'Not a valid RFC 5424 syslog message'")),
        fields={
            "device_vendor": "'Generic-Syslog'",
            "device_product": coalesce(_present(3), "'RFC5424'"),
            "severity_id": lookup(fx.SYSLOG_5424_SEVERITY, _CODE),
            "time_text": _present(1),
            "src_hostname": _present(2),
            "app_name": _present(3),
            "message": coalesce(strip(truthy(tok(7))), concat("'Syslog '", tok(3), "' event'")),
            "action": "'allow'",
            "disposition_id": "1",
            "src_ip": sub(0),
            "dst_ip": sub(1),
        },
        own={
            "facility": _FACILITY,
            "severity_code": _CODE,
            "proc_id": _present(4),
            "msg_id": _present(5),
            "structured_data": _present(6),
        },
    ),
)

_BLOCKED = contains_any(f"lower({tok(4)})", fx.SYSLOG_3164_BLOCK)

RFC3164 = parser(
    fx.BUILT_IN_PARSERS[11],
    matches(RAW, fx.SYSLOG_3164),
    Shape(
        "rfc3164",
        tokens=captures(RAW, fx.SYSLOG_3164, 5),
        subs=ipv4_list(tok(4)),
        error=case((f"{tok(0)} is null", "'Not a valid RFC 3164 syslog message'")),
        fields={
            "device_vendor": "'Generic-Syslog'",
            "device_product": tok(3),
            "severity_id": case((_BLOCKED, "3"), (f"{_CODE} >= 6", "1"), (f"{_CODE} >= 4", "3"), default="4"),
            "time_text": tok(1),
            "src_hostname": tok(2),
            "app_name": tok(3),
            "message": strip(tok(4)),
            "action": case((_BLOCKED, "'deny'"), default="'allow'"),
            "disposition_id": blocked_id(_BLOCKED),
            "src_ip": sub(0),
            "dst_ip": sub(1),
        },
        own={"facility": _FACILITY, "severity_code": _CODE},
    ),
)
