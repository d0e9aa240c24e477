"""Squid proxy access log."""

from __future__ import annotations

from palisade import fixed_values as fx
from palisade.functions.text import (
    captures, case, coalesce, concat, contains_any, is_digits, item, lit, matches, to_long, truthy,
)
from palisade.operators.parsers.base import RAW, TOKENS, Shape, blocked_id, parser, sub, tok

_CACHE = f"substring_index({tok(3)}, '/', 1)"
_CODE_TEXT = case((f"contains({tok(3)}, '/')", f"substring_index({tok(3)}, '/', -1)"), default="'200'")
_CODE = coalesce(f"try_cast({_CODE_TEXT} as int)", "200")
_BLOCKED = f"(contains({_CACHE}, 'DENIED') or {_CODE} in (403, 401))"
_URL = tok(6)
_PEER = item(f"split({tok(8)}, '/')", 1)
_DOTTED_QUAD = r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"


def _number(x: str) -> str:
    return case((is_digits(x), x), default="'0'")


SQUID = parser(
    fx.BUILT_IN_PARSERS[6],
    f"({contains_any(RAW, fx.SQUID_MARKS)} or {matches(RAW, fx.SQUID_LINE)})",
    Shape(
        "squid",
        # The strict line and the loose one have the same fields at the same blank-separated places.
        tokens=f"split({RAW}, {lit(chr(92) + 's+')})",
        subs=captures(_URL, fx.URL_HOST, 2),
        error=case((
            f"size({TOKENS}) < 7 or size(split({tok(3)}, '/')) > 2", "'Cannot parse Squid proxy access line'")),
        fields={
            "device_vendor": "'Squid'",
            "device_product": "'Proxy'",
            "src_ip": tok(2),
            "bytes_out": _number(tok(4)),
            "protocol": "'TCP'",
            "app_name": "'HTTP'",
            "action": case((_BLOCKED, "'deny'"), default="'allow'"),
            "disposition_id": blocked_id(_BLOCKED),
            "severity_id": case((_BLOCKED, "3"), default="1"),
            "message": concat("'Squid '", tok(5), "' '", _URL, "' -> '", _CODE_TEXT, "' ('", _CACHE, "')'"),
            "dst_hostname": sub(0),
            "dst_port": case((
                f"{sub(0)} is not null",
                coalesce(to_long(truthy(sub(1))), case((f"startswith({_URL}, 'https')", "443"), default="80")))),
            "dst_ip": case((matches(_PEER, _DOTTED_QUAD), _PEER)),
        },
        own={
            "http_method": tok(5),
            "http_url": _URL,
            "http_status": _CODE,
            "cache_status": _CACHE,
            "elapsed_ms": _number(tok(1)),
        },
    ),
)
