"""Check Point Firewall-1 messages."""

from __future__ import annotations

from palisade import fixed_values as fx
from palisade.functions.text import all_matches, case, coalesce, contains_any, isin, to_long
from palisade.operators.parsers.base import LOWER, RAW, VENDOR, Shape, blocked_id, kv, parser

_BLOCKED = isin(f"lower({kv('action')})", fx.CHECKPOINT_BLOCK)

CHECKPOINT = parser(
    fx.BUILT_IN_PARSERS[3],
    f"({contains_any(LOWER, fx.CHECKPOINT_LOWER_MARKS)} or lower({VENDOR}) = 'checkpoint')",
    Shape(
        "checkpoint",
        keys=all_matches(RAW, fx.CHECKPOINT_KV, 1),
        values=all_matches(RAW, fx.CHECKPOINT_KV, 2),
        fields={
            "device_vendor": coalesce(kv("device_vendor"), "'Checkpoint'"),
            "device_product": coalesce(kv("device_product"), "'Firewall-1'"),
            "message": coalesce(kv("message"), RAW),
            "src_ip": kv("src"),
            "dst_ip": kv("dst"),
            "src_port": to_long(kv("s_port")),
            "dst_port": to_long(kv("service")),
            "protocol": f"upper({kv('proto')})",
            "rule_name": kv("rule_name", "rule"),
            "disposition_id": blocked_id(_BLOCKED),
            "severity_id": case((_BLOCKED, "3"), default="1"),
        },
        own={"service_name": case((f"{to_long(kv('service'))} is null", kv("service")))},
    ),
)
