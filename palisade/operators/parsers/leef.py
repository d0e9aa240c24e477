"""Log Event Extended Format 1.0 / 2.0, and Fortinet FortiOS, which sends LEEF or pairs."""

from __future__ import annotations

from palisade import fixed_values as fx
from palisade.functions.text import (
    all_matches, case, coalesce, concat, contains_any, is_digits, isin, lit, strip, to_long, truthy,
)
from palisade.functions.values import by_floor, by_words, lookup
from palisade.operators.parsers.base import LOWER, RAW, SUBS, TOKENS, VENDOR, Shape, kv, parser, tok

_VERSION = strip(f"replace({tok(0)}, 'LEEF:', '')")


def _attributes() -> str:
    """``key=value`` items, split by the declared delimiter, else tab, else by loose matching."""
    declared = f"(startswith({_VERSION}, '2.0') and size({TOKENS}) >= 7)"
    spec, tab = tok(5), lit("\t")
    code = f"try_cast(conv(replace(replace({spec}, '0x', ''), 'x', ''), 16, 10) as bigint)"
    delimiter = case(
        (f"not {declared} or {spec} = ''", tab),
        (f"{spec} rlike '^(0x|x)[0-9a-fA-F]{{1,2}}$'", f"chr({code})"),
        (f"{spec} rlike '^(0x|x)'", tab),
        default=spec,
    )
    start = f"if({declared}, 7, 6)"
    extension = f"concat_ws('|', slice({TOKENS}, {start}, greatest(size({TOKENS}) - {start} + 1, 0)))"
    # The lambda names the two long expressions once instead of repeating their text.
    cut = (
        "case when p.x = '' then cast(array() as array<string>)"
        f" when contains(p.x, p.d) then split(p.x, concat({lit(chr(92) + 'Q')}, p.d, {lit(chr(92) + 'E')}))"
        f" when contains(p.x, {tab}) then split(p.x, {tab})"
        f" else {all_matches('p.x', fx.LEEF_LOOSE_PAIR, 0)} end"
    )
    items = f"get(transform(array(named_struct('x', {extension}, 'd', {delimiter})), p -> {cut}), 0)"
    return f"filter({items}, i -> contains(i, '='))"


_ACTION = kv("action", "act")
_WORD = f"lower({_ACTION})"
_DISPOSITION = case(
    (isin(_WORD, fx.LEEF_BLOCK), "2"),
    (f"{isin(_WORD, fx.CEF_ALLOW)} or {truthy(kv('disposition'))} is null", "1"))
_LEVEL = strip(coalesce(truthy(kv("sev")), kv("severity"), "''"))
_NAMES = [strip(tok(i)) for i in (1, 2, 4)]

_KEY_PART = "substring_index(i, '=', 1)"
_VALUE_PART = "substring(i, instr(i, '=') + 1)"
_CUT = dict(
    tokens=f"split(substring({RAW}, instr({RAW}, 'LEEF:')), '[|]')",
    subs=_attributes(),
    keys=f"transform({SUBS}, i -> {strip(_KEY_PART)})",
    values=f"transform({SUBS}, i -> {strip(_VALUE_PART)})",
    error=case((
        f"size({TOKENS}) < 5",
        f"concat('Malformed LEEF header: too few pipe segments (', size({TOKENS}), ')')")),
    own={"leef_version": _VERSION, "event_id_raw": strip(tok(4)), "user_name": kv("usrName")},
)
_FIELDS = {
    "device_vendor": coalesce(kv("device_vendor"), _NAMES[0]),
    "device_product": coalesce(kv("device_product"), _NAMES[1]),
    "device_version": coalesce(kv("device_version"), strip(tok(3))),
    "message": coalesce(kv("message"), f"concat_ws(' ', {', '.join(_NAMES)})"),
    "src_ip": kv("src"),
    "dst_ip": kv("dst"),
    "src_port": to_long(kv("srcPort")),
    "dst_port": to_long(kv("dstPort")),
    "protocol": kv("proto"),
    "src_mac": kv("srcMAC"),
    "dst_mac": kv("dstMAC"),
    "action": _ACTION,
    "rule_id": kv("policyid"),
    "rule_name": concat("'Policy-'", kv("policyid")),
    "bytes": to_long(kv("totalBytes")),
    "disposition_id": _DISPOSITION,
    "severity_id": case(
        (is_digits(_LEVEL), by_floor(to_long(_LEVEL), fx.LEEF_SEVERITY_FLOORS, 1)),
        (f"{truthy(kv('severity'))} is null", case((f"{_DISPOSITION} = 2", "3"), default="1"))),
}

LEEF = parser(fx.BUILT_IN_PARSERS[8], f"contains({RAW}, 'LEEF:')", Shape("leef", fields=_FIELDS, **_CUT))

# --- Fortinet FortiOS ------------------------------------------------------------------------

_NUMBER = strip(kv("proto"))
_FORTI_ACT = f"lower({kv('action')})"
_FORTI_LEVEL = f"lower({kv('level')})"
_FORTI_LEEF = Shape(
    "fortinet_leef", fields=_FIELDS | {"device_vendor": "'Fortinet'", "device_product": "'FortiOS'"}, **_CUT)
_FORTI_PAIRS = Shape(
    "fortinet_pairs",
    keys=all_matches(RAW, fx.QUOTED_KV, 1),
    values=all_matches(RAW, fx.QUOTED_KV, 2),
    fields={
        "device_vendor": coalesce(kv("device_vendor"), "'Fortinet'"),
        "device_product": coalesce(kv("device_product"), "'FortiOS'"),
        "message": coalesce(kv("message"), RAW),
        "src_ip": kv("srcip"),
        "dst_ip": kv("dstip"),
        "src_port": to_long(kv("srcport")),
        "dst_port": to_long(kv("dstport")),
        "protocol": coalesce(lookup(fx.FORTINET_PROTOCOLS, _NUMBER), f"upper({_NUMBER})"),
        "rule_id": kv("policyid"),
        "rule_name": concat("'Policy-'", kv("policyid")),
        "app_name": kv("service", "app"),
        "bytes_out": to_long(kv("sentbyte")),
        "bytes_in": to_long(kv("rcvdbyte")),
        "disposition_id": case((isin(_FORTI_ACT, fx.FORTINET_BLOCK), "2"), (f"{kv('action')} is not null", "1")),
        "severity_id": case(
            (f"{kv('level')} is not null", coalesce(by_words(_FORTI_LEVEL, fx.FORTINET_LEVELS), "1")),
            (isin(_FORTI_ACT, fx.FORTINET_BLOCK), "3")),
    },
)

FORTINET = parser(
    fx.BUILT_IN_PARSERS[2],
    f"({contains_any(LOWER, fx.FORTINET_MARKS)} or lower({VENDOR}) = 'fortinet')",
    (f"contains({RAW}, 'LEEF:')", _FORTI_LEEF),
    _FORTI_PAIRS,
)
