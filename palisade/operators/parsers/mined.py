"""Parsers published from mined templates: a pattern plus field rules, both data."""

from __future__ import annotations

from dataclasses import dataclass

from palisade import fixed_values as fx
from palisade.functions.text import captures, case, coalesce, isin, lit, matches, strip, to_long, truthy
from palisade.operators.parsers.base import NUMBER_ONLY, RAW, SLOTS, Parser, Shape, blocked_id, parser, tok


@dataclass(frozen=True)
class Rule:
    """Copies a named group to a field, with an optional transform and default."""

    field_name: str
    target_ocsf_field: str
    transform: str | None = None
    default_value: str | None = None

    @property
    def gives_integer(self) -> bool:
        return (self.transform or "").lower() in ("to_int", "int", "integer")


@dataclass(frozen=True)
class Definition:
    """One published parser: ``groups`` names the pattern's groups in order."""

    parser_id: str
    vendor: str
    product: str
    version: str
    pattern: str
    groups: tuple[str, ...]
    rules: tuple[Rule, ...]
    target_class_uid: int = fx.CLASS_NETWORK_ACTIVITY
    status: str = "ACTIVE"


def _transformed(value: str, rule: Rule) -> str:
    kind = (rule.transform or "").lower()
    if rule.gives_integer:
        return f"cast(coalesce({to_long(value)}, 0) as string)"
    if kind in ("to_float", "float"):
        return f"cast(coalesce(try_cast({value} as double), 0D) as string)"
    if kind in ("to_upper", "upper"):
        return f"upper({value})"
    if kind in ("to_lower", "lower"):
        return f"lower({value})"
    return strip(value) if kind == "trim" else value


def _rule_values(definition: Definition) -> dict[str, str]:
    """Field -> value; of several rules for a field the last one with a value wins."""
    place = {name: i for i, name in enumerate(definition.groups)}
    found: dict[str, list[str]] = {}
    for rule in definition.rules:
        value = truthy(tok(place[rule.field_name])) if rule.field_name in place else "cast(null as string)"
        if rule.default_value is not None:
            value = coalesce(value, lit(rule.default_value))
        result = case((f"{value} is not null", _transformed(value, rule)))
        found.setdefault(rule.target_ocsf_field, []).insert(0, result)
    return {name: coalesce(*values) for name, values in found.items()}


def mined_parser(definition: Definition) -> Parser:
    """A parser from its catalogue entry."""
    values = _rule_values(definition)
    integers = {r.target_ocsf_field for r in definition.rules if r.gives_integer}
    fields = {
        "device_vendor": lit(definition.vendor),
        "device_product": lit(definition.product),
        "message": RAW,
        "disposition_id": "1",
    }
    for target, value in values.items():
        name = "time_text" if target == "timestamp" else target
        if name in SLOTS and (name not in NUMBER_ONLY or name in integers):
            fields[name] = coalesce(value, fields[name]) if name in fields else value
    marks = [values[n] for n in ("signature", "alert") if n in values]
    if marks:
        fields["has_signature"] = case((f"{coalesce(*marks)} is not null", "'1'"))
    if "action" in values:
        action = values["action"]
        blocked = isin(f"lower({action})", fx.MINED_BLOCK)
        fields["disposition_id"] = case((f"{action} is null", fields["disposition_id"]), default=blocked_id(blocked))
        fields["severity_id"] = case(
            (f"{action} is null", fields.get("severity_id", "null")), (blocked, "3"), default="1")
    shape = Shape(
        f"mined {definition.parser_id} {definition.version}",
        tokens=captures(RAW, definition.pattern, len(definition.groups)),
        error=case((
            f"{tok(0)} is null", lit(f"Payload does not match dynamic template: {definition.pattern}"))),
        fields=fields,
        own={name: v for name, v in values.items() if name not in fx.KNOWN_KEYS}
        | {"template_str": lit(definition.pattern)},
    )
    identity = (definition.parser_id, definition.vendor, definition.product, "proprietary")
    return parser(identity, matches(RAW, definition.pattern), shape, version=definition.version)
