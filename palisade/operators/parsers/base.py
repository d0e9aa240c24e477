"""What a line parser is, and the columns it works on.

A parser is declared by SQL expressions only. The parse operator evaluates all parsers in
one pass over the data, in layers, so that each costly expression (a regex run, a JSON
parse) sits in one projected column and is computed once per line:

``_shape``       which declaration a line follows; a vendor may send several shapes
``_tok``         array of captured header parts
``_keys, _vals`` key=value pairs, merged to the map ``_kv``
``_sub``         array of captures taken from a token
fields           one place per known field, read from the columns above, ``_members`` or ``_obj``
own              map of further named fields
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from palisade.functions.text import case, coalesce, lit

# Fields the normaliser reads, all as text at this stage.
SLOTS = [
    "src_ip", "src_port", "src_hostname", "src_mac", "src_zone",
    "dst_ip", "dst_port", "dst_hostname", "dst_mac", "dst_zone",
    "protocol", "direction", "app_name", "service",
    "bytes_in", "bytes_out", "bytes", "packets_in", "packets_out",
    "severity", "severity_id", "status", "status_id", "disposition_id",
    "action", "activity_name", "activity_id", "rule_name", "rule_id", "message",
    "device_vendor", "device_product", "device_version",
    "time_text", "time_number", "target_class_uid",
    "has_signature", "signature", "signature_id", "category",
]
# Fields a plain text pair must not fill: they count only as numbers set by a parser.
NUMBER_ONLY = {"severity_id", "status_id", "disposition_id", "target_class_uid", "time_number", "has_signature"}
PAIR_NAMES = {name: name for name in SLOTS if name not in NUMBER_ONLY} | {"time_text": "timestamp"}

# Working columns of a line.
RAW, LOWER, VENDOR, OBJ, TOKENS, PAIRS, SUBS = "_raw", "_lower", "vendor", "_obj", "_tok", "_kv", "_sub"
# The JSON object's own members as texts: read from the object once, where every path would search it again.
MEMBERS = "_members"


def tok(i: int) -> str:
    return f"get({TOKENS}, {i})"


def sub(i: int) -> str:
    return f"get({SUBS}, {i})"


def kv(*names: str) -> str:
    """Value of the first of these keys that the pair map holds."""
    return coalesce(*[f"try_element_at({PAIRS}, {lit(n)})" for n in names])


def has(name: str) -> str:
    return f"coalesce(map_contains_key({PAIRS}, {lit(name)}), false)"


def _member(path: str) -> str | None:
    """The name of one of the object's own members, null for a deeper path."""
    found = re.fullmatch(r"\$(?:\.(\w+)|\['([^']+)'\])", path)
    return found and (found[1] or found[2])


def _variant(path: str) -> str:
    return f"try_variant_get({OBJ}, {lit(path)}, 'variant')"


def json(path: str) -> str:
    name = _member(path)
    return f"try_element_at({MEMBERS}, {lit(name)})" if name else f"try_variant_get({OBJ}, {lit(path)}, 'string')"


def json_has(path: str) -> str:
    name = _member(path)
    return f"coalesce(map_contains_key({MEMBERS}, {lit(name)}), false)" if name else f"({_variant(path)} is not null)"


def json_token(path: str) -> str:
    """JSON text of a member: strings keep their quotes, so numbers can be told apart."""
    return case((json_has(path), f"to_json({_variant(path)})")) if _member(path) else f"to_json({_variant(path)})"


def json_truthy(*paths: str) -> str:
    """First member that is not null, empty, zero or false."""
    return coalesce(*[case((f"{json(p)} not in ('', '0', 'false')", json(p))) for p in paths])


def blocked_id(condition: str) -> str:
    """Disposition code of a blocked / allowed verdict."""
    return case((condition, "2"), default="1")


@dataclass(frozen=True)
class Shape:
    """One form of line: how it is cut and which field comes from where."""

    name: str
    fields: dict[str, str]
    tokens: str | None = None
    keys: str | None = None
    values: str | None = None
    subs: str | None = None
    own: dict[str, str] = field(default_factory=dict)
    error: str | None = None


@dataclass(frozen=True)
class Parser:
    """Identity, match condition and the shapes (with conditions, the last one open) of a parser."""

    parser_id: str
    vendor: str
    product: str
    format: str
    match: str
    shapes: list[tuple[str | None, Shape]]
    version: str = "1.0.0"


def parser(identity: tuple, match: str, *shapes: Shape | tuple[str, Shape], **more) -> Parser:
    listed = [(None, s) if isinstance(s, Shape) else s for s in shapes]
    return Parser(*identity, match=match, shapes=listed, **more)


ShapeBuilder = Callable[[], Shape]
