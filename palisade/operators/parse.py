"""Parse routed lines: every parser's expressions in one pass over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame

from palisade import fixed_values as fx
from palisade.functions.text import apart, case, coalesce, isin, lit, pairs_to_map
from palisade.operators.detect import apply_hints, detect_format, route_parser, with_shape
from palisade.operators.parsers import Definition, ordered_parsers, shape_list
from palisade.operators.parsers.base import PAIR_NAMES, PAIRS, SLOTS, SUBS, TOKENS, Shape

_LONG = {"src_port", "dst_port", "bytes_in", "bytes_out", "bytes", "packets_in", "packets_out"}
_INT = {"severity_id", "status_id", "disposition_id", "target_class_uid", "activity_id"}


def _by_shape(shapes: list[Shape], part) -> str | None:
    """CASE over the line shapes; shapes with the same expression share one branch."""
    grouped: dict[str, list[int]] = {}
    for i, shape in enumerate(shapes):
        expression = part(shape)
        if expression is not None:
            grouped.setdefault(expression, []).append(i)
    if not grouped:
        return None
    return case(*[(isin("_shape", places), expression) for expression, places in grouped.items()])


def _layer(shapes: list[Shape], name: str, kind: str) -> str:
    return f"cast({_by_shape(shapes, lambda s: getattr(s, name)) or 'null'} as {kind})"


def _own_map(shape: Shape) -> str | None:
    if not shape.own:
        return None
    return "map(" + ", ".join(f"{lit(n)}, cast({x} as string)" for n, x in shape.own.items()) + ")"


def _field(shapes: list[Shape], name: str) -> str:
    """A field: the shape's expression, else the equally named pair of a pairs line."""
    kind = "bigint" if name in _LONG else "int" if name in _INT else "double" if name == "time_number" else "string"

    def typed(shape: Shape) -> str | None:
        expression = shape.fields.get(name)
        return None if expression is None else f"try_cast({expression} as {kind})"

    parts = [p for p in [_by_shape(shapes, typed)] if p]
    if name in PAIR_NAMES:
        parts.append(f"try_cast(try_element_at({PAIRS}, {lit(PAIR_NAMES[name])}) as {kind})")
    if name == "has_signature":
        paired = f"coalesce(map_contains_key({PAIRS}, 'signature') or map_contains_key({PAIRS}, 'alert'), false)"
        return f"({coalesce(*parts, 'null')} is not null or {paired})" if parts else paired
    return coalesce(*parts) if parts else f"cast(null as {kind})"


_UNMAPPED = case(
    ("_own is null and _kv is null", "cast(map() as map<string,string>)"),
    default=(
        "map_concat("
        "map_filter(coalesce(_own, cast(map() as map<string,string>)),"
        " (k, v) -> v is not null and not coalesce(map_contains_key(_kv, k), false)),"
        " map_filter(coalesce(_kv, cast(map() as map<string,string>)),"
        f" (k, v) -> v is not null and not {isin('k', fx.KNOWN_KEYS)}))"
    ),
)


def parse_lines(df: DataFrame, definitions: list[Definition] | None = None) -> DataFrame:
    """Parsed fields as ``ir_*`` columns, the rest in ``unmapped``, failures in ``parse_errors``.

    A failed parse leaves the fields empty and lowers the confidence; the event goes on.
    """
    shapes = shape_list(ordered_parsers(definitions))
    lines = [c for c in df.columns if c != "_shape"]
    df = df.selectExpr(*lines, apart("_shape"), f"{_layer(shapes, 'tokens', 'array<string>')} as {TOKENS}")
    df = df.selectExpr(*lines, TOKENS, apart("_shape"), f"{_layer(shapes, 'subs', 'array<string>')} as {SUBS}")
    df = df.selectExpr(
        *lines, TOKENS, SUBS, apart("_shape"),
        f"{_layer(shapes, 'keys', 'array<string>')} as _keys",
        f"{_layer(shapes, 'values', 'array<string>')} as _vals",
        f"{_layer(shapes, 'error', 'string')} as _error",
    )
    # A failed line keeps no pairs and no shape, so every field expression yields null.
    rest = [c for c in df.columns if c not in ("_shape", "_keys", "_vals")]
    df = df.selectExpr(
        *rest,
        "case when _error is null then _shape end as _shape",
        f"case when _error is null then {pairs_to_map('_keys', '_vals')} end as {PAIRS}",
    )
    fields = ", ".join(f"{lit('ir_' + name)}, {_field(shapes, name)}" for name in SLOTS)
    failure = "concat('Parsing error in ', parser_used, ': ', _error)"
    df = df.selectExpr(
        "*",
        f"named_struct({fields}, 'parse_errors', array_compact(array({failure}))) as _fields",
        f"{_by_shape(shapes, _own_map)} as _own",
    )
    df = df.selectExpr("*", f"{_UNMAPPED} as unmapped").drop(TOKENS, SUBS, PAIRS, "_own", "_shape")
    # The fields leave through a generator, see ``fenced``. The lambda stops the pruning of
    # single fields, which could leave a projection without a lambda but still too large.
    return df.selectExpr(
        *[c for c in df.columns if c not in ("_fields", "_error")],
        "case when _error is null then 1.0D else 0.5D end as confidence",
        f"{lit(fx.MAPPING_VERSION)} as mapping_version",
        "inline(transform(array(_fields), f -> f))",
    )


def parse_with(df: DataFrame, parser_id: str, definitions: list[Definition] | None = None) -> DataFrame:
    """Dry run of one parser on given payloads: success, parsed fields, errors.

    ``df`` has raw_payload and, optionally, vendor and product. The parser runs whether or
    not it would have been routed to.
    """
    parsers = ordered_parsers(definitions)
    places = [i for i, p in enumerate(parsers) if p.parser_id == parser_id]
    if not places:
        raise ValueError(f"Parser {parser_id} not found")
    for name in ("vendor", "product"):
        if name not in df.columns:
            df = df.selectExpr("*", f"'unknown' as {name}")
    lines = apply_hints(detect_format(df))
    routed = with_shape(lines.selectExpr("*", f"{places[-1]} as _route"), parsers)
    parsed = parse_lines(routed, definitions)
    keep = [c for c in df.columns if c not in ("vendor", "product")]
    fields = ", ".join(f"{lit(n)}, ir_{n}" for n in SLOTS)
    return parsed.selectExpr(
        *keep, "vendor", "product", "detected_format", "parser_used", "parser_version", "confidence", "parse_errors",
        f"named_struct({fields}, 'unmapped', unmapped) as parsed_fields",
        "size(parse_errors) = 0 as success",
    )


def route_and_parse(df: DataFrame, definitions: list[Definition] | None = None) -> DataFrame:
    """Envelope rows -> detected, routed and parsed rows."""
    return parse_lines(route_parser(apply_hints(detect_format(df)), definitions), definitions)
