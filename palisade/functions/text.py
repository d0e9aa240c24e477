"""Text expressions: literals, trimming, captures, key=value maps, IPv4 lists, sanitising."""

from __future__ import annotations

from palisade import fixed_values as fx

# Unicode white space as Python's str.strip() sees it; SQL trim() only knows the blank.
WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_SEPARATOR = "\u0001"


def lit(value) -> str:
    """SQL literal of a Python value."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(value)


def strip(x: str) -> str:
    """Remove leading and trailing white space, Unicode included."""
    return f"btrim({x}, {lit(WHITE_SPACE)})"


def last_key_wins(spark) -> None:
    """Read JSON objects that repeat a key by the key's last value, as most readers do, instead of refusing them."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def truthy(x: str) -> str:
    """The text itself, or null when it is empty."""
    return f"nullif({x}, '')"


def coalesce(*xs: str) -> str:
    return xs[0] if len(xs) == 1 else f"coalesce({', '.join(xs)})"


def concat(*xs: str) -> str:
    return f"concat({', '.join(xs)})"


def is_digits(x: str) -> str:
    return f"({x} rlike '^[0-9]+$')"


def matches(x: str, pattern: str) -> str:
    return f"({x} rlike {lit(pattern)})"


def to_long(x: str) -> str:
    return f"try_cast({x} as bigint)"


def isin(x: str, values) -> str:
    return f"({x} in ({', '.join(lit(v) for v in values)}))"


def contains_any(x: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def case(*arms: tuple[str, str], default: str | None = None) -> str:
    """CASE over (condition, value) pairs."""
    body = " ".join(f"when {condition} then {value}" for condition, value in arms)
    return f"case {body}{f' else {default}' if default is not None else ''} end"


def item(array: str, position: int) -> str:
    """Element at a 0-based position, null when out of range."""
    return f"get({array}, {position})"


def captures(text: str, pattern: str, groups: int) -> str:
    """Groups of the first match as an array (absent group = ''), null without a match.

    One replacement run delivers all groups; regexp_extract would run the pattern once
    per group. Text that already holds the separator takes the slower, exact way.
    """
    refs = _SEPARATOR.join(f"${i + 1}" for i in range(groups))
    whole = rf"^[\s\S]*?(?:{pattern})[\s\S]*$"
    fast = f"split(regexp_replace({text}, {lit(whole)}, {lit(refs)}), {lit(_SEPARATOR)}, {groups})"
    exact = "array(" + ", ".join(f"regexp_extract({text}, {lit(pattern)}, {i + 1})" for i in range(groups)) + ")"
    chosen = case((f"contains({text}, {lit(_SEPARATOR)})", exact), default=fast)
    return case((matches(text, pattern), chosen))


def pairs_to_map(keys: str, values: str) -> str:
    """Two parallel array columns to a map in which the last duplicate key wins.

    Duplicates are removed here instead of by the session-wide map-key policy; lines
    without duplicates, the normal case, skip that step.
    """
    kept = (
        f"filter(sequence(1, size({keys})), i -> "
        f"not array_contains(slice({keys}, i + 1, size({keys})), element_at({keys}, i)))"
    )

    def pick(array: str) -> str:
        return f"transform({kept}, i -> element_at({array}, i))"

    return case(
        (f"{keys} is null", "null"),
        (f"size({keys}) = 0", "cast(map() as map<string,string>)"),
        (f"size(array_distinct({keys})) = size({keys})", f"map_from_arrays({keys}, {values})"),
        default=f"map_from_arrays({pick(keys)}, {pick(values)})",
    )


def all_matches(text: str, pattern: str, group: int) -> str:
    return f"regexp_extract_all({text}, {lit(pattern)}, {group})"


def ipv4_list(text: str) -> str:
    """All dotted quads in the text, in order."""
    return all_matches(text, fx.IPV4_IN_TEXT, 0)


def sanitize_text(x: str, max_length: int = 512) -> str:
    """Control characters to blanks, stripped, cut at ``max_length`` with an ellipsis."""
    control = "[\\x00-\\x1f\\x7f-\\x9f]"
    clean = strip(f"regexp_replace(coalesce({x}, ''), {lit(control)}, ' ')")
    return case((f"length({clean}) > {max_length}", f"concat(left({clean}, {max_length}), '...')"), default=clean)


def apart(column: str) -> str:
    """Pass a column through a lambda, which keeps its projection out of whole-stage code.

    A projection with dozens of CASE branches fused into one whole-stage method is too large
    for the JIT compiler and runs interpreted. A projection that holds a lambda is generated
    on its own instead, cut into many small methods that do get compiled. Only this cheap
    column goes through the lambda.
    """
    return f"get(transform(array({column}), v -> v), 0) as {column}"


def fenced(df, columns: dict[str, str], keep: list[str]):
    """Add computed columns through a generator.

    The optimiser substitutes a plain projected column into every filter or join key that
    refers to it, which for the long expressions here means evaluating them again below (and,
    for chains of them, plans that explode). Generator output is never substituted.
    """
    packed = ", ".join(f"{lit(name)}, {x}" for name, x in columns.items())
    return df.selectExpr(*keep, f"named_struct({packed}) as _packed").selectExpr(*keep, "inline(array(_packed))")
