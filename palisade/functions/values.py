"""Value expressions: code tables, word lists, protocols, IPv4 arithmetic, times, ids."""

from __future__ import annotations

from palisade import fixed_values as fx
from palisade.functions.text import case, coalesce, is_digits, isin, lit, matches, strip, to_long

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_STRICT = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def lookup(table: dict, key: str) -> str:
    """Value of a small fixed table, null for an unknown key."""
    pairs = ", ".join(f"{lit(k)}, {lit(v)}" for k, v in table.items())
    return f"try_element_at(map({pairs}), {key})"


def by_words(word: str, table: dict[int, list[str]]) -> str:
    """The code whose word list holds the word, null when none does."""
    return case(*[(isin(word, words), str(code)) for code, words in table.items()])


def by_floor(number: str, floors: list[tuple[int, int]], default: int) -> str:
    """The code of the highest floor the number reaches."""
    return case(*[(f"{number} >= {floor}", str(code)) for floor, code in floors], default=str(default))


def protocol_name(protocol: str) -> str:
    """Protocol name: digits resolve to a name, null and '' to TCP, other names stay."""
    text = strip(f"upper({protocol})")
    names = {n: name for name, n in fx.PROTOCOL_NUMBERS.items()}
    number = f"try_cast({text} as int)"
    return case(
        (f"coalesce({protocol}, '') = ''", "'TCP'"),
        (is_digits(text), coalesce(lookup(names, number), f"concat('PROTO-', {to_long(text)})")),
        default=text,
    )


def protocol_number(protocol: str) -> str:
    """Protocol number: digits stand for themselves, unknown names keep number 6."""
    text = strip(f"upper({protocol})")
    return case(
        (f"coalesce({protocol}, '') = ''", "6"),
        (is_digits(text), f"try_cast({text} as int)"),
        default=coalesce(lookup(fx.PROTOCOL_NUMBERS, text), "6"),
    )


def ipv4_to_long(ip: str) -> str:
    """Dotted quad to integer, null unless it is a well-formed IPv4 address."""
    octets = [f"cast(get(split({ip}, '[.]'), {i}) as bigint)" for i in range(4)]
    total = " + ".join(f"{octet} * {256 ** (3 - i)}" for i, octet in enumerate(octets))
    return case((matches(ip, IPV4_STRICT), total))


def long_to_ipv4(n: str) -> str:
    """Integer to dotted quad."""
    return "concat_ws('.', " + ", ".join(f"cast(shiftright({n}, {s}) & 255 as string)" for s in (24, 16, 8, 0)) + ")"


def network_bounds(network: str) -> tuple[int, int]:
    """First and last address of a CIDR network as integers."""
    base, length = network.split("/")
    first = 0
    for octet in base.split("."):
        first = first * 256 + int(octet)
    return first, first + (1 << (32 - int(length))) - 1


def in_networks(n: str, networks: list[str]) -> str:
    """Whether an integer address falls in one of a few fixed networks."""
    spans = [network_bounds(network) for network in networks]
    return "(" + (" or ".join(f"{n} between {low} and {high}" for low, high in spans) or "false") + ")"


def is_private(n: str, networks=None, exceptions=None) -> str:
    networks = fx.PRIVATE_NETWORKS if networks is None else networks
    exceptions = fx.PRIVATE_EXCEPTIONS if exceptions is None else exceptions
    return f"({in_networks(n, networks)} and not {in_networks(n, exceptions)})"


def is_loopback(n: str) -> str:
    return in_networks(n, [fx.LOOPBACK_NETWORK])


def plain_utc(ts: str) -> str:
    """Zone-less UTC reading of a timestamp, independent of the session time zone."""
    return f"timestampadd(MICROSECOND, unix_micros({ts}), {_EPOCH})"


def utc_timestamp(ntz: str) -> str:
    """A zone-less timestamp read as UTC, independent of the session time zone."""
    return f"timestamp_micros(timestampdiff(MICROSECOND, {_EPOCH}, {ntz}))"


def utc_text(ts: str) -> str:
    """ISO-8601 UTC text of a timestamp."""
    plain = f"cast({plain_utc(ts)} as string)"
    fraction = f"if(length({plain}) > 19, rpad(substring({plain}, 20), 7, '0'), '')"
    return f"concat(translate(substring({plain}, 1, 19), ' ', 'T'), {fraction}, '+00:00')"


def utc_date(ts: str) -> str:
    """UTC calendar date of a timestamp."""
    return f"cast({plain_utc(ts)} as date)"


def epoch_millis(ts: str) -> str:
    """Epoch milliseconds the way a float clock truncates them (seconds as double, times 1000)."""
    return f"cast(floor(unix_micros({ts}) / 1000000D * 1000D) as bigint)"


def stable_uuid(*parts: str) -> str:
    """A UUID-shaped id that depends only on its parts, so a replay gives the same id."""
    whole = ", ".join(f"coalesce(cast({p} as string), '')" for p in parts)
    return f"get(transform(array(sha2(concat_ws('\\u0001', {whole}), 256)), h -> {_UUID_FORM}), 0)"


_UUID_FORM = (
    "concat(substring(h, 1, 8), '-', substring(h, 9, 4), '-8', substring(h, 13, 3), '-a', substring(h, 16, 3),"
    " '-', substring(h, 19, 12))"
)
