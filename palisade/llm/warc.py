"""WARC derivatives: linked metadata and plain-text conversion records of response records, in SQL functions alone.

Both records refer to the response by its id, and repeat its target, date and payload digest; the metadata record also keeps the HTTP
headers of its source. Digests are SHA-1 in base 32 of the bytes; ids are derived from the source's id, kind and payload, so a rerun
gives the same records.

A response without payload has an empty payload and still gets both records. A null target or header counts as empty; a response
without an id gets one from its target, date and payload. Repeated responses give repeated records.
"""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import fresh

#: The date of records whose source names none.
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"

#: Patterns that leave the text of a page (a form that both Java's and RE2's expressions read alike).
DROPPED = "(?is)<!--.*?-->|<script[ \\t\\r\\n/>].*?</script[ \\t\\r\\n]*>|<script>.*?</script[ \\t\\r\\n]*>|<style[^>]*>.*?</style[ \\t\\r\\n]*>|<head[^>]*>.*?</head[ \\t\\r\\n]*>"
BREAKS = "(?i)</?(p|br|div|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|main|title|blockquote|pre)([ \\t\\r\\n/][^>]*)?>"
TAGS = "<[a-zA-Z/!][^>]*>"
TITLE = "(?is)<title[^>]*>(.*?)</title"
LANG = "(?is)<html[^>]* lang=\"([^\">]*)\""
#: What opens and closes the hidden elements, and whether the opening is a tag that must end first.
PAIRED = (("!--", "-->", False), ("script", "</script[ \\t\\r\\n]*>", False), ("style", "</style[ \\t\\r\\n]*>", True), ("head", "</head[ \\t\\r\\n]*>", True))
#: Openings of a kind from which a page is searched to its end, at most.
FEW = 16
#: Characters of a page that is searched without more ado: at worst for about a second.
SHORT = 16_384
_LOW = "\ufdd0low"
#: Stands behind the < of an opening that nothing closes; no character of any text.
_OPEN = "\ufdd0"
#: A link's tag up to the value of its first href, quoted in any way or not; the value with its quotes. Attributes before
#: it are passed whole.
_VALUE = "(?:\"[^\"]*+\"|'[^']*+'|[^\\s\"'>][^\\s>]*+)"
#: A tag without one matches as well, with no value, so that what it holds is not searched again.
LINK = f"(?i)<a(?=[\\s/])(?:[\\s/]*+(?!href[\\s=])[^\\s>/=]++(?:\\s*+=\\s*+{_VALUE})?+)*+[\\s/]*+(?:href\\s*+=\\s*+({_VALUE}))?+"
#: HTML's named references (without the ampersand, most with a semicolon); a no-break space counts as a space here. A map
#: is searched from its front, so the usual names come first.
_USUAL = [*(f"{k};" for k in (
    "lt", "gt", "quot", "apos", "nbsp", "amp", "copy", "middot", "mdash", "ndash", "hellip", "rsquo", "lsquo", "rdquo", "ldquo", "raquo", "laquo", "bull", "reg", "trade", "times")),
    *(f"{k};" for k in name2codepoint)]
NAMED = {k: html5[k].replace("\xa0", " ") for k in [*(k for k in _USUAL if k in html5), *html5]}
#: Names that need no semicolon, longest first.
BARE = sorted((k for k in NAMED if k[-1] != ";"), key=lambda k: (-len(k), k))
#: Numbers that name another character: those of Windows, and others that HTML replaces.
RENUMBERED = {0: "\ufffd", 13: "\r", 160: " "} | {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}
_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(text: Column) -> Column:
    """The SHA-1 of the text's bytes in base 32: forty bits, ten hex digits, give eight characters."""
    digest = F.sha1(text.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), *_BASE32)


def record_id(*keys: Column) -> Column:
    """A urn:uuid from the keys' SHA-1, in the form of a name-based id."""
    h = F.sha1(F.concat_ws("\n", *keys).cast("binary"))
    piece = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), piece(1, 8), F.lit("-"), piece(9, 4), F.lit("-5"), piece(14, 3), F.lit("-a"), piece(18, 3),
                    F.lit("-"), piece(21, 12), F.lit(">"))


def _map(pairs: dict) -> Column:
    """A constant map of texts."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in pairs.items())), F.lit("\x02"), F.lit("\x01"))


def _numbered(reference: Column) -> Column:
    """The character of a numeric reference (#8212; or #x2014;); none for a control character or a noncharacter."""
    is_hex = F.lower(F.substring(reference, 2, 1)) == "x"
    digits = F.regexp_extract(reference, "^#[xX]?0*([0-9a-fA-F]*)", 1)
    whole = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).cast("int")
    number = F.when(digits == "", 0).when(F.length(digits) > 7, 0x110000).otherwise(whole)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    low = number.bitwiseAND(0xFFFF)
    none = number.between(1, 8) | number.isin(11, 127) | number.between(14, 31) | number.between(0xFDD0, 0xFDEF) | (low >= 0xFFFE)
    return F.when((number > 0x10FFFF) | number.between(0xD800, 0xDFFF), "\ufffd").when(
        F.array_contains(F.array(*map(F.lit, RENUMBERED)), number), _map(RENUMBERED)[number.cast("string")]).when(none, "").otherwise(char)


def _decoded(text: Column, attribute: bool = False) -> Column:
    """The text with its character references decoded, each once, from left to right.

    In an attribute a name without semicolon that a letter, a digit or an equals sign follows is no reference.
    """
    named = _map(NAMED)

    def read(piece: Column) -> Column:
        closed = F.regexp_extract(piece, "^[A-Za-z][A-Za-z0-9]*;", 0)
        bare = F.regexp_extract(piece, f"^(?:{'|'.join(BARE)}){'(?![A-Za-z0-9=])' if attribute else ''}", 0)
        number = F.regexp_extract(piece, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)
        rest = lambda n: F.substring(piece, n + 1, F.length(piece))
        return F.coalesce(
            F.when(F.startswith(piece, F.lit("#")) & (number != ""), F.concat(_numbered(number), rest(F.length(number)))),
            F.when(closed != "", F.concat(named[closed], rest(F.instr(piece, ";")))),
            F.when(bare != "", F.concat(named[bare], rest(F.length(bare)))), F.concat(F.lit("&"), piece))

    # The text stands here once: what a lambda names is evaluated once.
    return F.array_join(F.transform(F.split(text, "&"), lambda piece, i: F.when(i == 0, piece).otherwise(read(piece))), "")


def _let(value: Column, body) -> Column:
    """body(value), with the value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _many(low: Column, opening: str) -> Column:
    """Whether the lower-cased page has so many of these openings that searching on from each would tell."""
    return F.length(low) - F.length(F.replace(low, F.lit(f"<{opening}"), F.lit(""))) > FEW * (1 + len(opening))


def _closed(text: Column, low: Column, opening: str, closing: str, tag: bool) -> Column:
    """The text with a mark in each opening that no closing follows. A pattern from opening to closing would look for one to the end of
    the page from each of them in turn; of the openings left every one is closed, so the pattern reads the page once. With few openings
    (as counted in the lower-cased page) nothing is marked, and nothing else changes."""

    def parted(t: Column) -> Column:
        head = F.regexp_extract(t, f"(?is)^(.*){closing}", 1)
        head = F.regexp_extract(head, "(?s)^(.*>)", 1) if tag else head
        return _let(F.length(head), lambda n: F.concat(
            F.substring(t, F.lit(1), n), F.regexp_replace(F.substring(t, n + 1, F.length(t)), f"(?i)<({opening})", f"<{_OPEN}$1")))

    return _let(text, lambda t: F.when(_many(low, opening), parted(t)).otherwise(t))


def _read_tags(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAGS, "")


def _without_tags(text: Column) -> Column:
    """Block elements break lines, other tags vanish; nothing behind the last > is a tag, and is not searched if it is long."""

    def parted(t: Column) -> Column:
        return _let(F.length(F.regexp_extract(t, "(?s)^(.*>)", 1)), lambda n: F.concat(
            _read_tags(F.substring(t, F.lit(1), n)), F.substring(t, n + 1, F.length(t))))

    return _let(text, lambda t: F.when(F.length(F.substring_index(t, ">", -1)) < FEW * FEW, _read_tags(t)).otherwise(parted(t)))


def _by_length(html: Column, short: Column, long: Column) -> Column:
    """Two ways to one result: a short page cannot be searched long, whatever stands open in it."""
    return F.when(F.length(html) <= SHORT, short).otherwise(long)


def plain_text(html: Column, low: Column | None = None) -> Column:
    """Text of a page: hidden elements go, block elements break lines, other tags vanish, blanks collapse.

    ``low`` is the page in lower case, where a column has it already.
    """
    closed, low = html, F.lower(html) if low is None else low
    for opening, closing, tag in PAIRED:
        closed = _closed(closed, low, opening, closing, tag)
    shown = F.replace(F.regexp_replace(closed, DROPPED, " "), F.lit(f"<{_OPEN}"), F.lit("<"))
    bare = _by_length(html, _read_tags(F.regexp_replace(html, DROPPED, " ")), _without_tags(shown))
    text = F.regexp_replace(_decoded(bare), "[ \\t\\r\\f]+", " ")
    return F.regexp_replace(F.regexp_replace(text, " ?\\n[ \\n]*", "\n"), "^[ \\n]+|[ \\n]+$", "")


def _title(html: Column, low: Column) -> Column:
    found = F.replace(F.regexp_extract(_closed(html, low, "title", "</title", True), TITLE, 1), F.lit(f"<{_OPEN}"), F.lit("<"))
    return _by_length(html, F.regexp_extract(html, TITLE, 1), found)


def _language(html: Column) -> Column:
    """Of the first html tag that names one, which mostly is the first of all; a tag that does not end, ends with the page."""
    tag, named = F.lit("(?is)<html[^>]*>"), F.lit(f"(?is)^{LANG[5:]}")
    page = F.concat(html, F.lit(">"))
    others = F.filter(F.regexp_extract_all(page, tag, 0), lambda t: F.regexp_like(t, named))
    first = _let(F.regexp_extract(page, "(?is)<html[^>]*>", 0), lambda t: F.when(F.regexp_like(t, named), t).otherwise(F.get(others, F.lit(0))))
    return _by_length(html, F.regexp_extract(html, LANG, 1), F.coalesce(F.regexp_extract(first, LANG, 1), F.lit("")))


def responses_of_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Crawled pages as response records: page_id, record_id, target_uri, date, http_headers, payload."""
    payload, target = (F.coalesce(F.col(c), F.lit("")) for c in (html, url))
    key = F.coalesce(F.col(page_id).cast("string"), F.lit(""))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                       F.octet_length(payload).cast("string"), F.lit(CRLF))
    return pages.select(F.col(page_id).alias("page_id"), record_id(F.lit("response"), key, target, payload).alias("record_id"),
                        target.alias("target_uri"), F.lit(DATE).alias("date"), headers.alias("http_headers"), payload.alias("payload"))


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows for each response (record_id, target_uri, date, http_headers, payload; other columns are kept in front).

    record_type, derived_id, refers_to, target_uri, date, content_type, payload_digest (of the source), block_digest,
    content_length, header, block.
    """
    own = ("record_type", "derived_id", "refers_to", "content_type", "payload_digest", "block_digest", "content_length", "header", "block")
    others = [c for c in responses.columns if c not in ("record_id", "target_uri", "date", "http_headers", "payload")]
    names = dict(zip(own, fresh(responses.select(*others), *own), strict=True))
    payload, target = F.coalesce("payload", F.lit("")), F.coalesce("target_uri", F.lit(""))
    date, headers = F.coalesce("date", F.lit(DATE)), F.coalesce("http_headers", F.lit(""))
    row = [F.struct(*others).alias("row_")] if others else []
    kept = ["row_"] if others else []
    lowered = responses.withColumn(_LOW, F.when(F.length(payload) > SHORT, F.lower(payload)))
    low = F.col(_LOW)
    source = lowered.select(
        *row, F.coalesce("record_id", record_id(F.lit("response"), target, date, payload)).alias("refers_to_"),
        target.alias("target_uri"), date.alias("date"), headers.alias("headers_"), payload.alias("payload_"),
        F.concat(F.lit("sha1:"), base32_sha1(payload)).alias("digest_"), plain_text(payload, low).alias("text_"),
        plain_text(F.concat(F.lit("<p>"), _title(payload, low))).alias("title_"))
    links = F.transform(F.filter(F.regexp_extract_all("payload_", F.lit(LINK), 1), lambda v: v != ""), lambda v: F.regexp_replace(v, "^[\"']|[\"']$", ""))
    block = F.concat(
        F.lit("title: "), F.replace("title_", F.lit("\n"), F.lit(" ")), F.lit(f"{CRLF}language: "), _language(F.col("payload_")),
        F.lit(f"{CRLF}sourcePayloadDigest: "), F.col("digest_"), F.lit(f"{CRLF}sourceLength: "), F.octet_length("payload_").cast("string"),
        F.lit(f"{CRLF}textLength: "), F.octet_length("text_").cast("string"), F.lit(CRLF),
        F.array_join(F.transform(links, lambda u: F.concat(F.lit("outlink: "), _decoded(u, attribute=True), F.lit(CRLF))), ""),
        F.array_join(F.transform(F.filter(F.split("headers_", CRLF), lambda h: h != ""), lambda h: F.concat(
            F.lit("sourceHeader: "), h, F.lit(CRLF))), ""))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("type"), block.alias("block")),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain; charset=utf-8").alias("type"), F.col("text_").alias("block")))
    rows = source.select("*", F.inline(kinds)).select(
        *kept, F.col("kind").alias(names["record_type"]), record_id("kind", "refers_to_", "digest_").alias(names["derived_id"]),
        F.col("refers_to_").alias(names["refers_to"]), "target_uri", "date", F.col("type").alias(names["content_type"]),
        F.col("digest_").alias(names["payload_digest"]), F.concat(F.lit("sha1:"), base32_sha1(F.col("block"))).alias(names["block_digest"]),
        F.octet_length("block").cast("long").alias(names["content_length"]), F.col("block").alias(names["block"]))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), names["record_type"], F.lit(f"{CRLF}WARC-Record-ID: "), names["derived_id"],
        F.lit(f"{CRLF}WARC-Refers-To: "), names["refers_to"], F.lit(f"{CRLF}WARC-Target-URI: "), "target_uri",
        F.lit(f"{CRLF}WARC-Date: "), "date", F.lit(f"{CRLF}WARC-Block-Digest: "), names["block_digest"],
        F.lit(f"{CRLF}Content-Type: "), names["content_type"], F.lit(f"{CRLF}Content-Length: "),
        F.col(names["content_length"]).cast("string"), F.lit(CRLF))
    rows = rows.withColumn(names["header"], header)
    return rows.select("row_.*", *rows.columns[1:]) if others else rows


def write_warc(records: DataFrame, path: str) -> None:
    """Derivatives as WARC files: header, blank line, block, and the two line ends that part records."""
    records.select(F.concat("header", F.lit(CRLF), "block").alias("record")).write.option("lineSep", CRLF * 2).text(path)
