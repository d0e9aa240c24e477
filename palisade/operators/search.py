"""Search over the event table: facet predicates, ip and text match, total, page, counts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade import fixed_values as fx
from palisade.functions.stem import stem
from palisade.functions.text import lit

_WORD_GAP = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class SearchResult:
    """``total``: one row with the count of all matches; ``page``: the asked-for rows."""

    total: DataFrame
    page: DataFrame


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def phrase_match(column: str, phrase: str) -> str:
    """Whether the words of the phrase occur one after the other (case-insensitive, unstemmed)."""
    text = f"concat(' ', regexp_replace(lower(coalesce({column}, '')), {lit(_WORD_GAP)}, ' '), ' ')"
    return f"contains({text}, {lit(' ' + ' '.join(_words(phrase)) + ' ')})"


def terms_match(column: str, query: str) -> str:
    """Whether any word of the query occurs."""
    wanted = ", ".join(lit(w) for w in _words(query)) or "cast(null as string)"
    return f"arrays_overlap(split(lower(coalesce({column}, '')), {lit(_WORD_GAP)}), array({wanted}))"


def _stems(words: list[str]) -> list[str]:
    """The stems of a query's words. As an expression over literals the stemmer would run again for every row."""
    row = SparkSession.active().range(1).selectExpr(f"array({', '.join(stem(lit(w)) for w in words)}) as stems").first()
    return row["stems"]


def _beginning(stem: str) -> str:
    """What every word of the stem begins with: stemming changes a stem's last two letters at most."""
    return stem[:max(1, len(stem) - 2)]


def stemmed_phrase_match(column: str, phrase: str) -> str:
    """Whether words of the phrase's stems occur one after the other.

    A text is first searched for words that begin as the phrase's stems do; only what is found there is stemmed.
    """
    wanted = _words(phrase)
    if not wanted:
        return "false"
    word = r"[\p{L}\p{N}]"
    stems = _stems(wanted)
    parts = (word + "*+" + _WORD_GAP).join(_beginning(s) for s in stems)
    pattern = lit(f"(?<!{word})(?=({parts}{word}*+))")
    found = f"regexp_extract_all(lower(coalesce({column}, '')), {pattern}, 1)"
    return f"exists({found}, c -> transform(split(c, {lit(_WORD_GAP)}), x -> {stem('x')}) = array({', '.join(lit(s) for s in stems)}))"


def stemmed_terms_match(column: str, query: str) -> str:
    """Whether a word of the stem of any of the query's words occurs."""
    return " or ".join(f"({stemmed_phrase_match(column, w)})" for w in dict.fromkeys(_words(query))) or "false"


def matching(
    events: DataFrame,
    query: str | None = None,
    vendor: str | None = None,
    product: str | None = None,
    detected_format: str | None = None,
    severity_id: int | None = None,
    disposition: str | None = None,
    src_ip: str | None = None,
    dst_ip: str | None = None,
    ip_match: str = "contains",
    query_mode: str = "phrase",
    text_columns: tuple[str, ...] = ("raw_payload",),
    stemmed: bool = False,
) -> DataFrame:
    """All rows that fit. Equality facets reach the Parquet scan as pushed filters.

    ``text_columns`` are columns or SQL over them (``to_json(ocsf)`` is the event's OCSF text); the query may stand in any of them.
    """
    facets = {
        "vendor": vendor or None, "product": product or None, "detected_format": detected_format or None,
        "severity_id": severity_id, "disposition": disposition or None,
    }
    for name, value in facets.items():
        if value is not None:
            events = events.filter(F.col(name) == value)
    for name, value in (("src_ip", src_ip), ("dst_ip", dst_ip)):
        if value:
            column = F.col(name)
            events = events.filter(column.contains(value) if ip_match == "contains" else column == value)
    if query and query.strip():
        plain, by_stem = (phrase_match, stemmed_phrase_match) if query_mode == "phrase" else (terms_match, stemmed_terms_match)
        match = by_stem if stemmed else plain
        events = events.filter(" or ".join(match(c, query.strip().strip('"')) for c in text_columns))
    return events


def search(events: DataFrame, limit: int = 50, offset: int = 0, **conditions) -> SearchResult:
    """Count of all matches and one page, newest first; event_id breaks ties."""
    if not 1 <= limit <= fx.SEARCH_LIMIT_MAX or offset < 0:
        raise ValueError(f"limit must be 1..{fx.SEARCH_LIMIT_MAX} and offset not negative")
    found = matching(events, **conditions)
    page = found.orderBy(F.desc("time_epoch"), "event_id").offset(offset).limit(limit)
    return SearchResult(found.selectExpr("count(*) as total"), page)


def get_event(events: DataFrame, event_id: str) -> DataFrame:
    return events.filter(F.col("event_id") == event_id)


FACETS = {"vendor": 10, "detected_format": None, "severity": None, "disposition": None, "parser_used": 10}


def facet_counts(events: DataFrame, facets: dict[str, int | None] | None = None) -> DataFrame:
    """Counts per facet value (facet, value, events), largest first, cut to each facet's top n.

    One grouping by all facets together comes first; it shrinks on the map side to the value
    combinations that occur, and only those are unpivoted.
    """
    facets = FACETS if facets is None else facets
    combos = events.groupBy(*facets).agg(F.count("*").alias("n"))
    pairs = ", ".join(f"struct('{f}' as facet, cast({f} as string) as value)" for f in facets)
    counts = combos.selectExpr("n", f"inline(array({pairs}))").groupBy("facet", "value").agg(
        F.sum("n").alias("events"))
    limits = " ".join(f"when '{f}' then {n if n is not None else 'null'}" for f, n in facets.items())
    return counts.selectExpr(
        "*", "row_number() over (partition by facet order by events desc, value) as place"
    ).filter(f"place <= coalesce(case facet {limits} end, place)").drop("place")


def totals(events: DataFrame) -> DataFrame:
    """total_events, total_bytes."""
    return events.selectExpr("count(*) as total_events", "coalesce(sum(byte_length), 0) as total_bytes")
