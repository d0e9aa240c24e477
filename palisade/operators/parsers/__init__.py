"""Line parsers in matching order."""

from palisade.operators.parsers.asa import ASA
from palisade.operators.parsers.base import Parser, Shape
from palisade.operators.parsers.cef import CEF, PANOS
from palisade.operators.parsers.checkpoint import CHECKPOINT
from palisade.operators.parsers.json_lines import GENERIC_JSON, SURICATA, ZEEK
from palisade.operators.parsers.leef import FORTINET, LEEF
from palisade.operators.parsers.mined import Definition, Rule, mined_parser
from palisade.operators.parsers.squid import SQUID
from palisade.operators.parsers.syslog import RFC3164, RFC5424

# Vendor-specific first; published parsers come between the two groups.
SPECIFIC = [ASA, PANOS, FORTINET, CHECKPOINT, SURICATA, ZEEK, SQUID, CEF, LEEF, GENERIC_JSON]
GENERIC = [RFC5424, RFC3164]


def ordered_parsers(definitions: list[Definition] | None = None) -> list[Parser]:
    """All parsers in the order in which they are tried."""
    published = [mined_parser(d) for d in definitions or [] if d.status == "ACTIVE"]
    return SPECIFIC + published + GENERIC


def shape_list(parsers: list[Parser]) -> list[Shape]:
    """All line shapes; a shape's place is its ``_shape`` number."""
    return [shape for p in parsers for _, shape in p.shapes]


__all__ = ["Definition", "Parser", "Rule", "mined_parser", "ordered_parsers", "SPECIFIC", "GENERIC", "shape_list"]
