"""From payloads to judged events: envelope, detect, route, parse, normalise, validate, enrich."""

from __future__ import annotations

from pyspark.sql import DataFrame

from palisade.operators.enrich import enrich
from palisade.operators.envelope import make_envelope
from palisade.operators.ocsf import normalize_ocsf, ocsf_document
from palisade.operators.parse import route_and_parse
from palisade.operators.parsers import Definition
from palisade.operators.validate import judge, validate_ingestion



def _provenance(archived: bool, enriched: bool) -> str:
    """The labels of the steps that a row has really passed."""
    received = "'INGESTION_RECEIVED'" + (", 'RAW_ARCHIVED_SHA256'" if archived else "")
    steps = "concat('FORMAT_DETECTED:', detected_format), concat('PARSED:', parser_used, ':', parser_version), 'OCSF_NORMALIZED_1.1.0'"
    steps += ", 'ENRICHED_OFFLINE'" if enriched else ""
    return f"case when error_stage is null then array({received}, {steps}) else array({received}) end"


def with_step(df: DataFrame, label: str) -> DataFrame:
    """Append a step's label to the rows' lineage."""
    return df.selectExpr(*[
        f"concat(provenance_chain, array('{label}')) as provenance_chain" if c == "provenance_chain" else f"`{c}`" for c in df.columns])


def process_envelopes(
    envelopes: DataFrame,
    definitions: list[Definition] | None = None,
    assets: DataFrame | None = None,
    geo: DataFrame | None = None,
    on_parse_error: str = "deliver",
    document: bool = True,
    enriched: bool = True,
    archived: bool = False,
) -> DataFrame:
    """Envelope rows to judged rows: one narrow pass, no shuffle.

    The joins are lookups in size-checked dimensions. Dead rows stay in the result with
    their ``error_stage``; see ``split_valid``. ``archived`` tells that the payloads are already in the
    raw archive.
    """
    parsed = route_and_parse(validate_ingestion(envelopes), definitions)
    judged = judge(normalize_ocsf(parsed), on_parse_error)
    out = enrich(judged, assets, geo) if enriched else judged
    out = out.selectExpr("*", f"{_provenance(archived, enriched)} as provenance_chain")
    return ocsf_document(out) if document else out


def split_options(options: dict) -> tuple[dict, dict]:
    """Keyword options of ``make_envelope`` and the rest, which ``process_envelopes`` takes."""
    names = {"payload", "position", "ingest_ts", "transport", "collector_host", "bucket"}
    return {k: v for k, v in options.items() if k in names}, {k: v for k, v in options.items() if k not in names}


def run(payloads: DataFrame, definitions: list[Definition] | None = None, **options) -> DataFrame:
    """Payload rows (raw_payload and optional hints) to judged events.

    Keyword options of ``make_envelope`` and ``process_envelopes`` are accepted.
    """
    envelope, rest = split_options(options)
    return process_envelopes(make_envelope(payloads, **envelope), definitions, **rest)
