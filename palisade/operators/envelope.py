"""Event envelopes: replay-stable id, source hints, payload digest, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame

from palisade.functions.text import lit
from palisade.functions.values import stable_uuid, utc_date

DEFAULT_BUCKET = "raw-events"
DEFAULT_COLLECTOR = "collector-01"


def make_envelope(
    df: DataFrame,
    payload: str = "raw_payload",
    position: str | None = None,
    ingest_ts: str = "current_timestamp()",
    transport: str = "batch",
    collector_host: str = DEFAULT_COLLECTOR,
    bucket: str = DEFAULT_BUCKET,
) -> DataFrame:
    """One envelope row per payload.

    ``event_id`` is derived from the source position and the payload, so reading the same
    input again gives the same ids and every write keyed by it is idempotent. Sources in
    this library supply ``source_position``; pass ``position`` for any other unique column.
    Optional input columns: vendor_hint, product_hint, transport, client_ip, facility, priority.
    """
    if position is None:
        position = "source_position" if "source_position" in df.columns else "monotonically_increasing_id()"

    def given(name: str, default: str) -> str:
        return f"coalesce({name}, {default})" if name in df.columns else default

    keyed = df.selectExpr(
        f"{stable_uuid(position, payload)} as event_id",
        f"cast({position} as string) as source_position",
        f"{ingest_ts} as ingest_ts",
        f"{payload} as raw_payload",
        f"{given('vendor_hint', lit('unknown'))} as vendor",
        f"{given('product_hint', lit('unknown'))} as product",
        f"{lit(collector_host)} as collector_host",
        f"{given('client_ip', 'cast(null as string)')} as client_ip",
        f"{given('transport', lit(transport))} as transport",
        f"{given('facility', 'cast(null as int)')} as facility",
        f"{given('priority', 'cast(null as int)')} as priority",
        f"sha2({payload}, 256) as raw_sha256",
        f"octet_length({payload}) as byte_length",
        f"{lit(bucket)} as bucket",
        "'none' as compression",
    )
    return keyed.selectExpr("*", f"{object_key('event_id', 'vendor', 'ingest_ts')} as object_key")


def object_key(event_id: str, source: str, ts: str) -> str:
    """Archive key of an event: date folders, source, id."""
    day = f"date_format({utc_date(ts)}, {lit(_DAY_FOLDERS)})"
    return f"concat({day}, '/source=', {source}, '/', {event_id}, '.raw')"


_DAY_FOLDERS = "'year='yyyy'/month='MM'/day='dd"
STORAGE_URI = "concat(bucket, '/', object_key)"


def nest_envelope(df: DataFrame) -> DataFrame:
    """The nested root record (source, raw, parsing, ocsf, traceability) of processed events."""
    return df.selectExpr(
        "event_id",
        "ingest_ts",
        "struct(vendor, product, detected_format, collector_host, client_ip, transport, facility, priority) as source",
        "struct(bucket, object_key, raw_sha256 as sha256, byte_length, raw_payload, compression) as raw",
        "struct(parser_used, parser_version, mapping_version, confidence, parse_errors as errors) as parsing",
        "ocsf",
        f"struct(event_id as trace_id, raw_sha256, {STORAGE_URI} as raw_storage_uri, byte_length,"
        " provenance_chain) as traceability",
    )
