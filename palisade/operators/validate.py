"""Validation rules as error lists, and the split into good and dead rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from palisade import fixed_values as fx
from palisade.functions.text import apart, case, fenced, isin, lit, matches, strip
from palisade.functions.values import IPV4_STRICT

_UUID = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"
_DOTTED_QUAD = r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"
_REQUIRED = {
    "class_uid": "class_uid", "category_uid": "category_uid", "class_name": "class_name",
    "category_name": "category_name", "severity_id": "severity_id", "status_id": "status_id", "time_epoch": "time",
}
UNKNOWN_FORMAT_ERROR = "Unrecognized log format routed to template onboarding"


def _errors(*rules: tuple[str, str]) -> str:
    # array_except drops the nulls of rules that hold; unlike array_compact it needs no lambda.
    return f"array_except(array({', '.join(case(rule) for rule in rules)}), array(cast(null as string)))"


def ingestion_errors() -> str:
    """Payload present, at most 10 MiB, UUID id, 64-character digest."""
    return _errors(
        (f"coalesce({strip('raw_payload')}, '') = ''", "'Ingestion Error: Raw payload is empty'"),
        (f"byte_length > {fx.MAX_PAYLOAD_BYTES}",
         "concat('Ingestion Error: Raw payload exceeds max size (size: ', byte_length, ' bytes)')"),
        (f"not coalesce({matches('event_id', _UUID)}, false)",
         "concat('Ingestion Error: Invalid event_id format \\'', coalesce(event_id, ''), '\\' (must be UUIDv4)')"),
        ("coalesce(length(raw_sha256), 0) != 64", "'Ingestion Error: Invalid or missing SHA-256 hash'"),
    )


def _endpoint_rules(side: str) -> list[tuple[str, str]]:
    ip, port = f"{side}_ip", f"{side}_port"
    malformed = (
        f"{ip} rlike '^[0-9.]+$' and not {matches(ip, IPV4_STRICT)} and not {matches(ip, _DOTTED_QUAD)}")
    return [
        (f"not {port} between 1 and 65535",
         f"concat('OCSF Validation Error: Port out of range in {side}_endpoint: ', {port})"),
        (malformed,
         f"concat('OCSF Validation Error: Malformed IPv4 address in {side}_endpoint: \\'', {ip}, '\\'')"),
    ]


def ocsf_errors() -> str:
    """Required fields, enumerations, time, vendor, ports and addresses of the flat OCSF columns."""
    def invalid(name: str) -> str:
        return f"concat('OCSF Validation Error: Invalid {name} \\'', {name}, '\\'')"

    return _errors(
        *[(f"{column} is null", lit(f"OCSF Validation Error: Missing mandatory field '{name}'"))
          for column, name in _REQUIRED.items()],
        (f"not {isin('severity_id', fx.SEVERITY_NAMES)}", invalid("severity_id")),
        (f"not {isin('disposition_id', fx.DISPOSITION_NAMES)}", invalid("disposition_id")),
        ("time_epoch <= 0", "concat('OCSF Validation Error: Invalid epoch timestamp \\'', time_epoch, '\\'')"),
        ("coalesce(meta_vendor, '') = ''",
         lit("OCSF Validation Error: 'metadata.product.vendor_name' is required")),
        *_endpoint_rules("src"),
        *_endpoint_rules("dst"),
    )


def validate_ingestion(df: DataFrame) -> DataFrame:
    return df.selectExpr("*", f"{ingestion_errors()} as ingestion_errors")


def validate_ocsf(df: DataFrame) -> DataFrame:
    return df.selectExpr("*", f"{ocsf_errors()} as ocsf_errors")


def judge(df: DataFrame, on_parse_error: str = "deliver") -> DataFrame:
    """Add ``error_stage`` (null = good) and ``errors`` to fully processed rows."""
    if on_parse_error not in ("deliver", "dead_letter"):
        raise ValueError("on_parse_error must be 'deliver' or 'dead_letter'")
    bad_parse = "size(parse_errors) > 0" if on_parse_error == "dead_letter" else "false"
    stages = [
        ("size(ingestion_errors) > 0", "INGESTION", "ingestion_errors"),
        (f"parser_used = {lit(fx.ONBOARDING_QUEUE)}", "UNKNOWN_FORMAT", f"array({lit(UNKNOWN_FORMAT_ERROR)})"),
        (bad_parse, "PARSER", "parse_errors"),
        ("size(ocsf_errors) > 0", "OCSF_VALIDATION", "ocsf_errors"),
    ]
    df = df.selectExpr(
        *[c for c in df.columns if c != "time_epoch"], apart("time_epoch"), f"{ocsf_errors()} as ocsf_errors")
    rest = [c for c in df.columns if c not in ("ingestion_errors", "ocsf_errors")]
    return fenced(df, {
        "error_stage": case(*[(condition, lit(stage)) for condition, stage, _ in stages]),
        "errors": case(*[(condition, errors) for condition, _, errors in stages]),
    }, rest)


def split_valid(processed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good and dead rows of one processed frame.

    Write the frame once (partitioned by error_stage) and split what was written when both
    halves are needed; splitting the lazy frame runs the whole plan twice.
    """
    return processed.filter("error_stage is null"), processed.filter("error_stage is not null")
