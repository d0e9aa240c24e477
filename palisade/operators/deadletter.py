"""Dead letters: append-only failure records, latest-state view, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.text import lit
from palisade.functions.values import stable_uuid


def failure_records(dead: DataFrame, recorded_at: str = "current_timestamp()") -> DataFrame:
    """Dead rows of a processed frame as dead-letter records."""
    return dead.selectExpr(
        f"{stable_uuid('event_id', 'error_stage')} as error_id",
        "event_id", "raw_sha256", "raw_payload", "error_stage", "errors",
        f"{recorded_at} as recorded_at", "'UNRESOLVED' as status", "0 as replay_count",
        "cast(null as timestamp) as last_replayed_at",
    )


def record_failures(dead: DataFrame, path: str, recorded_at: str = "current_timestamp()") -> None:
    failure_records(dead, recorded_at).write.mode("append").parquet(path)


def latest_errors(records: DataFrame) -> DataFrame:
    """One row per error_id: the state with the most replays."""
    rest = [c for c in records.columns if c not in ("error_id", "replay_count")]
    return records.groupBy("error_id").agg(
        F.max(F.struct("replay_count", *rest)).alias("_last")
    ).select("error_id", "_last.*").select(*records.columns)


def list_errors(records: DataFrame, status: str | None = None, error_id: str | None = None) -> DataFrame:
    errors = latest_errors(records)
    if status is not None:
        errors = errors.filter(F.col("status") == status)
    return errors if error_id is None else errors.filter(F.col("error_id") == error_id)


def replay(
    records: DataFrame,
    process,
    error_ids: DataFrame | None = None,
    replayed_at: str = "current_timestamp()",
) -> tuple[DataFrame, DataFrame]:
    """Run unresolved (or the given) dead letters through the pipeline again.

    ``process`` maps payload rows (raw_payload, source_position, transport) to judged rows.
    Returns the judged rows, with ``error_id``, and the new REPLAYED state rows to append.
    Every chosen record is marked, whatever the outcome.
    """
    errors = latest_errors(records)
    chosen = errors.filter("status = 'UNRESOLVED'") if error_ids is None else errors.join(
        error_ids.select("error_id").distinct(), "error_id", "left_semi")
    payloads = chosen.selectExpr(
        "error_id", "raw_payload", "concat('replay#', error_id, '#', replay_count + 1) as source_position",
        f"{lit('replay' if error_ids is not None else 'replay_bulk')} as transport")
    judged = process(payloads)
    marks = payloads.selectExpr("error_id", f"{stable_uuid('source_position', 'raw_payload')} as event_id")
    outcome = judged.join(marks, "event_id")
    rest = [c for c in chosen.columns if c not in ("status", "replay_count", "last_replayed_at")]
    states = chosen.selectExpr(
        *rest, "'REPLAYED' as status", "replay_count + 1 as replay_count", f"{replayed_at} as last_replayed_at")
    return outcome, states.select(*records.columns)


def replay_summary(outcome: DataFrame) -> DataFrame:
    """total_replayed, successful_normalizations."""
    return outcome.selectExpr(
        "count(*) as total_replayed", "count_if(error_stage is null) as successful_normalizations")


def clear_resolved(spark: SparkSession, source: str, target: str) -> None:
    """Write the dead-letter table without REPLAYED records to a new folder (readers switch over)."""
    latest_errors(spark.read.parquet(source)).filter("status != 'REPLAYED'").write.mode("overwrite").parquet(target)
