"""Delivery to two sinks with a ledger: acks per sink, retry times, dead letters.

The ledger is append-only: a row per event and attempt. States are read from the row with
the most attempts, so a repeated append is harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import fixed_values as fx
from palisade.functions.text import lit
from palisade.plans.checkpoints import checkpointed
from palisade.plans.ingest import with_step

Sink = Callable[[DataFrame], None]
LEDGER_COLUMNS = [
    "event_id", "state", "search_ack", "lake_ack", "attempt_count", "last_error", "last_attempt", "next_attempt_at",
    "created_at",
]


def retry_delay(attempts: str, base: float = fx.RETRY_BASE_SECONDS, top: float = fx.RETRY_MAX_SECONDS) -> str:
    """Back-off seconds after so many earlier attempts, without jitter."""
    return f"least({top}D, {base}D * power(2, {attempts}))"


def jitter(event_id: str, attempts: str) -> str:
    """Up to half a second, the same whenever the same attempt is computed again."""
    return f"(pmod(xxhash64({event_id}, {attempts}), 1000) / 1000D * {fx.RETRY_JITTER_SECONDS}D)"


def attempt_rows(ledger: DataFrame, search_ok: str, lake_ok: str, now: str, error: str) -> DataFrame:
    """Ledger rows after one more attempt with the given outcomes (SQL conditions).

    An acknowledged sink stays acknowledged. Both acks complete the delivery; otherwise the
    event is due again after the back-off, until the last allowed attempt makes it a dead letter.
    """
    acked = ledger.selectExpr(
        "*", f"search_ack or ({search_ok}) as _s", f"lake_ack or ({lake_ok}) as _l", f"{now} as _now",
        f"{error} as _error")
    seconds = f"{retry_delay('attempt_count')} + {jitter('event_id', 'attempt_count')}"
    return acked.selectExpr(
        "event_id",
        "case when _s and _l then 'DELIVERY_COMPLETE'"
        f" when attempt_count + 1 >= {fx.MAX_DELIVERY_ATTEMPTS} then 'DEAD_LETTER'"
        " else 'FAILED_RETRYABLE' end as state",
        "_s as search_ack", "_l as lake_ack", "attempt_count + 1 as attempt_count",
        "case when _s and _l then last_error else _error end as last_error", "_now as last_attempt",
        f"case when not (_s and _l) then timestamp_micros(unix_micros(_now) + cast(({seconds}) * 1000000 as bigint))"
        " end as next_attempt_at",
        "created_at",
    )


def stage(events: DataFrame, now: str = "current_timestamp()") -> DataFrame:
    """OUTBOX_PENDING ledger rows of events about to be delivered."""
    return events.selectExpr(
        "event_id", "'OUTBOX_PENDING' as state", "false as search_ack", "false as lake_ack", "0 as attempt_count",
        "cast(null as string) as last_error", "cast(null as timestamp) as last_attempt", f"{now} as next_attempt_at",
        f"{now} as created_at")


def latest_ledger(ledger: DataFrame) -> DataFrame:
    rest = [c for c in LEDGER_COLUMNS if c not in ("event_id", "attempt_count")]
    return ledger.groupBy("event_id").agg(F.max(F.struct("attempt_count", *rest)).alias("r")).select(
        "event_id", "r.*").select(*LEDGER_COLUMNS)


def _try(sink: Sink, events: DataFrame, name: str) -> str | None:
    """Error text of a failed sink write; the ledger, not the caller, records it."""
    try:
        sink(events)
    except Exception as failure:  # noqa: BLE001
        return f"{name} delivery failed: {failure}"
    return None


def deliver_dual(events: DataFrame, search_sink: Sink, lake_sink: Sink, ledger_path: str) -> bool:
    """Write a materialised batch to both sinks and append its ledger rows.

    Sinks must be idempotent per event_id or batch: a failed or repeated batch is sent again.
    """
    failures = {"Search": _try(search_sink, events, "Search"), "Lake": _try(lake_sink, events, "Lake")}
    error = " | ".join(f for f in failures.values() if f)
    rows = attempt_rows(
        stage(events.select("event_id").distinct()), lit(failures["Search"] is None), lit(failures["Lake"] is None),
        "current_timestamp()", lit(error or None) if error else "cast(null as string)")
    rows.write.mode("append").parquet(ledger_path)
    return not error


def delivered(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events whose both sinks have acknowledged, with the last label of their lineage."""
    done = latest_ledger(ledger).filter("state = 'DELIVERY_COMPLETE'").select("event_id")
    return with_step(events.join(done, "event_id", "left_semi"), "DELIVERY_COMPLETE_DUAL_ACK")


def open_deliveries(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Dead-letter rows, stage OUTBOX_DELIVERY, of events that a sink has not taken."""
    failed = latest_ledger(ledger).filter("state in ('FAILED_RETRYABLE', 'DEAD_LETTER')").select("event_id", "last_error")
    rest = [c for c in events.columns if c not in ("error_stage", "errors")]
    return events.join(failed, "event_id").selectExpr(
        *rest, "'OUTBOX_DELIVERY' as error_stage", "array(last_error) as errors")


def due_for_retry(ledger: DataFrame, now: str = "current_timestamp()", force: bool = False) -> DataFrame:
    """Latest rows that are open, below the attempt bound and past their time (or forced)."""
    rows = latest_ledger(ledger).filter(
        f"state in ('OUTBOX_PENDING', 'FAILED_RETRYABLE') and attempt_count < {fx.MAX_DELIVERY_ATTEMPTS}")
    return rows if force else rows.filter(f"next_attempt_at is null or next_attempt_at <= {now}")


def retry_pending(
    ledger: DataFrame,
    events: DataFrame,
    search_sink: Sink,
    lake_sink: Sink,
    ledger_path: str,
    now: str = "current_timestamp()",
    force: bool = False,
) -> int:
    """Send due events to the sinks that have not acknowledged them; returns how many completed."""
    due = checkpointed(due_for_retry(ledger, now, force))
    waiting = events.join(due.select("event_id", "search_ack", "lake_ack"), "event_id")
    failures = [
        _try(search_sink, waiting.filter("not search_ack").drop("search_ack", "lake_ack"), "Search"),
        _try(lake_sink, waiting.filter("not lake_ack").drop("search_ack", "lake_ack"), "Lake"),
    ]
    error = " | ".join(f for f in failures if f)
    rows = attempt_rows(
        due, lit(failures[0] is None), lit(failures[1] is None), now,
        lit(error) if error else "cast(null as string)")
    rows.write.mode("append").parquet(ledger_path)
    return rows.filter("state = 'DELIVERY_COMPLETE'").count()


def delivery_status(ledger: DataFrame, event_id: str) -> DataFrame:
    return latest_ledger(ledger.filter(F.col("event_id") == event_id))


def delivery_stats(ledger: DataFrame) -> DataFrame:
    """state, events."""
    return latest_ledger(ledger).groupBy("state").agg(F.count("*").alias("events"))
