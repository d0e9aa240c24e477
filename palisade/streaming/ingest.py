"""The ingest pipeline as a stream: every micro-batch is archived, processed, staged once and delivered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palisade.functions.text import lit
from palisade.operators.deadletter import failure_records
from palisade.operators.delivery import Sink, deliver_dual, due_for_retry, open_deliveries, retry_pending
from palisade.operators.envelope import make_envelope
from palisade.operators.parsers import Definition
from palisade.plans.ingest import process_envelopes, split_options, with_step
from palisade.sources.archive import archive_raw, path_exists
from palisade.sources.logs import numbered_lines


def archived_first(envelopes: DataFrame, archive: str, staged: str, dead_letters: str) -> DataFrame | None:
    """Archive the payloads and give the envelopes, read from ``staged``; if that fails, every line is a RAW_STORE dead letter and
    must not be normalised."""
    try:
        return archive_raw(envelopes, archive, staged=staged)
    except Exception as failure:  # noqa: BLE001
        rows = envelopes.selectExpr("*", "'RAW_STORE' as error_stage", f"array({lit(f'Raw archive failed: {failure}')}) as errors")
        failure_records(rows).write.mode("overwrite").parquet(dead_letters)
        return None


def retry_due(spark: SparkSession, staging: str, ledger: str, search_sink: Sink, lake_sink: Sink, before: int | None = None) -> int:
    """Try all deliveries again that are due (of batches below ``before``); how many completed."""
    if not path_exists(spark, ledger):
        return 0
    rows = spark.read.option("basePath", ledger).parquet(ledger)
    rows = rows if before is None else rows.filter(f"batch < {before}")
    # Only batches with deliveries that are due: their numbers, one per failed batch.
    batches = rows.join(due_for_retry(rows.drop("batch")).select("event_id"), "event_id", "left_semi").select("batch").distinct()
    done = 0
    for number in sorted(r.batch for r in batches.collect()):
        good = with_step(spark.read.parquet(f"{staging}/batch={number}").filter("error_stage is null"), "INDEXED_DUAL_SINK")
        own = f"{ledger}/batch={number}"
        done += retry_pending(spark.read.parquet(own), good, search_sink, lake_sink, own)
    return done


def start_retries(
    spark: SparkSession, staging: str, ledger: str, checkpoint: str, search_sink: Sink, lake_sink: Sink, every: str = "5 seconds",
):
    """Retries driven by the clock: a stream of its own that tries due deliveries again, whether or not new lines come.

    Sinks take an event twice without harm and an acknowledged sink is not asked again, so it may run beside the ingest stream.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def handle(batch: DataFrame, batch_id: int) -> None:
        retry_due(batch.sparkSession, staging, ledger, search_sink, lake_sink)

    return ticks.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def start(
    lines: DataFrame,
    staging: str,
    dead_letters: str,
    ledger: str,
    checkpoint: str,
    search_sink: Sink,
    lake_sink: Sink,
    definitions: Callable[[], list[Definition]] = list,
    available_now: bool = False,
    archive: str | None = None,
    **options,
):
    """Start the stream; returns the query.

    With ``archive``, a batch's payloads are archived before anything else is done with them. The processed batch is
    written to ``staging`` under its batch number (a repeated batch overwrites it), then both halves and both sinks read what was
    written, so the plan runs once per batch. What a sink does not take is an OUTBOX_DELIVERY dead letter, and due deliveries of
    earlier batches are tried again before a batch's own (``start_retries`` does so without new lines). ``definitions`` is called for each batch: a newly
    published parser applies to the next one.
    """
    envelope, rest = split_options(options)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if "_block" in batch.columns:
            batch = numbered_lines(batch).filter("raw_payload != ''")
        envelopes = make_envelope(batch, **envelope)
        if archive is not None:
            # One folder for all batches: only the current batch's envelopes are needed.
            kept = archived_first(envelopes, archive, f"{staging}/_envelopes", f"{dead_letters}/stage=raw/batch={batch_id}")
            if kept is None:
                retry_due(spark, staging, ledger, search_sink, lake_sink, before=batch_id)
                return
            envelopes = kept
        folder = f"{staging}/batch={batch_id}"
        process_envelopes(envelopes, definitions(), archived=archive is not None, **rest).write.mode("overwrite").parquet(folder)
        staged = spark.read.parquet(folder)
        dead = staged.filter("error_stage is not null")
        failure_records(dead).write.mode("overwrite").parquet(f"{dead_letters}/stage=process/batch={batch_id}")
        retry_due(spark, staging, ledger, search_sink, lake_sink, before=batch_id)
        good = with_step(staged.filter("error_stage is null"), "INDEXED_DUAL_SINK")
        own = f"{ledger}/batch={batch_id}"
        if not deliver_dual(good, search_sink, lake_sink, own):
            failed = open_deliveries(good, spark.read.parquet(own))
            failure_records(failed).write.mode("overwrite").parquet(f"{dead_letters}/stage=delivery/batch={batch_id}")

    writer = lines.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
