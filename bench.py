"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from palisade.operators.delivery import deliver_dual
from palisade.operators.envelope import make_envelope
from palisade.operators.metrics import latency_percentiles
from palisade.operators.mining import mine_templates
from palisade.operators.ocsf import flatten_events
from palisade.operators.search import facet_counts, matching, search
from palisade.operators.sinks import upsert_events, write_lake
from palisade.plans.ingest import process_envelopes, run, with_step
from palisade.plans.shipping import ship
from palisade.sources.archive import archive_raw, verify_integrity
from workload.corpus import corpus, events_table
from workload.queries import PHRASE, QUERIES, _RUN, _document_archive

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def whole_path(spark: SparkSession, lines, folder: str) -> None:
    """Archive, process, stage, deliver to two table sinks, ledger: the path that the baseline measures."""
    envelopes = make_envelope(lines, position="event_id", ingest_ts="ingest_ts")
    kept = archive_raw(envelopes, f"{folder}/archive")
    process_envelopes(kept, archived=True).write.parquet(f"{folder}/staged")
    good = with_step(spark.read.parquet(f"{folder}/staged").filter("error_stage is null"), "INDEXED_DUAL_SINK")
    deliver_dual(good, lambda df: upsert_events(df, f"{folder}/events", 1), lambda df: write_lake(df, f"{folder}/lake"), f"{folder}/ledger")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    ship(spark)
    folder = tempfile.mkdtemp(prefix="bench-")
    lines_path, silver_path = f"{folder}/lines", f"{folder}/silver"
    seconds: dict[str, float] = {}

    def timed(name: str, action) -> None:
        started = time.time()
        action()
        seconds[name] = round(time.time() - started, 3)

    def drain(frame) -> None:
        frame.write.format("noop").mode("overwrite").save()

    # The raw lines are the input, so rendering them is not part of the measurement.
    corpus(spark, SF_DIR).write.parquet(lines_path)
    lines = spark.read.parquet(lines_path)
    count = lines.count()

    timed("ingest_cold", lambda: drain(flatten_events(run(lines, **_RUN))))
    timed("ingest_flat", lambda: drain(flatten_events(run(lines, **_RUN))))
    timed("ingest_to_silver", lambda: run(lines, **(_RUN | {"document": True})).write.parquet(silver_path))
    timed("archive_to_delivery", lambda: whole_path(spark, lines, folder))
    silver = spark.read.parquet(silver_path)
    good = silver.filter("error_stage is null")
    timed("facet_counts", lambda: facet_counts(good).collect())
    timed("search_page", lambda: search(good, disposition="Blocked", src_ip="185.220").page.collect())
    timed("search_phrase", lambda: matching(good, query="Built inbound TCP").count())
    timed("search_documents", lambda: matching(
        spark.read.parquet(f"{SF_DIR}/documents.parquet"), query=PHRASE, text_columns=("text",)).count())
    timed("integrity_check", lambda: drain(verify_integrity(_document_archive(spark, SF_DIR))))
    timed("mine_templates", lambda: mine_templates(silver.filter("error_stage = 'UNKNOWN_FORMAT'"))[0].collect())
    timed("latency_percentiles", lambda: latency_percentiles(
        events_table(spark, SF_DIR), "value", ["event_type"]).collect())
    timed("rate_limit", lambda: drain(QUERIES["rate_limit"](spark, SF_DIR)))
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")),
        "lines": count,
        "events_per_second": round(count / seconds["ingest_flat"], 1),
        "events_per_second_to_silver": round(count / seconds["ingest_to_silver"], 1),
        "events_per_second_archive_to_delivery": round(count / seconds["archive_to_delivery"], 1),
    }))


if __name__ == "__main__":
    main()
