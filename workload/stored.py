"""Registered queries that write tables of their own into a fresh folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions.values import utc_timestamp
from palisade.operators import eventtable
from palisade.operators.deadletter import clear_resolved, list_errors, record_failures, replay
from palisade.operators.delivery import attempt_rows, stage
from palisade.operators.envelope import make_envelope
from palisade.operators.metrics import service_counters, trailing_rate
from palisade.operators.onboarding import (
    empty_catalogue, latest_parser, list_parsers, list_sessions, load_definitions, onboarding_sessions, publish_pending, reject, update_mapping)
from palisade.operators.parse import parse_with
from palisade.operators.search import matching
from palisade.operators.sinks import read_lake, write_lake
from palisade.plans.checkpoints import checkpointed, fresh_folder, tabled
from palisade.plans.ingest import run
from palisade.sources.archive import archive_raw
from palisade.sources.archiveindex import lookup, update_index
from palisade.sources.captures import read_captures
from palisade.sources.logs import from_dataframe, read_json_array_files, read_log_files, read_log_lines
from workload.corpus import appliance_corpus, corpus, edge_corpus, events_table, third_corpus

_RUN = dict(position="event_id", ingest_ts="ingest_ts", document=False, enriched=False)


#: Frames of one capture.
_CAPTURE_FRAMES = 50_000


def _event_table(spark, sf_dir) -> str:
    """Three batches with a compaction after each of the first two."""
    path = f"{fresh_folder(spark, 'events')}/table"
    events = events_table(spark, sf_dir).selectExpr("cast(event_id as string) as event_id", "event_id as n", "event_type", "value")
    for batch, (chosen, more) in enumerate((("true", 0), ("n % 3 = 0", 1), ("n % 5 = 0", 2)), 1):
        eventtable.append(events.filter(chosen).selectExpr("event_id", "event_type", f"value + {more} as value"), path, batch)
        if batch < 3:
            eventtable.compact(spark, path, buckets=16)
    return path


def event_table(spark, sf_dir):
    return eventtable.read(spark, _event_table(spark, sf_dir)).selectExpr(
        "cast(event_id as bigint) as event_id", "event_type", "value", "cast(batch_version as int) as batch")


def event_lookup(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("cast(doc_id as string) as event_id")
    return eventtable.read(spark, _event_table(spark, sf_dir), ids).selectExpr(
        "cast(event_id as bigint) as event_id", "value", "cast(batch_version as int) as batch")


def archive_index_lookup(spark, sf_dir):
    """The documents, archived on 40 days in two goes, and those of them that have labels."""
    folder = fresh_folder(spark, "archive")
    documents = from_dataframe(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text")
    day = "timestampadd(DAY, cast(doc_id % 40 as int), timestamp'2026-01-01 12:00:00Z')"
    envelopes = checkpointed(make_envelope(documents.selectExpr("*", f"{day} as day"), position="doc_id", ingest_ts="day"))
    for part in (0, 1):
        archive_raw(envelopes.filter(f"cast(source_position as bigint) % 2 = {part}"), f"{folder}/raw")
        update_index(spark, f"{folder}/raw", f"{folder}/index")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("cast(doc_id as string) as source_position")
    names = envelopes.select("event_id", "source_position").join(labels, "source_position")
    return lookup(spark, f"{folder}/raw", f"{folder}/index", names).join(names, "event_id").selectExpr(
        "cast(source_position as bigint) as doc_id", "byte_length", "concat_ws('-', year, month, day) as day")


def trailing_rates(spark, sf_dir):
    rows = events_table(spark, sf_dir).selectExpr(f"{utc_timestamp('ts')} as ts")
    return trailing_rate(rows, "ts", 1800)


def log_files(spark, sf_dir):
    """The appliances' lines as text files, between comments and blank lines."""
    folder = fresh_folder(spark, "logs")
    lines = appliance_corpus(spark, sf_dir).selectExpr("explode(array(raw_payload, '', '# note', concat('  ', raw_payload, '\t'))) as value")
    lines.write.text(folder)
    return read_log_lines(spark, folder, vendor_hint="Acme").selectExpr(
        "raw_payload", "vendor_hint", "transport", "substring_index(source_position, '/', -1) as place").groupBy(
        "raw_payload", "vendor_hint", "transport").agg(F.count("*").alias("lines"), F.count_distinct("place").alias("places"))


def capture_files(spark, sf_dir):
    """The appliances' lines as sent over 24 connections, every other one octet-counted, and read as captures."""
    folder = fresh_folder(spark, "captures")
    # Spark writes text files only; a frame's count and its line end make the capture, the folder of a client its connection. A
    # connection's captures are closed after so many frames, as collectors close files by size.
    lines = appliance_corpus(spark, sf_dir).selectExpr(
        "appliance", "concat('<13>', raw_payload, ' é') as m", "event_id").selectExpr(
        "appliance", "if(event_id % 2 = 0, concat(octet_length(m), ' ', m), m) as value")
    lines.hint("rebalance", "appliance").write.option("maxRecordsPerFile", _CAPTURE_FRAMES).partitionBy("appliance").text(folder)
    return read_captures(spark, folder).groupBy("raw_payload", "transport").agg(
        F.count("*").alias("times"), F.count_distinct("source_position").alias("places"))


def json_files(spark, sf_dir):
    """The same lines as JSON arrays, some elements as texts and some as objects, one file for each appliance."""
    folder = fresh_folder(spark, "json")
    text = "to_json(named_struct('t', raw_payload))"  # a JSON text stands inside {"t":...}
    lines = appliance_corpus(spark, sf_dir).selectExpr(
        "appliance", f"if(event_id % 2 = 0, substring({text}, 6, length({text}) - 6),"
        " to_json(named_struct('event', event_id, 'line', raw_payload))) as element")
    lines.groupBy("appliance").agg(F.array_sort(F.collect_list("element")).alias("e")).repartition(24, "appliance").selectExpr(
        "concat('[', array_join(e, ', '), ']') as value", "appliance").write.partitionBy("appliance").text(folder)
    rows = read_log_files(spark, folder).select("raw_payload").union(
        read_json_array_files(spark, folder).select("raw_payload"))
    return rows.groupBy("raw_payload").agg(F.count("*").alias("times"))


def _letters(spark, judged, folder):
    """Dead letters of the judged corpus, written, and replayed once where no appliance wrote the line."""
    record_failures(judged.filter("error_stage is not null"), f"{folder}/letters", "ingest_ts")
    records = spark.read.parquet(f"{folder}/letters")
    chosen = list_errors(records).filter("raw_payload not like '[APPLIANCE%'").select("error_id")
    _, states = replay(records, lambda lines: run(lines, document=False, enriched=False), chosen, "recorded_at")
    checkpointed(states).write.mode("append").parquet(f"{folder}/letters")


def dead_letters_listed(spark, sf_dir):
    """All states by list_errors, and what is left after clear_resolved."""
    folder = fresh_folder(spark, "letters")
    _letters(spark, run(corpus(spark, sf_dir), **_RUN), folder)
    clear_resolved(spark, f"{folder}/letters", f"{folder}/kept")
    counted = lambda path, table: list_errors(spark.read.parquet(path)).groupBy("status", "replay_count").agg(
        F.count("*").alias("records")).selectExpr(f"'{table}' as letters", "*")
    return counted(f"{folder}/letters", "all").union(counted(f"{folder}/kept", "kept"))


def search_stems(spark, sf_dir):
    """Events whose line or OCSF text holds other forms of the words, by phrase and by term."""
    good = tabled(run(corpus(spark, sf_dir), **(_RUN | {"document": True})).filter("error_stage is null").selectExpr(
        "source_position", "raw_payload", "to_json(ocsf) as ocsf_text"))
    both = ("raw_payload", "ocsf_text")
    show = lambda found, name: found.selectExpr("cast(source_position as bigint) as line_id", f"'{name}' as query")
    return show(matching(good, query="networking activities", text_columns=both, stemmed=True), "phrase").union(
        show(matching(good, query="finds deny", query_mode="terms", text_columns=both, stemmed=True), "terms"))


def lake_readback(spark, sf_dir):
    """Good events, written to the lake twice."""
    folder = fresh_folder(spark, "lake")
    good = checkpointed(run(corpus(spark, sf_dir), **(_RUN | {"enriched": True})).filter("error_stage is null").withColumn(
        "event_id", F.col("source_position")))
    for _ in range(2):
        write_lake(good, folder)
    return read_lake(spark, folder).selectExpr(
        "cast(event_id as bigint) as line_id", "time_epoch", "vendor", "src_ip", "dst_ip", "disposition_id",
        "concat_ws('-', lpad(cast(year as string), 4, '0'), lpad(cast(month as string), 2, '0'), lpad(cast(day as string), 2, '0')) as day")


def dry_run(spark, sf_dir):
    """The CEF parser on lines of its own and on lines of the appliances, which it refuses."""
    lines = third_corpus(spark, sf_dir).selectExpr("event_id", "true as own", "raw_payload").union(
        appliance_corpus(spark, sf_dir).selectExpr("event_id", "false", "raw_payload"))
    return parse_with(lines, "cef-standard-parser").selectExpr(
        "event_id", "own", "success", "parser_used", "parsed_fields.src_ip as src_ip", "parsed_fields.dst_port as dst_port")


def _sessions(spark, sf_dir):
    return checkpointed(onboarding_sessions(appliance_corpus(spark, sf_dir)))


def field_samples(spark, sf_dir):
    """Names, types, mapped fields and first values of every variable of every session."""
    return _sessions(spark, sf_dir).selectExpr("discovered_template as template", "arrays_zip(names, variables) as z").selectExpr(
        "template", "inline(z)").selectExpr(
        "template", "names as name", "variables.placeholder as placeholder", "variables.suggested_ocsf_field as ocsf_field",
        "array_join(variables.sample_values, '|') as sample_values")


def sessions_listed(spark, sf_dir):
    """After a mapping and a rejection: the sessions of each status, and the one of an id."""
    found = _sessions(spark, sf_dir)
    ids = {r["word"]: r["session_id"] for r in found.selectExpr(
        "substring_index(discovered_template, ':', 1) as word", "session_id").collect()}
    mapped = update_mapping(found, ids["unitc"], 2, "src_ip_seen", "ipv4", "trim")
    changed, _ = reject(mapped, ids["unitd"], "noise", "reviewer")
    changed = checkpointed(changed)
    show = lambda kind, df: df.selectExpr(
        f"'{kind}' as listed", "discovered_template as template", "coalesce(reviewed_by, '') as reviewed_by",
        "concat_ws('|', variables[2].suggested_ocsf_field, rules[2].target_ocsf_field, rules[2].transform) as third")
    return show("pending", list_sessions(changed, "PENDING")).union(show("rejected", list_sessions(changed, "REJECTED"))).union(
        show("one", list_sessions(changed, session_id=ids["unitc"])))


def _catalogue(spark, sf_dir):
    entries, sessions, audit = publish_pending(_sessions(spark, sf_dir), empty_catalogue(spark), "reviewer")
    return checkpointed(entries), sessions, audit


def catalogue_listed(spark, sf_dir):
    """Built-in and published parsers, which of them a lookup by id finds, and their audit rows."""
    entries, _, audit = _catalogue(spark, sf_dir)
    latest = latest_parser(entries, "custom-appliance-device-model-1-parser").selectExpr("parser_id", "true as looked_up")
    logged = audit.filter("action = 'ONBOARDING_APPROVED_AND_PUBLISHED'").selectExpr(
        "substring_index(resource_id, ':', 1) as parser_id", "user as approved_by")
    return list_parsers(entries).join(latest, "parser_id", "left").join(logged, "parser_id", "left").selectExpr(
        "parser_id", "version", "vendor", "product", "kind", "status", "coalesce(looked_up, false) as looked_up",
        "coalesce(approved_by, '') as approved_by")


def appliance_parse(spark, sf_dir):
    """Every appliance's lines, through the parsers that were published from their sessions."""
    entries, _, _ = _catalogue(spark, sf_dir)
    return run(appliance_corpus(spark, sf_dir), load_definitions(entries), **_RUN).selectExpr(
        "cast(source_position as bigint) as event_id", "parser_used", "src_ip", "coalesce(error_stage, '') as error_stage", "meta_vendor")


def counters(spark, sf_dir):
    """The service's counters over the corpus, its dead letters, a catalogue, sessions and a ledger."""
    folder = fresh_folder(spark, "counters")
    # The corpus is judged once; the table holds what the dead letters and the counters read.
    judged = tabled(run(corpus(spark, sf_dir), **_RUN).select(
        "event_id", "raw_sha256", "raw_payload", "ingest_ts", "parser_used", "error_stage", "errors"))
    _letters(spark, judged, folder)
    entries, sessions, _ = _catalogue(spark, sf_dir)
    staged = stage(events_table(spark, sf_dir).selectExpr("cast(event_id as string) as event_id"))
    tried = attempt_rows(staged, "event_id % 4 != 0", "event_id % 3 != 0", "created_at", "'down'")
    return service_counters(judged, spark.read.parquet(f"{folder}/letters"), entries, sessions, staged.union(tried))


def edge_events(spark, sf_dir):
    """Statuses, directions and packets, and what the lookups know of the source host and the destination's network."""
    rows = run(edge_corpus(spark, sf_dir), **(_RUN | {"enriched": True}))
    return rows.selectExpr(
        "cast(source_position as bigint) as event_id", "status_id", "status", "direction_id", "direction", "packets_in", "packets_out",
        "bytes_total", "src_hostname", "src_zone", "src_asset_info.role as src_role", "src_asset_info.criticality as src_criticality",
        "dst_location.country as dst_country", "dst_location.city as dst_city", "dst_location.country_code as dst_country_code",
        "dst_autonomous_system.name as dst_as_name", "dst_autonomous_system.number as dst_as_number",
        "array_join(array_sort(transform(map_entries(unmapped), e -> concat(e.key, '=', e.value))), ';') as unmapped")


STORED = {
    "edge_events": edge_events,
    "event_table": event_table,
    "event_lookup": event_lookup,
    "archive_index_lookup": archive_index_lookup,
    "trailing_rate": trailing_rates,
    "log_files": log_files,
    "capture_files": capture_files,
    "json_files": json_files,
    "dead_letters_listed": dead_letters_listed,
    "search_stems": search_stems,
    "lake_readback": lake_readback,
    "dry_run": dry_run,
    "field_samples": field_samples,
    "sessions_listed": sessions_listed,
    "catalogue_listed": catalogue_listed,
    "appliance_parse": appliance_parse,
    "service_counters": counters,
}
