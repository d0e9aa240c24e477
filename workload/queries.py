"""The registered queries: each runs a library operator over whole input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.fixed_values import MAX_DELIVERY_ATTEMPTS
from palisade.functions.text import sanitize_text
from palisade.functions.values import utc_timestamp
from palisade.operators.audit import list_audits
from palisade.operators.deadletter import failure_records, replay, replay_summary
from palisade.operators.delivery import attempt_rows, deliver_dual, delivered, delivery_stats, retry_pending, stage
from palisade.operators.enrich import classify_ips
from palisade.operators.envelope import make_envelope
from palisade.operators.metrics import (
    events_per_second, latency_percentiles, pipeline_counters, throughput_report,
)
from palisade.operators.mining import mask_line, match_template, mine_templates
from palisade.operators.ocsf import flatten_events, lean_document
from palisade.operators.onboarding import empty_catalogue, load_definitions, onboarding_sessions, publish, reject, update_mapping
from palisade.operators.parsers import Definition
from palisade.operators.ratelimit import rate_limit
from palisade.operators.search import facet_counts, matching, search, totals
from palisade.operators.sessions import merge_sessions
from palisade.operators.sinks import dedupe_events, latest_per_key, upsert_events
from palisade.plans.checkpoints import checkpointed, fresh_folder
from palisade.plans.ingest import process_envelopes, run, with_step
from palisade.sources.archive import archive_raw, dataset_manifest, lake_files, read_raw_archive, verify_integrity
from palisade.sources.logs import from_dataframe
from workload.corpus import appliance_corpus, corpus, events_table, second_corpus, third_corpus
from workload.stored import STORED

_RUN = dict(position="event_id", ingest_ts="ingest_ts", document=False)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _judged(spark: SparkSession, sf_dir: str, second: bool = False, **options) -> DataFrame:
    """The corpus after the whole pipeline, with ``line_id`` of the source event."""
    lines = second_corpus(spark, sf_dir) if second else corpus(spark, sf_dir)
    return run(lines, **(_RUN | {"enriched": False} | options)).withColumn(
        "line_id", F.col("source_position").cast("bigint"))


def _good(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return _judged(spark, sf_dir, **options).filter("error_stage is null")


# --- detection, routing, parsing ------------------------------------------------------------

PARSED = [
    "line_id", "src_ip", "src_port", "dst_ip", "dst_port", "protocol_name", "severity_id", "disposition_id", "action",
    "bytes_in", "bytes_out", "app_name", "rule_name",
]
PARSED2 = [
    "line_id", "src_ip", "src_port", "dst_ip", "dst_port", "protocol_name", "severity_id", "disposition_id", "action",
    "bytes_in", "bytes_total", "app_name", "rule_name", "time_epoch", "meta_vendor",
]
PARSERS = {
    "parse_asa": "cisco-asa-firewall-parser",
    "parse_panos": "palo-alto-panos-parser",
    "parse_fortinet": "fortinet-fortios-parser",
    "parse_checkpoint": "checkpoint-fw1-parser",
    "parse_suricata": "suricata-eve-json-parser",
    "parse_zeek": "zeek-conn-parser",
    "parse_squid": "squid-proxy-parser",
    "parse_cef": "cef-standard-parser",
    "parse_rfc5424": "syslog-rfc5424-generic",
}
PARSERS2 = {
    "parse_leef": "leef-standard-parser",
    "parse_rfc3164": "syslog-rfc3164-generic",
    "parse_json": "json-generic-parser",
}


def _parse_query(parser_id: str, second: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _judged(spark, sf_dir, second=second).filter(F.col("parser_used") == parser_id)
        return rows.select(*(PARSED2 if second else PARSED))

    return query


def parse_cef_events(spark, sf_dir):
    rows = run(third_corpus(spark, sf_dir), **(_RUN | {"enriched": False}))
    return rows.selectExpr(
        "cast(source_position as bigint) as line_id", "parser_used", "meta_product", "src_ip", "src_port", "dst_ip", "dst_port", "protocol_name",
        "severity_id", "disposition_id", "action", "bytes_in", "bytes_out", "app_name", "rule_name", "src_hostname", "src_mac", "message")


def detect_format_counts(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("detected_format", "vendor", "product").agg(F.count("*").alias("lines"))


def route_parser_counts(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("parser_used").agg(F.count("*").alias("lines"))


def parse_outcome(spark, sf_dir):
    return _judged(spark, sf_dir).selectExpr(
        "parser_used", "confidence", "coalesce(get(parse_errors, 0), '') as parse_error"
    ).groupBy("parser_used", "confidence", "parse_error").agg(F.count("*").alias("lines"))


def unmapped_fields(spark, sf_dir):
    return _good(spark, sf_dir).filter("parser_used = 'fortinet-fortios-parser'").selectExpr(
        "line_id", "size(unmapped) as unmapped_count", "unmapped['devname'] as devname",
        "unmapped['policyid'] as policyid", "unmapped['sentbyte'] as sentbyte")


# --- normalised rows -------------------------------------------------------------------------


def ocsf_flat(spark, sf_dir):
    rows = _good(spark, sf_dir, enriched=True).withColumn("event_id", F.col("line_id"))
    return flatten_events(rows).drop("raw_sha256").withColumnRenamed("event_id", "line_id")


def lean_documents(spark, sf_dir):
    rows = _good(spark, sf_dir, document=True).withColumn("event_id", F.col("line_id"))
    return lean_document(rows).selectExpr(
        "event_id as line_id", "trace_id", "vendor", "action", "protocol_name", "src_ip", "dst_port", "class_name",
        "ocsf_schema_version", "ocsf.metadata.product.vendor_name as meta_vendor")


def ocsf_documents(spark, sf_dir):
    return _good(spark, sf_dir, document=True).selectExpr(
        "line_id", "ocsf.class_uid as class_uid", "ocsf.finding_info.title as finding_title",
        "ocsf.finding_info.uid as finding_uid", "get(ocsf.finding_info.types, 0) as finding_type",
        "ocsf.connection_info.protocol_name as protocol_name", "ocsf.traffic.bytes_in as bytes_in",
        "ocsf.rule.name as rule_name")


def provenance(spark, sf_dir):
    """The lineage after a real run: archived, enriched, and delivered to two table sinks."""
    folder = fresh_folder(spark, "provenance")
    envelopes = make_envelope(corpus(spark, sf_dir), position="event_id", ingest_ts="ingest_ts")
    kept = archive_raw(envelopes, f"{folder}/archive")
    process_envelopes(kept, archived=True, document=False).write.parquet(f"{folder}/staged")
    staged = spark.read.parquet(f"{folder}/staged")
    good = with_step(staged.filter("error_stage is null"), "INDEXED_DUAL_SINK")
    deliver_dual(good, lambda df: upsert_events(df, f"{folder}/events", 1), lambda df: df.write.parquet(f"{folder}/lake"), f"{folder}/ledger")
    done = delivered(good, spark.read.parquet(f"{folder}/ledger"))
    return staged.filter("error_stage is not null").unionByName(done).selectExpr(
        "cast(source_position as bigint) as line_id", "array_join(provenance_chain, '>') as provenance")


def severity_map(spark, sf_dir):
    return _good(spark, sf_dir).groupBy("parser_used", "severity_id", "severity").agg(F.count("*").alias("events"))


def disposition_map(spark, sf_dir):
    return _good(spark, sf_dir).selectExpr("coalesce(action, '') as action", "disposition").groupBy(
        "action", "disposition").agg(F.count("*").alias("events"))


def protocol_map(spark, sf_dir):
    return _good(spark, sf_dir).groupBy("protocol_name", "protocol_num").agg(F.count("*").alias("events"))


def timestamp_norm(spark, sf_dir):
    return _judged(spark, sf_dir).select("line_id", "time_epoch")


# --- envelope, archive -----------------------------------------------------------------------


def _documents(spark, sf_dir):
    return from_dataframe(_table(spark, sf_dir, "documents"), "text")


def envelope_hash(spark, sf_dir):
    return make_envelope(_documents(spark, sf_dir), position="doc_id").selectExpr(
        "cast(source_position as bigint) as doc_id", "event_id", "raw_sha256", "byte_length")


def _document_archive(spark, sf_dir):
    return make_envelope(_documents(spark, sf_dir), position="doc_id").selectExpr(
        "source_position as event_id", "raw_sha256", "byte_length",
        "case when cast(source_position as bigint) % 10 = 0 then concat(raw_payload, ' [TAMPERED]')"
        " else raw_payload end as raw_payload")


def integrity_check(spark, sf_dir):
    return verify_integrity(_document_archive(spark, sf_dir)).selectExpr(
        "cast(event_id as bigint) as doc_id", "is_valid", "tampered", "details")


def integrity_of_ids(spark, sf_dir):
    ids = _table(spark, sf_dir, "events").selectExpr("cast(event_id as string) as event_id")
    return verify_integrity(_document_archive(spark, sf_dir), ids).groupBy("is_valid", "tampered").agg(
        F.count("*").alias("events"))


def archive_lookup(spark, sf_dir):
    ids = _table(spark, sf_dir, "labels").selectExpr("cast(doc_id as string) as event_id")
    return read_raw_archive(_document_archive(spark, sf_dir), ids).selectExpr(
        "cast(event_id as bigint) as doc_id", "byte_length")


def table_manifest(spark, sf_dir):
    return dataset_manifest(spark, sf_dir)


def table_files(spark, sf_dir):
    return lake_files(spark, sf_dir)


# --- validation, dead letters ----------------------------------------------------------------


def validate_ocsf_errors(spark, sf_dir):
    return _judged(spark, sf_dir).filter("error_stage is not null").selectExpr(
        "line_id", "error_stage", "array_join(errors, '; ') as errors")


def dead_letter_stages(spark, sf_dir):
    return failure_records(_judged(spark, sf_dir).filter("error_stage is not null"), "ingest_ts").groupBy(
        "error_stage", "status", "replay_count").agg(F.count("*").alias("records"))


def _published(spark, waiting: DataFrame) -> list[Definition]:
    """The parser a reviewer would publish for the corpus' unknown lines."""
    sessions = checkpointed(onboarding_sessions(waiting))
    first = sessions.orderBy(F.desc("size")).first()
    entry, _, _ = publish(sessions, empty_catalogue(spark), first.session_id, "reviewer", "appliance-parser")
    return load_definitions(entry)


def replay_outcome(spark, sf_dir):
    dead = checkpointed(_judged(spark, sf_dir).filter("error_stage is not null"))  # the corpus is judged once
    definitions = _published(spark, dead.filter("error_stage = 'UNKNOWN_FORMAT'"))
    records = failure_records(dead, "ingest_ts")
    outcome, _ = replay(records, lambda lines: run(lines, definitions, document=False, enriched=False))
    return replay_summary(outcome)


def catalogue_parse(spark, sf_dir):
    return _judged(spark, sf_dir, definitions=_published(spark, _waiting(spark, sf_dir))).filter(
        "parser_used = 'appliance-parser'").select(
        "line_id", "src_ip", "dst_ip", "bytes_total", "rule_name", "protocol_name", "disposition_id", "time_epoch",
        "message")


def pipeline_metrics(spark, sf_dir):
    return pipeline_counters(_judged(spark, sf_dir))


# --- enrichment ------------------------------------------------------------------------------


def asset_enrich(spark, sf_dir):
    return _good(spark, sf_dir, enriched=True).selectExpr(
        "line_id", "dst_hostname", "dst_zone", "dst_asset_info.role as role", "dst_asset_info.criticality as criticality")


def geo_enrich(spark, sf_dir):
    return _good(spark, sf_dir, enriched=True).selectExpr(
        "line_id", "src_location.country as country", "src_location.city as city",
        "src_autonomous_system.number as as_number")


def private_flag(spark, sf_dir):
    return classify_ips(_good(spark, sf_dir)).groupBy("src_is_private", "dst_is_private").agg(
        F.count("*").alias("events"))


# --- search and counts -----------------------------------------------------------------------


def facets(spark, sf_dir):
    return facet_counts(_good(spark, sf_dir))


def document_totals(spark, sf_dir):
    return totals(make_envelope(_documents(spark, sf_dir), position="doc_id"))


def search_page(spark, sf_dir):
    page = search(_good(spark, sf_dir), limit=100, offset=25, disposition="Blocked", src_ip="185.220").page
    return page.select("line_id", "time_epoch", "vendor", "src_ip", "dst_ip")


def search_total(spark, sf_dir):
    return search(_good(spark, sf_dir), vendor="Cisco", dst_ip="10.0.0.1", ip_match="exact").total


PHRASE, TERMS = "of the", "whst ndle"


def search_phrase(spark, sf_dir):
    return matching(_table(spark, sf_dir, "documents"), query=PHRASE, text_columns=("text",)).select("doc_id", "lang")


def search_terms(spark, sf_dir):
    return matching(
        _table(spark, sf_dir, "documents"), query=TERMS, query_mode="terms", text_columns=("text",)
    ).select("doc_id", "lang")


def audit_page(spark, sf_dir):
    audits = _table(spark, sf_dir, "orders").selectExpr(
        "lpad(cast(o_orderkey as string), 12, '0') as audit_id", "o_orderdate as timestamp",
        "concat('user-', o_custkey % 7) as user", "concat('ORDER_', o_orderstatus) as action")
    return list_audits(audits, user="user-3", action="ORDER_F", limit=100, offset=20).select("audit_id", "user", "action")


# --- metrics, streams' batch forms -----------------------------------------------------------


def percentiles(spark, sf_dir):
    return latency_percentiles(events_table(spark, sf_dir), "value", ["event_type"])


def eps_windows(spark, sf_dir):
    rows = events_table(spark, sf_dir).selectExpr(f"{utc_timestamp('ts')} as ts")
    return events_per_second(rows, "ts", 3600)


def throughput(spark, sf_dir):
    rows = events_table(spark, sf_dir).selectExpr(f"{utc_timestamp('ts')} as ts", "length(props) as size", "value")
    return throughput_report(rows, "ts", "size", "value")


def dedupe(spark, sf_dir):
    events = events_table(spark, sf_dir)
    return dedupe_events(events.union(events)).groupBy("event_type").agg(
        F.count("*").alias("events"), F.sum("event_id").alias("id_sum"))


def latest_events(spark, sf_dir):
    events = events_table(spark, sf_dir)
    old = events.selectExpr("event_id", "1 as version", "value")
    new = events.selectExpr("event_id", "2 as version", "value + 1 as value")
    return latest_per_key(old.union(new), "event_id", "version")


def rate_limited(spark, sf_dir):
    rows = events_table(spark, sf_dir).selectExpr("event_id", "event_type", f"{utc_timestamp('ts')} as ts")
    return rate_limit(rows, "event_type", "ts", "event_id", limit=3, window_seconds=1800)


def delivery_state(spark, sf_dir):
    """Real deliveries to table sinks: one part is taken at once, one at the second try, one never."""
    folder = fresh_folder(spark, "delivery")
    events = events_table(spark, sf_dir).selectExpr("cast(event_id as string) as event_id", "event_id % 3 as part")

    def table(name):
        return lambda df: df.select("event_id").write.mode("append").parquet(f"{folder}/{name}")

    def broken(df):
        raise OSError("sink down")

    for part in range(3):
        own, ledger = events.filter(f"part = {part}"), f"{folder}/ledger/part={part}"
        deliver_dual(own, broken if part else table("search"), table("lake"), ledger)
        for _ in range((0, 1, MAX_DELIVERY_ATTEMPTS)[part]):
            retry_pending(spark.read.parquet(ledger), own, broken if part == 2 else table("search"), table("lake"), ledger, force=True)
    return delivery_stats(spark.read.parquet(f"{folder}/ledger"))


def retry_schedule(spark, sf_dir):
    tried = stage(
        events_table(spark, sf_dir).selectExpr("cast(event_id as string) as event_id", f"{utc_timestamp('ts')} as ts"), "ts"
    ).withColumn("attempt_count", F.expr("cast(cast(event_id as bigint) % 5 as int)"))
    after = attempt_rows(tried, "false", "true", "created_at", "'search down'")
    return after.selectExpr(
        "cast(event_id as bigint) as event_id", "state", "attempt_count", "search_ack", "lake_ack",
        "(unix_micros(next_attempt_at) - unix_micros(last_attempt)) div 1000000 as wait_seconds")


# --- text, mining ----------------------------------------------------------------------------


def sanitize_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").selectExpr("doc_id", f"{sanitize_text('text')} as clean")


def sanitize_pages(spark, sf_dir):
    return _table(spark, sf_dir, "pages").selectExpr("page_id", f"{sanitize_text('html', 100000)} as clean")


def _unknown(spark, sf_dir):
    return _judged(spark, sf_dir).filter("error_stage = 'UNKNOWN_FORMAT'")


def _waiting(spark, sf_dir):
    """The unknown lines as a table of their own, as the dead-letter table would hold them."""
    return checkpointed(_unknown(spark, sf_dir).select("line_id", "raw_payload", "ingest_ts", "vendor", "product"))


def mask_lines(spark, sf_dir):
    return _unknown(spark, sf_dir).selectExpr("line_id", f"{mask_line('raw_payload')} as masked")


def mask_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").selectExpr("doc_id", f"md5({mask_line('text')}) as masked_md5")


def templates(spark, sf_dir):
    return mine_templates(_waiting(spark, sf_dir))[0].select("template_id", "template", "size")


def appliance_templates(spark, sf_dir):
    """Two dozen appliances, one of them with a third of the lines."""
    return mine_templates(appliance_corpus(spark, sf_dir))[0].select("template_id", "template", "size")


def appliance_params(spark, sf_dir):
    """Every line's template and parameters, over two dozen templates."""
    lines = appliance_corpus(spark, sf_dir)
    return match_template(lines, mine_templates(lines)[0]).selectExpr(
        "event_id", "template_id", "array_join(parameters, '|') as parameters")


def session_merge(spark, sf_dir):
    """Two batches: the second widens the templates of the first, whose sessions a reviewer has touched, and brings new ones."""
    lines = appliance_corpus(spark, sf_dir).withColumn("raw_payload", F.expr(
        "if(event_id % 2 = 1, replace(raw_payload, ': gate ', ': door '), raw_payload)"))
    early = "event_id % 2 = 0 and appliance < 20"
    sessions = checkpointed(onboarding_sessions(lines.filter(early)))
    ids = {r["word"]: r["session_id"] for r in sessions.selectExpr(
        "substring_index(discovered_template, ':', 1) as word", "session_id").collect()}
    sessions = update_mapping(sessions, ids["unita"], 0, "gate_number", "integer")
    sessions, _ = reject(sessions, ids["unitb"], "noise", "reviewer")
    merged = merge_sessions(checkpointed(sessions), lines.filter(f"not ({early})"))
    return merged.selectExpr(
        "session_id", "discovered_template as template", "size", "status", "size(raw_sample_logs) as samples",
        "array_join(transform(filter(variables, v -> v.confidence = 1), v -> concat(v.var_index, ':', v.suggested_ocsf_field)), ',') as reviewed",
        "array_join(transform(variables, v -> v.placeholder), ' ') as placeholders")


def template_params(spark, sf_dir):
    lines = _waiting(spark, sf_dir)
    return match_template(lines, mine_templates(lines)[0]).selectExpr(
        "line_id", "template_id", "array_join(parameters, '|') as parameters")


def inferred_fields(spark, sf_dir):
    return onboarding_sessions(_waiting(spark, sf_dir)).selectExpr(
        "size", "arrays_zip(names, variables) as z").selectExpr("size", "inline(z)").selectExpr(
        "size", "names as name", "variables.placeholder as placeholder", "variables.inferred_type as inferred_type",
        "variables.suggested_ocsf_field as ocsf_field", "variables.confidence as confidence")


QUERIES = {
    "detect_format_counts": detect_format_counts,
    "route_parser_counts": route_parser_counts,
    **{name: _parse_query(parser_id, False) for name, parser_id in PARSERS.items()},
    **{name: _parse_query(parser_id, True) for name, parser_id in PARSERS2.items()},
    "parse_outcome": parse_outcome,
    "unmapped_fields": unmapped_fields,
    "ocsf_flat": ocsf_flat,
    "ocsf_documents": ocsf_documents,
    "lean_documents": lean_documents,
    "provenance": provenance,
    "severity_map": severity_map,
    "disposition_map": disposition_map,
    "protocol_map": protocol_map,
    "timestamp_norm": timestamp_norm,
    "envelope_hash": envelope_hash,
    "integrity_check": integrity_check,
    "integrity_of_ids": integrity_of_ids,
    "archive_lookup": archive_lookup,
    "table_manifest": table_manifest,
    "table_files": table_files,
    "validate_ocsf_errors": validate_ocsf_errors,
    "dead_letter_stages": dead_letter_stages,
    "replay_outcome": replay_outcome,
    "catalogue_parse": catalogue_parse,
    "pipeline_counters": pipeline_metrics,
    "asset_enrich": asset_enrich,
    "geo_enrich": geo_enrich,
    "private_flag": private_flag,
    "facet_counts": facets,
    "totals": document_totals,
    "search_page": search_page,
    "search_total": search_total,
    "search_phrase": search_phrase,
    "search_terms": search_terms,
    "audit_page": audit_page,
    "latency_percentiles": percentiles,
    "eps_windows": eps_windows,
    "throughput_report": throughput,
    "parse_cef_events": parse_cef_events,
    "dedupe": dedupe,
    "latest_events": latest_events,
    "rate_limit": rate_limited,
    "delivery_state": delivery_state,
    "retry_schedule": retry_schedule,
    "sanitize_documents": sanitize_documents,
    "sanitize_pages": sanitize_pages,
    "mask_lines": mask_lines,
    "mask_documents": mask_documents,
    "mine_templates": templates,
    "appliance_templates": appliance_templates,
    "appliance_params": appliance_params,
    "session_merge": session_merge,
    "template_params": template_params,
    "infer_fields": inferred_fields,
    **STORED,
}
