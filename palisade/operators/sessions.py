"""Review sessions that follow their template: unknown lines of a later batch join the sessions that earlier batches have opened.

The templates of the known sessions stand in the tree first, each as a cluster of its own; the templates mined from the new lines then
join them as lines would. A session whose template widens keeps its id, status and reviewer, shows further samples up to its bound, gets
its fields discovered anew, and keeps the mappings a reviewer has set: they are found again by token, as a new wildcard shifts the
variables after it. Templates that join no session open one. Sessions without new lines stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import fixed_values as fx
from palisade.functions.text import lit
from palisade.functions.values import stable_uuid
from palisade.operators.mining import Tree, mine_templates
from palisade.operators.onboarding import OPENED, infer_fields, masked_lines, sample_values, template_patterns
from palisade.plans.checkpoints import tabled

_PLACED = "tokens int, cluster long, session_id string, part string, template string"


def _clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Templates by token count, those of sessions first: one row per template with its cluster, one per cluster when a count ends."""
    current, tree = None, Tree()

    def rows(columns: list[list]) -> pa.RecordBatch:
        types = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], names=["tokens", "cluster", "session_id", "part", "template"])

    def ended() -> pa.RecordBatch:
        n = len(tree.templates)
        return rows([[current] * n, list(range(n)), [None] * n, [None] * n, [" ".join(t) for t in tree.templates]])

    for batch in batches:
        counts, ids, parts = (c.to_pylist() for c in batch.columns)
        numbers: list[int] = []
        for count, own, part in zip(counts, ids, parts):
            if count != current:
                if tree.templates:
                    yield ended()
                current, tree = count, Tree()
            numbers.append(tree.add(part.split()) if own is None else tree.open(part.split()))
        yield rows([counts, numbers, ids, parts, [None] * len(parts)])
    if tree.templates:
        yield ended()


def place_templates(sessions: DataFrame, templates: DataFrame) -> DataFrame:
    """part (a new template), session_id (null for a new session), template (what both have in common)."""
    known = sessions.selectExpr("session_id", "discovered_template as part", "cast(template_id as long) as place")
    new = templates.selectExpr("cast(null as string) as session_id", "template as part", "cast(template_id as long) as place")
    both = known.union(new).selectExpr("*", f"size(split(part, {lit(chr(92) + 's+')})) as tokens", "session_id is null as is_new")
    ordered = both.repartition("tokens").sortWithinPartitions("tokens", "is_new", "place", "part").select("tokens", "session_id", "part")
    rows = tabled(ordered.mapInArrow(_clusters, _PLACED))
    ended = rows.filter("part is null").select("tokens", "cluster", "template")
    owners = rows.filter("session_id is not null").select("tokens", "cluster", "session_id")
    return rows.filter("part is not null and session_id is null").select("tokens", "cluster", "part").join(
        ended, ["tokens", "cluster"]).join(owners, ["tokens", "cluster"], "left").select("part", "session_id", "template")


def _places(template: str) -> str:
    """Token and place in the token of each placeholder of a template, as the variables count them."""
    opened = OPENED.format(template)
    return (f"flatten(transform(split({opened}, {lit(chr(92) + 's+')}), (t, i) -> transform(regexp_extract_all(t, '<[^>]+>', 0),"
            " (p, j) -> concat(i, ':', j))))")


def merge_sessions(
    sessions: DataFrame, lines: DataFrame, payload: str = "raw_payload", order: str = "ingest_ts", samples: int = 20,
) -> DataFrame:
    """The sessions after a further batch of unknown lines, in the columns of ``onboarding_sessions``."""
    templates, assignment = mine_templates(lines, payload, order)
    placed = place_templates(sessions, templates)
    # Sizes and samples of the new templates, by the session that they join or open.
    grown = tabled(placed.join(templates.select(F.col("template").alias("part"), "size", "first_seen"), "part").groupBy(
        "session_id", "template").agg(F.sum("size").alias("size"), F.min("first_seen").alias("first_seen")).selectExpr(
        f"coalesce(session_id, {stable_uuid('template')}) as session_id", "session_id is null as is_new", "template", "size", "first_seen"))
    distinct = masked_lines(lines, payload, order, []).groupBy("masked", "line").agg(F.min("seen").alias("seen")).join(assignment, "masked").join(
        placed.selectExpr("part as template", f"coalesce(session_id, {stable_uuid('template')}) as session_id"), "template").select(
        "session_id", "line", F.lit(1).alias("batch"), "seen")
    touched = sessions.join(grown.select("session_id"), "session_id", "left_semi")
    shown = touched.selectExpr("session_id", "posexplode(raw_sample_logs) as (at, line)").selectExpr(
        "session_id", "line", "0 as batch", "timestamp_micros(at) as seen")
    every = shown.union(distinct).groupBy("session_id", "line").agg(F.min(F.struct("batch", "seen")).alias("seen"))
    first = every.selectExpr("*", "row_number() over (partition by session_id order by seen, line) as place").filter(
        f"place <= {samples}").groupBy("session_id").agg(
        F.expr("transform(array_sort(collect_list(struct(place, line))), x -> x.line)").alias("raw_sample_logs"))
    # A session is found by its id here: two of them may have widened to one template.
    own = grown.selectExpr("session_id as template_key", "template")
    patterns = template_patterns(own).withColumnRenamed("template", "common")
    values = sample_values(every.join(patterns, every["session_id"] == patterns["template_key"]).selectExpr(
        "session_id as template", "line", "seen", "pattern", "names"))
    fields = tabled(infer_fields(patterns.withColumnRenamed("template_key", "template"), values).withColumnRenamed("template", "session_id"))

    old = touched.selectExpr(
        "session_id", "vendor", "product", "format", "template_id", "size as old_size", "target_class", "target_class_uid", "status",
        "confidence_score", "reviewed_by", "published_parser_id", "published_version",
        f"{_edits()} as edits")
    # New sessions count on; like sessions they are few, so one ordered run numbers them.
    last = sessions.agg(F.coalesce(F.max("template_id"), F.lit(0)).alias("last")).first()["last"]
    numbers = grown.filter("is_new").selectExpr(
        "session_id", f"{last} + row_number() over (order by first_seen, template) as number")
    rows = fields.join(grown, "session_id").join(first, "session_id").join(old, "session_id", "left").join(
        numbers, "session_id", "left").selectExpr(
        "*", "cast(coalesce(template_id, number) as int) as id", f"{_places('template')} as places")
    edit = "edits[places[i]]"
    fresh_rows = rows.selectExpr(
        "session_id", "coalesce(vendor, 'Custom-Appliance') as vendor", "coalesce(product, concat('Device-Model-', id)) as product",
        "coalesce(format, 'proprietary') as format", "template as discovered_template", "id as template_id",
        "size + coalesce(old_size, 0) as size", "raw_sample_logs",
        f"transform(variables, (v, i) -> if({edit} is null, v, named_struct('var_index', i, 'placeholder', v.placeholder, 'sample_values',"
        f" v.sample_values, 'inferred_type', {edit}.v.inferred_type, 'suggested_ocsf_field', {edit}.v.suggested_ocsf_field,"
        " 'confidence', 1.0D))) as variables",
        "pattern", "names",
        f"transform(rules, (r, i) -> if({edit} is null, r, named_struct('field_name', r.field_name, 'target_ocsf_field',"
        f" {edit}.r.target_ocsf_field, 'transform', {edit}.r.transform, 'default_value', {edit}.r.default_value))) as rules",
        "coalesce(target_class, 'Network Activity') as target_class",
        f"coalesce(target_class_uid, {fx.CLASS_NETWORK_ACTIVITY}) as target_class_uid", "coalesce(status, 'PENDING') as status",
        f"coalesce(confidence_score, {fx.SESSION_CONFIDENCE}D) as confidence_score", "reviewed_by", "published_parser_id",
        "published_version")
    unchanged = sessions.join(grown.select("session_id"), "session_id", "left_anti").select(*fresh_rows.columns)
    return unchanged.union(fresh_rows)


def _edits() -> str:
    """Mappings that a reviewer has set, by the place of their placeholder; none where places and variables do not correspond."""
    places = _places("discovered_template")
    pairs = (f"filter(transform({places}, (p, i) -> struct(p as place, struct(get(variables, i) as v, get(rules, i) as r) as edit)),"
             " z -> z.edit.v.confidence = 1.0)")
    return f"if(size({places}) = size(variables), map_from_entries({pairs}), null)"
