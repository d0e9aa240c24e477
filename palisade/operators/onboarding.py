"""Onboarding: field discovery on mined templates, review sessions, the parser catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade import fixed_values as fx
from palisade.functions.text import case, contains_any, fenced, lit, matches, strip
from palisade.functions.values import stable_uuid
from palisade.operators.audit import audit_rows
from palisade.operators.mining import mask_line, mine_templates
from palisade.operators.parsers import Definition, Rule
from palisade.plans.checkpoints import tabled

_RULES = "array<struct<field_name:string,target_ocsf_field:string,transform:string,default_value:string>>"
_VARIABLES = (
    "array<struct<var_index:int,placeholder:string,sample_values:array<string>,inferred_type:string,"
    "suggested_ocsf_field:string,confidence:double>>"
)

# --- template -> pattern --------------------------------------------------------------------

#: A template (in the braces) with each unmasked KEY=VALUE as KEY=<KEY>.
OPENED = "regexp_replace({}, " + lit(r"([A-Za-z0-9_]+)=(?!<[^\s,;|]*>(?:[\s,;|]|$))[^\s,;|]+") + ", '$1=<$1>')"


def _quoted(text: str) -> str:
    special, escaped = lit(r"([\\\[\](){}.*+?^$|])"), lit(r"\\$1")
    return f"regexp_replace({text}, {special}, {escaped})"


def _marked(name: str, marks: list[str]) -> str:
    return contains_any(name, marks) if marks else "false"


def template_patterns(templates: DataFrame) -> DataFrame:
    """Add pattern (positional groups), names of the groups and placeholders to a template table.

    An unmasked ``KEY=VALUE`` first becomes ``KEY=<KEY>``, since its value varies between lines to come. A template then is
    text, placeholder, text, ..., text: a variable is named after the key before it, else after a known placeholder.
    """
    masked = lit("<[^>]+>")
    pieces = templates.selectExpr("*", f"{OPENED.format('template')} as _open").selectExpr(
        "*", f"regexp_extract_all(_open, {masked}, 0) as placeholders", f"split(_open, {masked}, -1) as _texts")
    label = lit(r"([a-zA-Z0-9_]+)[=:]\s*$")
    key = f"nullif(lower(regexp_extract(_texts[i], {label}, 1)), '')"
    mask = "lower(substring(p, 2, length(p) - 2))"
    known = ", ".join(lit(n) for n in fx.NAMED_PLACEHOLDERS)
    named = pieces.selectExpr(
        "*", f"transform(placeholders, (p, i) -> concat(coalesce({key}, if({mask} in ({known}), {mask}, 'var')), '_', i)) as names")
    group = case(
        *[(f"upper(substring(p, 2, length(p) - 2)) = {lit(kind)} or {_marked('n', marks)}", lit(pattern))
          for kind, marks, pattern in fx.VARIABLE_GROUPS], default=lit(fx.GROUP_TEXT))
    groups = named.selectExpr("*", f"zip_with(placeholders, names, (p, n) -> {group}) as _groups")
    rest = [c for c in templates.columns if c not in ("pattern", "names", "placeholders")]
    return groups.selectExpr(
        *rest,
        f"concat(array_join(zip_with(slice(_texts, 1, size(_groups)), _groups, (t, g) -> concat({_quoted('t')}, g)), ''),"
        f" {_quoted('element_at(_texts, -1)')}) as pattern",
        "names", "placeholders")


# --- field inference ------------------------------------------------------------------------


def sample_values(lines: DataFrame, keep: int = fx.DISCOVERED_SAMPLES) -> DataFrame:
    """First distinct values per variable in the order seen: template, var_index, values.

    ``lines``: template, pattern, names, line, seen. The grouped minimum and the ranked top-n
    both shrink on the map side, so a template with most of the lines is no hot spot.
    """
    # Lines of a template one after the other, or each line's pattern would be compiled anew.
    groups = "transform(sequence(1, size(names)), i -> regexp_extract(line, _pattern, i))"
    values = lines.selectExpr("template", "line", "seen", "names", "concat('(?i)', pattern) as _pattern").sortWithinPartitions(
        "template", "_pattern").filter("size(names) > 0 and line rlike _pattern").selectExpr(
        "template", "seen", f"posexplode({groups}) as (var_index, value)").filter("value != ''")
    first = values.groupBy("template", "var_index", "value").agg(F.min("seen").alias("seen"))
    ranked = first.selectExpr(
        "*", "row_number() over (partition by template, var_index order by seen, value) as place"
    ).filter(f"place <= {keep}")
    return ranked.groupBy("template", "var_index").agg(
        F.expr("transform(array_sort(collect_list(struct(place, value))), x -> x.value)").alias("values"))


def _kind() -> str:
    """Type, field, confidence and transform of a variable v (name, mask, first, digits); sides of addresses and ports come later."""
    def found(kind: str, field: str, confidence: float, transform: str | None) -> str:
        change = lit(transform) if transform else "cast(null as string)"
        return f"named_struct('kind', {lit(kind)}, 'field', {field}, 'confidence', {confidence}D, 'transform', {change})"

    address = f"(v.mask = '<IP>' or {_marked('v.name', ['ip', 'src', 'dst'])} and {matches('v.first', fx.IPV4_SHAPE)})"
    side = _marked("v.name", ["src", "dst"])
    port = (f"{_marked('v.name', ['port', 'spt', 'dpt'])} or v.mask = '<NUM>' and v.digits and {side}"
            " and try_cast(v.first as decimal(38, 0)) between 1 and 65535")
    rows = []
    for marks, values, mask, pattern, *outcome in fx.FIELD_HINTS:
        hints = [_marked("v.name", marks)]
        hints += [f"upper(v.first) in ({', '.join(lit(w) for w in values)})"] if values else []
        hints += [f"v.mask = {lit(mask)}"] if mask else []
        hints += [matches("v.first", pattern)] if pattern else []
        rows.append((" or ".join(hints), found(outcome[0], lit(outcome[1]), *outcome[2:])))
    own = "concat('unmapped_', v.name)"
    return case(
        (address, found("ipv4", "'ip'", fx.ADDRESS_CONFIDENCE, None)),
        (port, found("port", "'port'", fx.PORT_CONFIDENCE, "to_int")),
        *rows,
        ("v.digits", found("integer", own, fx.NUMBER_CONFIDENCE, "to_int")),
        default=found("string", own, fx.TEXT_CONFIDENCE, None))


def infer_fields(patterns: DataFrame, samples: DataFrame) -> DataFrame:
    """template, pattern, names, variables, rules.

    Hints decide a variable's type; the first address or port of a template is the source, later ones the destination, unless
    the name says source.
    """
    per_template = samples.groupBy("template").agg(
        F.expr("map_from_entries(collect_list(struct(var_index, values)))").alias("_samples"))
    table = patterns.select("template", "pattern", "names", "placeholders").join(per_template, "template", "left")
    first = "trim(both \"'\" from trim(both '\"' from " + strip("coalesce(try_element_at(_samples, i)[0], '')") + "))"
    seen = table.selectExpr(
        "*", "if(size(names) = 0, cast(array() as array<int>), sequence(0, size(names) - 1)) as _at").selectExpr(
        "*", f"transform(_at, i -> struct(names[i] as name, placeholders[i] as mask, {first} as first)) as _v").selectExpr(
        "*", "transform(_v, v -> struct(v.name, v.mask, v.first, v.first rlike '^[0-9]+$' as digits)) as _w").selectExpr(
        "*", f"transform(_w, v -> {_kind()}) as _k")
    earlier = "exists(slice(_k, 1, i), k -> k.kind = _k[i].kind)"
    field = (f"if(_k[i].kind in ('ipv4', 'port'), concat(if(contains(names[i], 'src') or not {earlier}, 'src_', 'dst_'), _k[i].field),"
             " _k[i].field)")
    return seen.selectExpr("*", f"transform(_at, i -> {field}) as _f").selectExpr(
        "template", "pattern", "names",
        "transform(_at, i -> named_struct('var_index', i, 'placeholder', placeholders[i], 'sample_values',"
        " coalesce(try_element_at(_samples, i), array(placeholders[i])), 'inferred_type', _k[i].kind,"
        " 'suggested_ocsf_field', _f[i], 'confidence', _k[i].confidence)) as variables",
        "transform(_at, i -> named_struct('field_name', names[i], 'target_ocsf_field', _f[i], 'transform', _k[i].transform,"
        " 'default_value', cast(null as string))) as rules")


# --- sessions -------------------------------------------------------------------------------


def masked_lines(lines: DataFrame, payload: str, order: str, keep: list[str]) -> DataFrame:
    """seen, the kept columns, masked and line. Fenced, or a join on the masked line would repeat its patterns in filter and key."""
    slim = lines.selectExpr(f"{order} as seen", f"{payload} as payload", *keep)
    return fenced(slim, {"masked": mask_line("payload"), "line": strip("payload")}, ["seen", *keep])


def onboarding_sessions(
    lines: DataFrame,
    payload: str = "raw_payload",
    order: str = "ingest_ts",
    samples: int = 20,
) -> DataFrame:
    """One PENDING review session per template of the unknown lines.

    The session shows the first distinct lines as samples; all lines stay in the dead-letter
    table, which is what a replay reads. Vendor and product come from the first line when the
    frame has these columns.
    """
    # Tables: a filter on the names would else be worked out from the template of each distinct line, below the grouping.
    templates, assignment = mine_templates(lines, payload, order)
    templates = tabled(templates)
    patterns = tabled(template_patterns(templates))
    hinted = {"vendor": "'Custom-Appliance'", "product": "concat('Device-Model-', template_id)"}
    found = [c for c in hinted if c in lines.columns]
    placed = masked_lines(lines, payload, order, found).join(assignment, "masked")
    distinct = placed.groupBy("template", "line").agg(F.min(F.struct("seen", *found)).alias("first"))
    ranked = distinct.selectExpr(
        "*", "row_number() over (partition by template order by first.seen, line) as place").filter(f"place <= {samples}")
    shown = ranked.groupBy("template").agg(
        F.expr("transform(array_sort(collect_list(struct(place, line))), x -> x.line)").alias("raw_sample_logs"),
        F.expr("min_by(first, place)").alias("first"))
    values = sample_values(
        distinct.selectExpr("template", "line", "first.seen as seen").join(
            patterns.select("template", "pattern", "names"), "template"))
    fields = infer_fields(patterns, values)
    whole = fields.join(shown, "template").join(templates.select("template", "template_id", "size"), "template")
    names = [f"coalesce(nullif(first.{c}, 'unknown'), {d}) as {c}" if c in found else f"{d} as {c}"
             for c, d in hinted.items()]
    return whole.selectExpr(
        f"{stable_uuid('template')} as session_id", *names, "'proprietary' as format",
        "template as discovered_template", "template_id", "size", "raw_sample_logs", "variables", "pattern", "names",
        "rules", "'Network Activity' as target_class", f"{fx.CLASS_NETWORK_ACTIVITY} as target_class_uid",
        "'PENDING' as status", f"{fx.SESSION_CONFIDENCE}D as confidence_score",
        "cast(null as string) as reviewed_by", "cast(null as string) as published_parser_id",
        "cast(null as string) as published_version",
    )


def session_samples(lines: DataFrame, assignment: DataFrame, payload: str = "raw_payload", order: str = "ingest_ts") -> DataFrame:
    """session_id, line, seen: every distinct line behind each session, of which the session itself shows the first few."""
    placed = lines.selectExpr(f"{mask_line(payload)} as masked", f"{strip(payload)} as line", f"{order} as seen")
    return placed.groupBy("masked", "line").agg(F.min("seen").alias("seen")).join(assignment, "masked").selectExpr(
        f"{stable_uuid('template')} as session_id", "line", "seen")


def list_sessions(sessions: DataFrame, status: str | None = None, session_id: str | None = None) -> DataFrame:
    """Sessions of a status, or the one of an id."""
    rows = sessions if status is None else sessions.filter(F.col("status") == status)
    return rows if session_id is None else rows.filter(F.col("session_id") == session_id)


def update_mapping(
    sessions: DataFrame,
    session_id: str,
    var_index: int,
    target_ocsf_field: str,
    inferred_type: str | None = None,
    transform: str | None = None,
) -> DataFrame:
    """Sessions with one variable (and its rule) overridden by a reviewer; confidence 1.0."""
    here = f"session_id = {lit(session_id)}"
    kind = lit(inferred_type) if inferred_type else "v.inferred_type"
    variable = (
        "named_struct('var_index', v.var_index, 'placeholder', v.placeholder, 'sample_values', v.sample_values,"
        f" 'inferred_type', {kind}, 'suggested_ocsf_field', {lit(target_ocsf_field)}, 'confidence', 1.0D)")
    rule = (
        f"named_struct('field_name', r.field_name, 'target_ocsf_field', {lit(target_ocsf_field)},"
        f" 'transform', {lit(transform) if transform else 'r.transform'}, 'default_value', r.default_value)")
    rest = [c for c in sessions.columns if c not in ("variables", "rules")]
    return sessions.selectExpr(
        *rest,
        f"case when {here} then transform(variables, (v, i) -> if(i = {var_index}, {variable}, v))"
        " else variables end as variables",
        f"case when {here} then transform(rules, (r, i) -> if(i = {var_index}, {rule}, r)) else rules end as rules",
    ).select(*sessions.columns)


def _with_status(sessions: DataFrame, session_id: str, **values: str) -> DataFrame:
    here = f"session_id = {lit(session_id)}"
    return sessions.selectExpr(*[
        f"case when {here} then {lit(values[c])} else {c} end as {c}" if c in values else c for c in sessions.columns])


def reject(sessions: DataFrame, session_id: str, reason: str, reviewed_by: str) -> tuple[DataFrame, DataFrame]:
    """Sessions with one rejected, and the audit row."""
    audit = audit_rows(sessions.sparkSession, [dict(
        user=reviewed_by, role="REVIEWER", action="ONBOARDING_REJECTED", resource_type="SESSION",
        resource_id=session_id, details={"session_id": session_id, "reason": reason})])
    return _with_status(sessions, session_id, status="REJECTED", reviewed_by=reviewed_by), audit


# --- catalogue ------------------------------------------------------------------------------

CATALOGUE_SCHEMA = (
    "parser_id string, version string, vendor string, product string, pattern string, groups array<string>,"
    f" rules {_RULES}, target_class_uid int, status string, author string, sample_raw string, registered_at timestamp"
)


def empty_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CATALOGUE_SCHEMA)


def publish(
    sessions: DataFrame,
    catalogue: DataFrame,
    session_id: str,
    reviewed_by: str,
    parser_id: str | None = None,
    version: str = "1.0.0",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Catalogue row to append, sessions with one PUBLISHED, and the audit row.

    An ACTIVE (parser_id, version) is immutable. Replay of the waiting lines is
    ``deadletter.replay`` with the new catalogue.
    """
    row = sessions.filter(F.col("session_id") == session_id).selectExpr(
        "vendor", "product", "discovered_template", "size", "size(rules) as n").first()
    if row is None:
        raise ValueError(f"Session {session_id} not found")
    parser_id = parser_id or f"{row.vendor.lower()}-{row['product'].lower()}-parser"
    key = f"{parser_id}:{version}"
    taken = catalogue.filter(
        (F.col("parser_id") == parser_id) & (F.col("version") == version) & (F.col("status") == "ACTIVE"))
    if taken.limit(1).count():
        raise ValueError(f"Cannot overwrite active parser {key}. Publish a new version instead.")
    entry = sessions.filter(F.col("session_id") == session_id).selectExpr(
        f"{lit(parser_id)} as parser_id", f"{lit(version)} as version", "vendor", "product", "pattern",
        "names as groups", "rules", "target_class_uid", "'ACTIVE' as status", f"{lit(reviewed_by)} as author",
        "get(raw_sample_logs, 0) as sample_raw", "current_timestamp() as registered_at")
    audit = audit_rows(sessions.sparkSession, [dict(
        user=reviewed_by, role="REVIEWER", action="ONBOARDING_APPROVED_AND_PUBLISHED", resource_type="PARSER",
        resource_id=key, details={
            "session_id": session_id, "template": row.discovered_template, "rules_count": row.n,
            "waiting_events_count": row["size"]})])
    published = _with_status(
        sessions, session_id, status="PUBLISHED", reviewed_by=reviewed_by, published_parser_id=parser_id,
        published_version=version)
    return entry, published, audit


def publish_pending(
    sessions: DataFrame, catalogue: DataFrame, reviewed_by: str, version: str = "1.0.0"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Publish every PENDING session under the name of its vendor and product: catalogue rows to append, sessions, audit rows.

    A name that two of them share, or that an ACTIVE parser of this version holds, is an error.
    """
    name = "concat(lower(vendor), '-', lower(product), '-parser')"
    pending = sessions.filter("status = 'PENDING'").selectExpr("*", f"{name} as parser_id")
    held = catalogue.filter((F.col("version") == version) & (F.col("status") == "ACTIVE")).select("parser_id")
    taken = pending.groupBy("parser_id").count().filter("count > 1").select("parser_id").union(
        pending.join(held, "parser_id", "left_semi").select("parser_id")).first()
    if taken is not None:
        raise ValueError(f"Parser {taken.parser_id}:{version} is taken. Publish a new version or name it by hand.")
    entries = pending.selectExpr(
        "parser_id", f"{lit(version)} as version", "vendor", "product", "pattern", "names as groups", "rules", "target_class_uid",
        "'ACTIVE' as status", f"{lit(reviewed_by)} as author", "get(raw_sample_logs, 0) as sample_raw", "current_timestamp() as registered_at")
    # One row for each log format a reviewer approves.
    audit = audit_rows(sessions.sparkSession, [dict(
        user=reviewed_by, role="REVIEWER", action="ONBOARDING_APPROVED_AND_PUBLISHED", resource_type="PARSER",
        resource_id=f"{r.parser_id}:{version}", details={
            "session_id": r.session_id, "template": r.discovered_template, "rules_count": r.n, "waiting_events_count": r["size"]})
        for r in pending.selectExpr("parser_id", "session_id", "discovered_template", "size", "size(rules) as n").collect()])
    done = {"status": "'PUBLISHED'", "reviewed_by": lit(reviewed_by), "published_parser_id": name, "published_version": lit(version)}
    published = sessions.selectExpr(*[f"if(status = 'PENDING', {done[c]}, {c}) as {c}" if c in done else c for c in sessions.columns])
    return entries, published, audit


def latest_parser(catalogue: DataFrame, parser_id: str) -> DataFrame:
    """The entry registered last, whatever its version number."""
    return catalogue.filter(F.col("parser_id") == parser_id).orderBy(F.desc("registered_at")).limit(1)


def list_parsers(catalogue: DataFrame) -> DataFrame:
    """Built-in and published parsers: parser_id, version, vendor, product, kind, status."""
    spark = catalogue.sparkSession
    built_in = spark.createDataFrame(
        [(p, "1.0.0", v, d, "native", "ACTIVE") for p, v, d, _ in fx.BUILT_IN_PARSERS],
        "parser_id string, version string, vendor string, product string, kind string, status string")
    return built_in.union(catalogue.selectExpr(
        "parser_id", "version", "vendor", "product", "'drain3_template' as kind", "status"))


def load_definitions(catalogue: DataFrame) -> list[Definition]:
    """Published ACTIVE parsers in registration order, for plan building.

    The catalogue holds one row per reviewed log format: control data, read by the driver
    like the registry it is. A stream loads it again for every micro-batch.
    """
    rows = catalogue.filter("status = 'ACTIVE'").orderBy("registered_at", "parser_id", "version").collect()
    return [
        Definition(
            r.parser_id, r.vendor, r["product"], r.version, r.pattern, tuple(r.groups),
            tuple(Rule(x.field_name, x.target_ocsf_field, x.transform, x.default_value) for x in r.rules),
            r.target_class_uid, r.status)
        for r in rows
    ]
