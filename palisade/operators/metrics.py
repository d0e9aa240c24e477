"""Pipeline metrics: counters, event rates, exact latency percentiles, throughput report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import fixed_values as fx
from palisade.functions.text import lit

_ACCURACY = 100_000
_MARGIN = 5.0 / _ACCURACY


def pipeline_counters(processed: DataFrame) -> DataFrame:
    """Ingested, normalised, errors and unknown lines of judged rows, in one pass.

    Unknown formats are queued for onboarding and are not counted as errors.
    """
    return processed.selectExpr(
        "count(*) as total_ingested",
        "count_if(error_stage is null) as total_normalized",
        "count_if(error_stage is not null and error_stage != 'UNKNOWN_FORMAT') as total_errors",
        f"count_if(parser_used = {lit(fx.ONBOARDING_QUEUE)} and error_stage = 'UNKNOWN_FORMAT') as total_unknowns",
    )


def events_per_second(events: DataFrame, ts: str, seconds: int = 5) -> DataFrame:
    """Events and rate per window: window_start_ms, events, eps (rounded to 1 digit).

    Works on batch frames and on streams; a stream needs a watermark on ``ts`` first.
    """
    span = F.window(ts, f"{seconds} seconds")
    return events.groupBy(span.alias("w")).agg(F.count("*").alias("events")).selectExpr(
        "unix_millis(w.start) as window_start_ms", "events", f"round(events / {float(seconds)}D, 1) as eps")


#: Windows of one slot of time, the part of a trailing rate that one task orders.
_SLOT_WINDOWS = 64


def trailing_rate(events: DataFrame, ts: str, seconds: int = 5) -> DataFrame:
    """At every time with an event: events of the last ``seconds`` (both ends count) and their rate: ts_us, events, eps.

    Times are counted first, so a busy instant is one row. The time line is cut into slots; each gets the end of the slot before as
    context, so that no task orders all events. A time's count enters a running sum and leaves it when its window has passed: one
    ordered run over the slot, however many times a window holds.
    """
    window = seconds * 1_000_000
    width = _SLOT_WINDOWS * window
    counted = events.selectExpr(f"unix_micros({ts}) as us").filter("us is not null").groupBy("us").agg(F.count("*").alias("c"))
    slot = f"us div {width} - if(us % {width} < 0, 1, 0)"
    placed = counted.selectExpr("us", "c", f"{slot} as slot").selectExpr(
        "us", "c", f"inline(filter(array(struct(slot, true as own), struct(slot + 1 as slot, false as own)),"
                   f" s -> s.own or us >= (slot + 1) * {width} - {window}))")
    steps = placed.selectExpr(
        "slot", f"inline(array(struct(us as at, c as step, own), struct(us + {window + 1} as at, -c as step, false as own)))")
    summed = steps.selectExpr("at", "own", "sum(step) over (partition by slot order by at) as events")
    return summed.filter("own").selectExpr(
        "at as ts_us", "events", f"round(events / {float(seconds)}D, 1) as eps")


def service_counters(
    processed: DataFrame, errors: DataFrame, catalogue: DataFrame, sessions: DataFrame, ledger: DataFrame
) -> DataFrame:
    """One row: the pipeline's counters, unresolved dead letters, active parsers (built in and published), review sessions, and
    deliveries by state."""
    from palisade.operators.deadletter import list_errors
    from palisade.operators.delivery import latest_ledger
    from palisade.operators.onboarding import list_parsers

    states = latest_ledger(ledger).selectExpr(
        "count_if(state not in ('DELIVERY_COMPLETE', 'DEAD_LETTER')) as outbox_pending_count",
        "count_if(state = 'FAILED_RETRYABLE') as outbox_failed_count", "count_if(state = 'DEAD_LETTER') as dlq_count",
        "count_if(state = 'DELIVERY_COMPLETE') as outbox_complete_count")
    row = pipeline_counters(processed)
    for other in (
        list_errors(errors, status="UNRESOLVED").selectExpr("count(*) as unresolved_errors_count"),
        list_parsers(catalogue).selectExpr("count_if(status = 'ACTIVE') as active_parsers_count"),
        sessions.selectExpr("count(*) as onboarding_sessions_count"), states,
    ):
        row = _beside(row, other)
    return row


def exact_percentiles(
    df: DataFrame, value: str, by: list[str], quantiles: dict[str, float]
) -> DataFrame:
    """Per group, the value at 0-based place floor(n * q) of the sorted values, n and mean.

    Two passes and no sort of the data: a mergeable sketch brackets each quantile, then only
    the distinct values inside the bracket are counted and ranked, with everything below
    summed to one number. A hot group costs partial aggregates, never one big list. If a
    bracket ever missed its quantile the job fails instead of giving a wrong value.
    """
    rows = df.selectExpr(*by, f"cast({value} as double) as _v").filter("_v is not null")
    bounds, places = [], []
    for i, q in enumerate(quantiles.values()):
        bounds += [max(q - _MARGIN, 0.0), min(q + _MARGIN, 1.0)]
        places.append(f"struct({i} as q, least(cast(floor(n * {q}D) as bigint), n - 1) as place,"
                      f" cuts[{2 * i}] as low, cuts[{2 * i + 1}] as high)")
    cuts = ", ".join(f"{b}D" for b in bounds)
    grouped = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("_v").alias("mean"),
        F.expr(f"percentile_approx(_v, array({cuts}), {_ACCURACY})").alias("cuts"),
    )
    marks = f"array({', '.join(places)})"
    if by:
        cut = grouped.selectExpr(*[f"{c} as _by{i}" for i, c in enumerate(by)], f"inline({marks})")
        joined = rows.join(cut, _same(by)).drop(*[f"_by{i}" for i in range(len(by))])
    else:
        joined = rows.select("_v", grouped.selectExpr(f"{marks} as m").scalar().alias("m")).selectExpr("_v", "inline(m)")
    counted = joined.filter("_v <= high").selectExpr(
        *by, "q", "place", "case when _v >= low then _v end as _v"
    ).groupBy(*by, "q", "place", "_v").agg(F.count("*").alias("c"))
    over = f"partition by {', '.join([*by, 'q'])} order by _v nulls first"
    ranked = counted.selectExpr(*by, "q", "place", "_v", f"sum(c) over ({over}) as upto", "c")
    picked = ranked.filter("upto > place and upto - c <= place").groupBy(*by).agg(
        *[F.max(F.expr(f"case when q = {i} then _v end")).alias(name) for i, name in enumerate(quantiles)])
    if by:
        own = picked.withColumnsRenamed({c: f"_by{i}" for i, c in enumerate(by)})
        out = grouped.drop("cuts").join(own, _same(by), "left").drop(*[f"_by{i}" for i in range(len(by))])
    else:
        out = _beside(picked, grouped.drop("cuts"))
    checked = [
        f"case when {name} is null and n > 0 then raise_error('percentile bracket missed its value')"
        f" else {name} end as {name}"
        for name in quantiles
    ]
    return out.selectExpr(*by, "n", "mean", *checked)


def _same(by: list[str]):
    """Group columns equal to their renamed copies; a null group is a group."""
    return F.expr(" and ".join(f"{c} <=> _by{i}" for i, c in enumerate(by)))


def _beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """Columns of two one-row frames in one row, through a scalar subquery."""
    names = [c for c in other.columns if c not in one.columns]
    packed = other.selectExpr(f"struct({', '.join(names)}) as _other")
    return one.select("*", packed.scalar().alias("_other")).select(*one.columns, *[f"_other.{n}" for n in names])


LATENCY_QUANTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def latency_percentiles(
    df: DataFrame, latency: str, by: list[str] | None = None, last: int | None = None, order: str | None = None
) -> DataFrame:
    """p50 / p95 / p99 and mean, rounded to 2 digits. ``last`` keeps the newest rows by ``order``."""
    if last is not None:
        df = df.orderBy(F.desc(order)).limit(last)
    by = by or []
    out = exact_percentiles(df, latency, by, LATENCY_QUANTILES)
    return out.selectExpr(
        *by, "n as events", *[f"round({q}, 2) as {q}" for q in LATENCY_QUANTILES], "round(mean, 2) as mean")


def throughput_report(run_log: DataFrame, started: str, byte_length: str, latency: str) -> DataFrame:
    """One row over a run log: events, bytes, seconds, events/s, MB/s, latencies, events per day."""
    rows = run_log.selectExpr(f"{started} as _ts", f"{byte_length} as _b", f"{latency} as _l")
    base = rows.selectExpr(
        "count(*) as total_events_processed",
        "sum(_b) as total_data_bytes",
        "greatest((unix_micros(max(_ts)) - unix_micros(min(_ts))) / 1000000D, 0.001D) as seconds",
    )
    spread = exact_percentiles(rows, "_l", [], LATENCY_QUANTILES).selectExpr(
        "round(mean, 3) as latency_avg_ms", *[f"round({q}, 3) as latency_{q}_ms" for q in LATENCY_QUANTILES])
    return _beside(base, spread).selectExpr(
        "total_events_processed", "total_data_bytes", "round(seconds, 3) as duration_seconds",
        "round(total_events_processed / seconds, 1) as throughput_eps",
        "round(total_data_bytes / 1048576D / seconds, 2) as throughput_mb_sec",
        "latency_avg_ms", *[f"latency_{q}_ms" for q in LATENCY_QUANTILES],
        "round(round(total_events_processed / seconds, 1) * 86400 / 1000000, 1) as million_events_per_day",
    )
