"""Enrichment dimensions: asset inventory and geo networks, and the size check for broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade import fixed_values as fx
from palisade.functions.text import lit
from palisade.functions.values import ipv4_to_long

BROADCAST_ROWS = 200_000
BUCKET_BITS = 16
_BASE = "substring_index(network, '/', 1)"


def broadcast_if_small(dim: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only for a dimension counted to be small; else Spark picks the join.

    The count reads the dimension, never the events, and stops at the bound.
    """
    return F.broadcast(dim) if dim.limit(max_rows + 1).count() <= max_rows else dim


def values_table(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A small fixed table as a VALUES relation, whose size the optimiser knows."""
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return spark.sql(f"select * from values {body} as t({', '.join(columns)})")


def default_assets(spark: SparkSession) -> DataFrame:
    return F.broadcast(values_table(spark, fx.ASSETS, ["ip", "name", "role", "zone", "criticality"]))


def default_geo(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(fx.GEO_NETWORKS)]
    return values_table(
        spark, rows, ["position", "network", "country", "country_code", "city", "as_name", "as_num"])


def geo_intervals(geo: DataFrame) -> DataFrame:
    """Geo networks as disjoint address intervals, cut at /16 borders.

    Where networks overlap the lowest ``position`` wins. CIDR networks nest or are disjoint,
    so every elementary interval is owned by the best of its at most 33 enclosing prefixes:
    an equality join on (prefix length, prefix). Disjoint intervals let an address match at
    most one row, so the event side of the lookup needs no de-duplication; the /16 bucket
    gives that lookup an equality key.
    """
    facts = ", ".join(c for c in geo.columns if c not in ("network", "position"))
    nets = geo.selectExpr(
        "position", f"struct({facts}) as geo",
        "cast(substring_index(network, '/', -1) as int) as length",
        f"{ipv4_to_long(_BASE)} as low",
    ).selectExpr(
        "*", "low + shiftleft(1L, 32 - length) as after", "shiftright(low, 32 - length) as prefix")
    edges = nets.selectExpr("inline(array(struct(low as start), struct(after as start)))").distinct()
    # The edges lie in 65536 /16 buckets; ordering them per bucket and closing each bucket at
    # its border keeps the window groups small however long the network list is.
    bucket_size = 1 << BUCKET_BITS
    borders = nets.selectExpr(
        f"explode(sequence(shiftright(low, {BUCKET_BITS}), shiftright(after - 1, {BUCKET_BITS}))) as bucket"
    ).distinct().selectExpr(f"bucket * {bucket_size} as start")
    pieces = edges.union(borders).distinct().selectExpr(
        f"shiftright(start, {BUCKET_BITS}) as bucket", "start as low"
    ).selectExpr(
        "*",
        f"coalesce(lead(low) over (partition by bucket order by low), (bucket + 1) * {bucket_size}) - 1 as high")
    probes = pieces.selectExpr("*", "explode(sequence(0, 32)) as length").selectExpr(
        "*", "shiftright(low, 32 - length) as prefix")
    return (
        probes.join(nets.select("length", "prefix", "position", "geo"), ["length", "prefix"])
        .groupBy("bucket", "low", "high")
        .agg(F.min_by("geo", "position").alias("geo"))
    )


_default_intervals: list[tuple] = []


def default_geo_intervals(spark: SparkSession) -> DataFrame:
    """Intervals of the built-in networks, worked out once per process (a handful of rows)."""
    if not _default_intervals:
        rows = geo_intervals(default_geo(spark)).selectExpr("bucket", "low", "high", "geo.*").collect()
        _default_intervals.extend(tuple(r) for r in rows)
    table = values_table(
        spark, _default_intervals, ["bucket", "low", "high", "country", "country_code", "city", "as_name", "as_num"])
    return F.broadcast(table.selectExpr(
        "cast(bucket as bigint) as bucket", "low", "high",
        "struct(country, country_code, city, as_name, as_num) as geo"))
