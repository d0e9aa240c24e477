"""Enrichment: asset inventory, geo networks, private / loopback classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import apart
from palisade.functions.values import ipv4_to_long, is_loopback, is_private
from palisade.operators.dimensions import (
    BROADCAST_ROWS, BUCKET_BITS, broadcast_if_small, default_assets, default_geo_intervals, geo_intervals,
)

SIDES = ("src", "dst")


def classify_ips(df: DataFrame, networks=None, exceptions=None) -> DataFrame:
    """Add ``<side>_is_private`` and ``<side>_is_loopback`` (null for anything but IPv4)."""
    df = df.selectExpr("*", *[f"{ipv4_to_long(f'{s}_ip')} as _{s}" for s in SIDES])
    return df.selectExpr(
        "*",
        *[f"{is_private(f'_{s}', networks, exceptions)} as {s}_is_private" for s in SIDES],
        *[f"{is_loopback(f'_{s}')} as {s}_is_loopback" for s in SIDES],
    ).drop(*[f"_{s}" for s in SIDES])


def enrich_assets(df: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Host name and zone from the inventory where the line gave none; ``asset_info`` always."""
    small = default_assets(df.sparkSession) if assets is None else broadcast_if_small(assets)
    for side in SIDES:
        known = small.selectExpr(
            f"ip as {side}_ip", f"struct(name, role, zone, criticality) as {side}_asset_info")
        df = df.join(known, f"{side}_ip", "left")
    rest = [c for c in df.columns if c not in {f"{s}_{p}" for s in SIDES for p in ("hostname", "zone")}]
    return df.selectExpr(
        *rest,
        *[f"coalesce({s}_hostname, {s}_asset_info.name) as {s}_hostname" for s in SIDES],
        *[f"coalesce({s}_zone, {s}_asset_info.zone) as {s}_zone" for s in SIDES],
    )


def _intervals(geo: DataFrame) -> DataFrame:
    """Intervals of a network table; n networks give at most 2n + 65536 of them."""
    small = geo.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(geo_intervals(geo)) if small else geo_intervals(geo)


def enrich_geo(df: DataFrame, geo: DataFrame | None = None, networks=None, exceptions=None) -> DataFrame:
    """Location and autonomous system of public IPv4 addresses."""
    intervals = default_geo_intervals(df.sparkSession) if geo is None else _intervals(geo)
    df = df.selectExpr("*", *[f"{ipv4_to_long(f'{s}_ip')} as _{s}" for s in SIDES])
    public = [
        f"case when not {is_private(f'_{s}', networks, exceptions)} and not {is_loopback(f'_{s}')}"
        f" then _{s} end as _{s}_public"
        for s in SIDES
    ]
    df = df.selectExpr("*", *public)
    for side in SIDES:
        number = f"_{side}_public"
        spans = intervals.selectExpr(
            f"bucket as _{side}_bucket", f"low as _{side}_low", f"high as _{side}_high", f"geo as _{side}_geo")
        # Each lookup in code of its own: two on a wide row, or these with the steps before, are too large for the JIT compiler.
        # The address is what the lookup needs, so no query's pruning takes this column away.
        df = df.selectExpr(*[c for c in df.columns if c != number], apart(number))
        df = df.selectExpr("*", f"shiftright({number}, {BUCKET_BITS}) as _{side}_key").join(
            spans,
            (F.col(f"_{side}_key") == F.col(f"_{side}_bucket"))
            & F.col(number).between(F.col(f"_{side}_low"), F.col(f"_{side}_high")),
            "left")
    found = []
    for s in SIDES:
        g = f"_{s}_geo"
        found += [
            f"case when {g} is not null then struct({g}.country, {g}.city, {g}.country_code) end as {s}_location",
            f"case when {g} is not null then struct({g}.as_name as name, {g}.as_num as number) end"
            f" as {s}_autonomous_system",
        ]
    return df.selectExpr(*[c for c in df.columns if not c.startswith("_")], *found)


def enrich(
    df: DataFrame,
    assets: DataFrame | None = None,
    geo: DataFrame | None = None,
    networks: list[str] | None = None,
    exceptions: list[str] | None = None,
) -> DataFrame:
    """Both lookups on both endpoints; tables default to the built-in dimensions."""
    return enrich_geo(enrich_assets(df, assets), geo, networks, exceptions)
