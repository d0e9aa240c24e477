"""An index of the raw archive, event id to day, so that a lookup of some ids reads their days' files alone.

The index holds (event_id, year, month, day) in buckets of ids, sorted by id; its rows are a small part of the archive's bytes. It is
brought up to date day by day: days that it holds with as many rows as the archive has are left as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.dimensions import broadcast_if_small
from palisade.sources.archive import distinct_days, of_days, path_exists, read_archive

BUCKETS = 64
_DAY = ["year", "month", "day"]
_SCHEMA = "event_id string, year string, month string, day string, bucket int"


def _bucket() -> str:
    return f"cast(pmod(xxhash64(event_id), {BUCKETS}) as int)"


def read_index(spark: SparkSession, index: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(index)


def update_index(spark: SparkSession, archive: str, index: str) -> int:
    """Add the days that are new or have grown; how many days were written. Reads ids and partition columns only."""
    held = read_archive(spark, archive).groupBy(*_DAY).agg(F.count("*").alias("n"))
    if path_exists(spark, index):
        known = read_index(spark, index).groupBy(*_DAY).agg(F.count("*").alias("n"))
        held = held.join(known, [*_DAY, "n"], "left_anti")
    days = distinct_days(held)
    if not days:
        return 0
    rows = of_days(read_archive(spark, archive), days).select("event_id", *_DAY).selectExpr("*", f"{_bucket()} as bucket")
    if path_exists(spark, index):
        rows = rows.join(of_days(read_index(spark, index), days).select("event_id"), "event_id", "left_anti")
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "event_id").write.mode("append").option(
        "parquet.bloom.filter.enabled#event_id", "true").partitionBy("bucket").parquet(index)
    return len(days)


def lookup(spark: SparkSession, archive: str, index: str, ids: DataFrame) -> DataFrame:
    """Archive rows of the ids (a frame with event_id): the index names the days, and only their partitions are read."""
    wanted = broadcast_if_small(ids.select("event_id").distinct())
    buckets = [r["bucket"] for r in wanted.selectExpr(f"{_bucket()} as bucket").distinct().collect()]
    placed = read_index(spark, index).filter(F.col("bucket").isin(buckets)).join(wanted, "event_id", "left_semi")
    return of_days(read_archive(spark, archive), distinct_days(placed)).join(wanted, "event_id", "left_semi")
