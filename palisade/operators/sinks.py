"""Table sinks: the partitioned lake and the last-write-wins event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.ocsf import flatten_events
from palisade.sources.archive import distinct_days, of_days, path_exists


def dedupe_events(df: DataFrame) -> DataFrame:
    """One row per event_id. Partial aggregation thins copies before the shuffle."""
    return df.dropDuplicates(["event_id"])


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the highest ``order`` per key, as a max over structs.

    A grouped maximum combines copies on the map side; a ranking window would bring all
    copies of a hot key into one task.
    """
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_last")).select(key, "_last.*").select(*df.columns)


def _day_columns() -> list[str]:
    day = "date_format(timestampadd(MILLISECOND, time_epoch, timestamp_ntz'1970-01-01 00:00:00'), '{}')"
    return [f"{day.format('yyyy')} as year", f"{day.format('MM')} as month", f"{day.format('dd')} as day"]


def write_lake(events: DataFrame, path: str) -> None:
    """Flat Snappy Parquet, partitioned by event date; each event once.

    Ids the lake already holds are left out, so a repeated batch changes nothing. The held
    side reads the id column and the partition columns only.
    """
    spark = events.sparkSession
    flat = dedupe_events(flatten_events(events).selectExpr("*", *_day_columns()))
    if path_exists(spark, path):
        # Only the days of this batch: the history's size does not matter.
        days = distinct_days(events.selectExpr(*_day_columns()))
        held = of_days(spark.read.schema(flat.schema).parquet(path), days).select("event_id", "year", "month", "day")
        flat = flat.join(held, ["event_id", "year", "month", "day"], "left_anti")
    flat.hint("rebalance", "year", "month", "day").write.mode("append").option(
        "compression", "snappy").partitionBy("year", "month", "day").parquet(path)


def read_lake(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "false").parquet(path)


def upsert_events(events: DataFrame, path: str, batch_id: int, version: str = "batch_version") -> None:
    """Append a batch of event rows as one version, replacing an earlier try of the same batch."""
    rows = events.withColumn(version, F.lit(batch_id).cast("bigint"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(version).parquet(path)


def current_events(table: DataFrame, version: str = "batch_version") -> DataFrame:
    """The event table as readers see it: the last written row per event_id."""
    rest = [c for c in table.columns if c != "event_id"]
    return table.groupBy("event_id").agg(F.max_by(F.struct(*rest), version).alias("_last")).select(
        "event_id", "_last.*").select(*table.columns)
