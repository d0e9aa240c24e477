"""The event table by key: appended batches, compacted into buckets of event ids, read without a shuffle of the history.

A batch is appended under its version; writing the same batch again replaces it. Compaction writes all current rows as a new
generation, one partition for each bucket of ids, sorted by id and with a Bloom filter on it, and then one row of state, which makes
the generation valid: until that row is there readers take the one before. Readers take the generation as it stands, without the rows
whose id a later batch holds, and the newest row of these batches; only the batches since the last compaction are grouped. A lookup of
ids reads their buckets alone. Old generations and compacted batches stay until ``expire`` removes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.dimensions import BROADCAST_ROWS, broadcast_if_small
from palisade.operators.sinks import current_events, upsert_events
from palisade.sources.archive import path_exists

VERSION = "batch_version"
#: Buckets of a new table: a compacted bucket should be a few files of some hundred megabytes.
BUCKETS = 64
_STATE = "generation bigint, upto bigint, buckets int"


def append(events: DataFrame, path: str, batch_id: int) -> None:
    """One batch of rows, each id once; the batch with the highest number wins."""
    upsert_events(events, f"{path}/batches", batch_id, VERSION)


def _state(spark: SparkSession, path: str) -> tuple[int, int, int] | None:
    """Generation, last compacted batch and buckets; the state has one row for each compaction."""
    if not path_exists(spark, f"{path}/state"):
        return None
    row = spark.read.schema(_STATE).parquet(f"{path}/state").agg(F.max(F.struct("generation", "upto", "buckets")).alias("last")).first()
    return tuple(row["last"]) if row["last"] else None


def _bucket(buckets: int) -> str:
    return f"cast(pmod(xxhash64(event_id), {buckets}) as int)"


def _batches(spark: SparkSession, path: str, state: tuple[int, int, int] | None) -> DataFrame:
    rows = spark.read.parquet(f"{path}/batches").withColumn(VERSION, F.col(VERSION).cast("bigint"))
    return rows if state is None else rows.filter(F.col(VERSION) > state[1])


def read(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """The newest row of every event id, or of the given ids (a frame with event_id)."""
    state = _state(spark, path)
    late = _batches(spark, path, state)
    if ids is not None:
        ids = broadcast_if_small(ids.select("event_id").distinct())
        late = late.join(ids, "event_id", "left_semi")
    newest = current_events(late, VERSION)
    if state is None:
        return newest
    base = _generation(spark, path, state[0], late.schema.names)
    if ids is not None:
        # No more rows than buckets come to the driver; the partitions of the others are not read.
        wanted = [r["bucket"] for r in ids.selectExpr(f"{_bucket(state[2])} as bucket").distinct().collect()]
        base = base.filter(F.col("bucket").isin(wanted)).join(ids, "event_id", "left_semi")
    base = base.drop("bucket")
    if late.select("event_id").isEmpty():
        return base.select(*newest.columns)
    replaced = broadcast_if_small(late.select("event_id").distinct())
    return base.join(replaced, "event_id", "left_anti").select(*newest.columns).unionByName(newest)


def _generation(spark: SparkSession, path: str, generation: int, columns: list[str]) -> DataFrame:
    return spark.read.parquet(f"{path}/generations/generation={generation}").select(*columns, "bucket")


def compact(spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
    """All batches so far become one more generation. The number of buckets of the first stays."""
    state = _state(spark, path)
    upto = _batches(spark, path, None).agg(F.max(VERSION)).first()[0]
    if upto is None or (state and upto <= state[1]):
        return
    generation, buckets = (state[0] + 1, state[2]) if state else (1, buckets)
    rows = read(spark, path).filter(F.col(VERSION) <= upto).selectExpr("*", f"{_bucket(buckets)} as bucket")
    # Ids are hashed, so no bucket is hot; a large bucket is split by the hint, and each part sorted.
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "event_id").write.mode("overwrite").option(
        "parquet.bloom.filter.enabled#event_id", "true").partitionBy("bucket").parquet(f"{path}/generations/generation={generation}")
    spark.createDataFrame([(generation, upto, buckets)], _STATE).coalesce(1).write.mode("append").parquet(f"{path}/state")


def get_events(spark: SparkSession, path: str, event_ids: list[str]) -> DataFrame:
    """The newest rows of some ids, from their buckets."""
    if len(event_ids) > BROADCAST_ROWS:
        raise ValueError("pass a frame of ids to read() instead")
    return read(spark, path, spark.createDataFrame([(i,) for i in event_ids], "event_id string"))


def expire(spark: SparkSession, path: str) -> list[str]:
    """Delete the generations and batches that the last compaction has replaced, once no reader uses them: the folders deleted."""
    state = _state(spark, path)
    if state is None:
        return []
    hadoop = spark._jvm.org.apache.hadoop.fs
    gone = []
    for folder, name, last in (("generations", "generation", state[0] - 1), ("batches", VERSION, state[1])):
        root = hadoop.Path(f"{path}/{folder}")
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for entry in files.listStatus(root):
            found = entry.getPath().getName().split("=")
            # the newest batch stays: it tells a reader the columns
            if found[0] == name and int(found[1]) <= last and not (folder == "batches" and int(found[1]) == state[1]):
                files.delete(entry.getPath(), True)
                gone.append(f"{folder}/{entry.getPath().getName()}")
    return sorted(gone)
