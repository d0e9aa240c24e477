"""Raw archive: write-once payload table, lookup by id or URI, integrity check, file manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.values import utc_date
from palisade.operators.dimensions import broadcast_if_small
from palisade.plans.checkpoints import tabled
from palisade.sources.digests import can_resume, sha256_by_pieces

_DAY = ["year", "month", "day"]
#: Days that one batch or lookup may name; more are an error, as their list goes through the driver. (About 270 years.)
MOST_DAYS = 100_000
#: Bytes of a file that one task reads for its digest.
PIECE_BYTES = 256 << 20
ARCHIVE_COLUMNS = [
    "event_id", "ingest_ts", "bucket", "object_key", "raw_sha256", "byte_length", "compression", "raw_payload",
]


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def with_day(df: DataFrame, ts: str = "ingest_ts") -> DataFrame:
    """Partition columns year / month / day (UTC) of a timestamp."""
    day = utc_date(ts)
    return df.selectExpr(
        "*", f"date_format({day}, 'yyyy') as year", f"date_format({day}, 'MM') as month",
        f"date_format({day}, 'dd') as day")


def archive_raw(envelopes: DataFrame, path: str, verify: bool = True, staged: str | None = None) -> DataFrame:
    """Append payloads whose id the archive does not hold yet; nothing is ever overwritten. Gives the envelopes to go on with.

    The envelopes are written once, to the folder ``staged`` (what it held is replaced) or to a table of their own, and all else
    reads that: digests and ids are computed once. Existing ids are looked up only in the day partitions this batch touches. The
    rebalance hint sizes the files of each day and source and splits the partition of a hot source.
    """
    spark = envelopes.sparkSession
    if staged is None:
        kept = tabled(envelopes)
    else:
        envelopes.write.mode("overwrite").parquet(staged)
        kept = spark.read.schema(envelopes.schema).parquet(staged)
    days = distinct_days(with_day(kept.select("ingest_ts")))
    rows = with_day(kept.selectExpr(*ARCHIVE_COLUMNS, "vendor as source")).dropDuplicates(["event_id"])
    first = not path_exists(spark, path)
    if not first:
        held = of_days(read_archive(spark, path), days).select("event_id")
        rows = rows.join(held, "event_id", "left_anti")
    rows.hint("rebalance", *_DAY, "source").write.mode("append").partitionBy(*_DAY, "source").parquet(path)
    if verify:
        # What this batch brought, not the whole of its days.
        brought = of_days(read_archive(spark, path), days)
        if not first:
            brought = brought.join(kept.select("event_id").distinct(), "event_id", "left_semi")
        bad = verify_integrity(brought).filter("not is_valid").count()
        if bad:
            raise OSError(f"raw archive holds {bad} payloads whose digest does not match")
    return kept


def distinct_days(rows: DataFrame) -> list[tuple]:
    """The days of the rows' year, month and day columns; an error if they are more than ``MOST_DAYS``."""
    days = [tuple(r) for r in rows.select(*_DAY).distinct().limit(MOST_DAYS + 1).collect()]
    if len(days) > MOST_DAYS:
        raise ValueError(f"more than {MOST_DAYS} days: go through the rows by days instead")
    return days


_ARCHIVE_SCHEMA = (
    "event_id string, ingest_ts timestamp, bucket string, object_key string, raw_sha256 string,"
    " byte_length int, compression string, raw_payload string, year string, month string, day string, source string"
)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_ARCHIVE_SCHEMA).parquet(path)


def of_days(archive: DataFrame, days: list[tuple]) -> DataFrame:
    """Partition-pruned archive: the days come from one batch, so the list is short."""
    if not days:
        return archive.filter("false")
    wanted = " or ".join(f"(year = '{y}' and month = '{m}' and day = '{d}')" for y, m, d in days)
    return archive.filter(wanted)


def read_raw_archive(
    archive: DataFrame, ids: DataFrame | None = None, uris: DataFrame | None = None
) -> DataFrame:
    """Payload and reference of events by ``event_id`` or by ``raw_storage_uri`` (bucket/object_key)."""
    if ids is not None:
        return archive.join(broadcast_if_small(ids.select("event_id").distinct()), "event_id", "left_semi")
    if uris is not None:
        placed = archive.selectExpr("*", "concat(bucket, '/', object_key) as raw_storage_uri")
        return placed.join(
            broadcast_if_small(uris.select("raw_storage_uri").distinct()), "raw_storage_uri", "left_semi")
    return archive


def verify_integrity(archive: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Recompute every digest: valid, tampered, payload missing, or (asked-for ids) not found.

    Without ids this is one narrow pass over the archive.
    """
    rows = archive.selectExpr("event_id", "raw_sha256", "raw_payload")
    if ids is not None:
        wanted = ids.select("event_id").distinct()
        rows = wanted.join(rows, "event_id", "left")
    return rows.selectExpr(
        "event_id",
        "coalesce(raw_sha256, '') as stored_sha256",
        "coalesce(sha2(raw_payload, 256), '') as computed_sha256",
        "coalesce(octet_length(raw_payload), 0) as byte_length",
        "raw_sha256 is not null as known",
        "raw_payload is not null as present",
    ).selectExpr(
        "event_id",
        "known and present and stored_sha256 = computed_sha256 as is_valid",
        "stored_sha256",
        "computed_sha256",
        "byte_length",
        "known and not (present and stored_sha256 = computed_sha256) as tampered",
        "case when not known then concat('Event ID ', event_id, ' not found in raw archive')"
        " when not present then concat('Raw payload missing for event ', event_id)"
        " when stored_sha256 = computed_sha256 then 'Cryptographic integrity verified: SHA-256 matches exactly'"
        " else 'ALERT: Stored SHA-256 hash mismatch! Payload has been tampered with.' end as details",
    )


def dataset_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Relative path and SHA-256 of every file below a folder.

    Files of up to ``PIECE_BYTES`` are rows of one pass. Larger ones are read at once, when this is called, by a chain of tasks that take
    one piece each. That needs files that workers can open by their path; on other file systems each file must fit in a row.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = _openable(spark, files.filter(F.col("length") > PIECE_BYTES).select("path", "length").collect())
    if large:
        files = files.filter(F.col("length") <= PIECE_BYTES)
    digests = files.select("path", F.sha2("content", 256).alias("sha256"))
    if large:
        digests = digests.union(
            spark.createDataFrame(sha256_by_pieces(spark.sparkContext, large, PIECE_BYTES), "path string, sha256 string"))
    return digests.select(
        F.regexp_replace(F.col("path"), F.lit("^file:/+"), F.lit("file:/")).alias("full"), "sha256"
    ).select(
        F.expr(f"substring(full, length(regexp_replace('{base}', '^file:/+', 'file:/')) + 2)").alias("path"), "sha256")


def _openable(spark: SparkSession, listed: list) -> list[tuple[str, str, int]]:
    """Path, the local or mounted file behind it, and size of listed files; none if one of them is elsewhere."""
    if not can_resume():
        return []
    found = []
    for row in listed:
        place = spark._jvm.org.apache.hadoop.fs.Path(row.path)
        uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).resolvePath(place).toUri()
        if uri.getScheme() != "file":
            return []
        found.append((row.path, uri.getPath(), row.length))
    return found


def verify_manifest(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Status per listed file: ok, missing or mismatch. Files not listed are ignored."""
    found = actual.selectExpr("path", "sha256 as actual_sha256")
    return manifest.join(found, "path", "left").selectExpr(
        "path", "sha256", "actual_sha256",
        "case when actual_sha256 is null then 'missing' when actual_sha256 = sha256 then 'ok'"
        " else 'mismatch' end as status")


def lake_files(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of the lake, newest first: path, filename, size_bytes, modified_at."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet").load(path)
    return files.select(
        "path",
        F.substring_index("path", "/", -1).alias("filename"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
    ).orderBy(F.desc("modified_at"), "path")
