"""Log line sources, batch and streaming. All give raw_payload, source_position and hints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.text import last_key_wins, lit, strip
from palisade.operators.dimensions import broadcast_if_small
from palisade.plans.checkpoints import tabled

#: Files of up to so many bytes are read as one row each, and need no pass that counts lines.
WHOLE_BYTES = 8 << 20
#: What ends a line, as in files that are read by line.
_LINE_END = r"\r\n|\n|\r"


def _hinted(df: DataFrame, vendor_hint: str | None, product_hint: str | None, transport: str) -> DataFrame:
    return df.selectExpr(
        "*",
        f"cast({lit(vendor_hint)} as string) as vendor_hint",
        f"cast({lit(product_hint)} as string) as product_hint",
        f"{lit(transport)} as transport",
        "'127.0.0.1' as client_ip",
    )


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped, non-blank, non-comment lines with their position, file and line number.

    Files are told apart by size when they are listed, so each branch opens its own files only: small ones are split into lines in
    the scan, one row each; those cut into splits are scanned once for the splits' numbers of lines and once for the lines.
    """
    small = spark.read.text(path, wholetext=True).filter(f"_metadata.file_size <= {WHOLE_BYTES}").selectExpr(
        "_metadata.file_path as _file", f"posexplode(split(value, {lit(_LINE_END)})) as (_n, value)").selectExpr(
        "value", "concat_ws('#', _file, _n) as source_position")
    large = spark.read.text(path).filter(f"_metadata.file_size > {WHOLE_BYTES}").selectExpr(
        "value", "_metadata.file_path as _file", "_metadata.file_block_start as _block")
    placed = small
    if not large.isEmpty():
        placed = small.unionByName(numbered_lines(large))
    return placed.selectExpr(f"{strip('value')} as raw_payload", "source_position").filter(
        "raw_payload != '' and not startswith(raw_payload, '#')")



def numbered_lines(df: DataFrame) -> DataFrame:
    """Replace ``_file`` and ``_block`` (start of the split) by ``source_position``: file and line number.

    A line's place in its split is counted from the split's first row, and the lines of earlier splits are added: the
    number depends on the file alone, not on split size, cores, or what else is read. One extra pass counts lines into a
    written table, which has a row for each split.
    """
    rows = df.selectExpr("*", "monotonically_increasing_id() as _n")
    splits = tabled(rows.groupBy("_file", "_block").agg({"_n": "min", "*": "count"}).withColumnsRenamed(
        {"min(_n)": "_first", "count(1)": "_lines"})).selectExpr(
        "_file as _f", "_block as _b", "_first",
        "sum(_lines) over (partition by _file order by _block) - _lines as _before")
    placed = rows.join(broadcast_if_small(splits), [rows["_file"] == splits["_f"], rows["_block"] == splits["_b"]])
    return placed.selectExpr(
        *[c for c in df.columns if c not in ("_file", "_block")], "concat_ws('#', _file, _before + _n - _first) as source_position")


def read_log_lines(
    spark: SparkSession, path: str, vendor_hint: str | None = None, product_hint: str | None = None
) -> DataFrame:
    """Text files by line. Undecodable bytes read as U+FFFD; blank and ``#`` lines are dropped."""
    return _hinted(_lines(spark, path), vendor_hint, product_hint, "file")


def read_json_array_files(
    spark: SparkSession, path: str, vendor_hint: str | None = None, product_hint: str | None = None
) -> DataFrame:
    """Files whose whole content is a JSON array: each element is one event.

    String elements are taken as they are, others as JSON text. A file must fit in a row;
    files that are not one array give no rows here and belong to ``read_log_lines``.
    """
    last_key_wins(spark)
    whole = spark.read.text(path, wholetext=True).selectExpr(f"{strip('value')} as body", "_metadata.file_path as file")
    arrays = whole.filter("startswith(body, '[') and endswith(body, ']')").selectExpr(
        "file", "try_variant_get(try_parse_json(body), '$', 'array<variant>') as items")
    each = arrays.selectExpr("file", "posexplode(items) as (at, element)").selectExpr(
        "case when startswith(to_json(element), '\"') then try_variant_get(element, '$', 'string')"
        " else to_json(element) end as raw_payload",
        "concat_ws('#', file, at) as source_position",
    )
    return _hinted(each, vendor_hint, product_hint, "file")


def read_log_files(
    spark: SparkSession, path: str, vendor_hint: str | None = None, product_hint: str | None = None
) -> DataFrame:
    """Files of either kind: elements of those that are one JSON array, lines of all others. Each file must fit in a row."""
    arrays = read_json_array_files(spark, path, vendor_hint, product_hint)
    files = arrays.selectExpr("substring_index(source_position, '#', 1) as array_file").distinct()
    lines = read_log_lines(spark, path, vendor_hint, product_hint)
    rest = lines.withColumn("array_file", F.substring_index("source_position", "#", 1)).join(
        broadcast_if_small(files), "array_file", "left_anti").drop("array_file")
    return arrays.unionByName(rest)


def from_dataframe(df: DataFrame, payload: str = "raw_payload") -> DataFrame:
    """Rows of any frame with a text column; null and blank payloads are skipped."""
    rest = [c for c in df.columns if c != payload]
    return df.selectExpr(*rest, f"{payload} as raw_payload").filter(f"{strip('raw_payload')} != ''")


def read_log_stream(
    spark: SparkSession, path: str, transport: str = "udp", max_files_per_trigger: int = 1000
) -> DataFrame:
    """Stream of lines that collectors land as text files, newline-framed; empty lines dropped.

    The files take the place of socket listeners: they can be read again after a failure.
    ``_file`` and ``_block`` name the file split; the ingest stream turns them into the line's number in its file, so
    equal lines stay separate events, and drops the empty lines then.
    """
    stream = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(path)
    placed = stream.selectExpr(
        f"{strip('value')} as raw_payload",
        "_metadata.file_path as _file", "_metadata.file_block_start as _block",
        f"{lit(transport)} as transport",
        "'127.0.0.1' as client_ip",
    )
    return placed


def from_kafka_rows(df: DataFrame, transport: str = "kafka") -> DataFrame:
    """Lines of a Kafka source frame (value, topic, partition, offset): the offset is the position."""
    return df.selectExpr(
        f"{strip('cast(value as string)')} as raw_payload",
        "concat_ws('#', topic, partition, offset) as source_position",
        f"{lit(transport)} as transport",
    ).filter("raw_payload != ''")
